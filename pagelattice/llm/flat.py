"""Texts of an Arrow batch as one byte array, and vectorised work on it.

A batch's UTF-8 bytes lie end to end in one numpy array.  Words are found with
byte masks and hashed with a polynomial hash whose prefix sums make any span's
hash two lookups, so nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a piece of its own.
PIECE_BYTES = 2 << 20
_CHUNK = 1 << 17
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    step = (seed * 0x2545F4914F6CDD1D + 1) & 0xFFFFFFFFFFFFFFFF
    return fmix(np.arange(1, n + 1, dtype=np.uint64) * _R + np.uint64(step))


_BYTE = randoms(256, 11)
_BYTE_LOWER = _BYTE[LOWER]
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, _CHUNK + 1)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _R)]).cumprod(dtype=np.uint64)
            _inv = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _RINV)]).cumprod(dtype=np.uint64)
    return _pow, _inv


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PIECE_BYTES of text, in order; each holds whole rows."""
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes whose mask is true, never across documents: starts, ends, and the first run of each document."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space."""
    return spans(data, offsets, ~SPACE[data])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, heads: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of ascending, disjoint spans; for each h of heads, also of a span's first h bytes (whole, if shorter)."""
    table = _BYTE_LOWER if lower else _BYTE
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(heads))]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
            seg = data[base : ends[to - 1]]
            power, inverse = _powers(len(seg) + 1)
            sums = np.empty(len(seg) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[seg] * power[: len(seg)], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            first, back = sums[s], inverse[s]
            out[0][at:to] = fmix((sums[e] - first) * back + (e - s).astype(np.uint64))
            for k, h in enumerate(heads, 1):
                cut = np.minimum(e, s + h)
                out[k][at:to] = fmix((sums[cut] - first) * back + np.uint64(h << 32))
            at = to
    return out


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for all i, end to end."""
    total = int(lengths.sum())
    if total == 0:
        return values[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return values[index]


def binary_array(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of byte runs of the given lengths out of one array."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(flat).view(np.uint8).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), data]).cast(pa.binary())
