"""Segment-wise encoding with a memo of segments already encoded.

A text is cut where every pre-tokenizer in use is sure to cut, so its ids are the
ids of its segments end to end.  Each distinct segment is encoded once per worker.
Segments of up to seven bytes are their own keys; longer ones go by a hash, and each is compared with
the bytes that the memo has under it, so one that merely shares the hash is encoded for itself.  The memo is
arrays, not Python objects, and is emptied beyond a fixed number of entries or bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pandas._libs.hashtable import UInt64HashTable, UInt64Vector

from . import flat

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PUNCT[39] = False  # an apostrophe may begin a contraction
#: Bytes that surely begin a character other than white space (C2, E1, E2 and E3 may begin Unicode spaces).
_SOLID = ~flat.SPACE
_SOLID[0x00:0x20] = False
_SOLID[0x7F:0xC3] = False
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_ASCII_SOLID = _SOLID.copy()
_ASCII_SOLID[0x80:] = False


def cuts(data: np.ndarray, offsets: np.ndarray, keep_spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment starts and ends, and the first segment of each document.

    keep_spaces: segments cover every byte and a lone space stays with the word
    behind it (byte-level BPE); else white space only parts segments.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    alpha, punct = _ALPHA[data], _PUNCT[data]
    border = np.zeros(n, bool)  # a segment begins here
    border[1:] = (alpha[1:] & punct[:-1]) | (punct[1:] & alpha[:-1])
    edges = offsets[:-1][offsets[:-1] < n]
    if not keep_spaces:
        inside = ~flat.SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | border[1:]
        begins[edges] = inside[edges]
        starts = np.flatnonzero(begins)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | border[1:]
        stop = edges[edges > 0] - 1
        last[stop] = inside[stop]
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)
    space, blank = flat.SPACE[data], data == 0x20
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = _SOLID[data[1:]]
    border |= blank & solid_next  # a lone space, or the last of a run, goes with the next word
    border[1:] |= space[1:] & _ASCII_SOLID[data[:-1]]  # a run of white space begins
    border[1:] |= _SOLID[data[1:]] & (space & ~blank)[:-1]  # behind a line break
    border[edges] = True
    starts = np.flatnonzero(border)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, offsets)


_WITHIN = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def keys_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each span, and which spans are too long for the key to hold their bytes."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", room.data, strides=(1,))  # the eight bytes from each place on
    size = (ends - starts).astype(np.uint64)
    far = np.flatnonzero(size > 7)
    keys = (eight[starts] & _WITHIN[np.minimum(size, 7)]) | (size << np.uint64(56))
    keys[far] = flat.hash_spans(data, starts[far], ends[far])[0] | np.uint64(1 << 63)
    return keys, far


class Memo:
    """ids of distinct segments, kept between batches of one worker."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 1_500_000, limit_bytes: int = 32 << 20):
        self.encode, self.dtype, self.limit, self.limit_bytes = encode, dtype, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.seen, self.count = UInt64HashTable(1 << 12), 0
        self.at, self.n, self.ids = Grown(np.int64), Grown(np.int32), Grown(self.dtype)
        self.from_, self.size, self.bytes = Grown(np.int64), Grown(np.int32), Grown(np.uint8)  # of long segments; size 0: a short one

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments end to end, and how many each segment has; lower: ASCII case makes no difference."""
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.count > self.limit or self.bytes.size > self.limit_bytes:
            self.clear()
        same = flat.LOWER[data] if lower else data
        keys, far = keys_of(same, starts, ends)
        place = self.seen.get_labels(keys, UInt64Vector(), self.count)  # numbers by first sight
        fresh = np.flatnonzero(place >= self.count)
        raw = None
        if len(fresh):
            first = np.empty(int(place.max()) + 1 - self.count, np.int64)
            first[place[fresh[::-1]] - self.count] = fresh[::-1]
            raw = data.tobytes()
            ids, counts = self.encode([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            self.at.add(self.ids.size + np.cumsum(counts) - counts)
            self.n.add(counts)
            self.ids.add(ids)
            size = ends[first] - starts[first]
            size[size < 8] = 0
            self.from_.add(self.bytes.size + np.cumsum(size) - size)
            self.size.add(size)
            self.bytes.add(flat.gather(same, starts[first], size))
            self.count += len(first)
        lengths = self.n.view()[place].astype(np.int64)
        out = flat.gather(self.ids.view(), self.at.view()[place], lengths)
        odd = self._others(same, starts[far], ends[far], place[far])
        return (out, lengths) if not len(odd) else self._spliced(far[odd], raw or data.tobytes(), starts, ends, out, lengths)

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the long segments aren't the ones that the memo has in their place."""
        size = ends - starts
        other = self.size.view()[place] != size
        alike = np.flatnonzero(~other)
        differ = flat.gather(data, starts[alike], size[alike]) != flat.gather(self.bytes.view(), self.from_.view()[place[alike]], size[alike])
        if differ.any():
            other[alike[np.searchsorted(np.cumsum(size[alike]), np.flatnonzero(differ), "right")]] = True
        return np.flatnonzero(other)

    def _spliced(self, odd: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, out: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """out and lengths with segments odd encoded for themselves."""
        own, counts = self.encode([raw[s:e] for s, e in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
        room, at = np.concatenate([out, own.astype(out.dtype)]), np.cumsum(lengths) - lengths
        at[odd], lengths = len(out) + np.cumsum(counts) - counts, lengths.copy()
        lengths[odd] = counts
        return flat.gather(room, at, lengths), lengths


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.room, self.size = np.zeros(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(max(need, 2 * len(self.room)) - self.size, self.room.dtype)])
        self.room[self.size : need] = more
        self.size = need

    def view(self) -> np.ndarray:
        return self.room[: self.size]
