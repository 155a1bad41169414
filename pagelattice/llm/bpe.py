"""Byte-pair encoding by speculation and verification, and decoding (operator 9).

Greedy longest match proposes tokens for each distinct pre-token.  Merge order
decides whether a proposal is what byte-pair merging gives: it is exactly when every
adjacent pair of tokens is compatible, i.e. merging the two tokens' bytes alone ends
in these two tokens.  Pairs are tested together in numpy by undoing, from both sides of
the border, the latest merge first and looking for a merge across the border that would
have come earlier.  Only pre-tokens with an incompatible pair are merged exactly.

Defined results: a null text counts as empty (no ids, both digests of nothing); a
special token's string in a text becomes its id, as the tokenizers library does; repeated rows and ids give a row each;
an empty table gives no rows; extra columns, also those named like the result's, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .coder import Memo, cuts

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_workers: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level vocabulary: ids of texts and bytes of ids."""

    def __init__(self, vocab_path: str):
        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        # rank of the merge that makes a token (-1: a byte), and the two halves it joins
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[int, tuple[int, int]] = {}
        self.size = size
        pair_keys, pair_ranks, pair_made = [], [], []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (vocab[bytes(alphabet[c] for c in s)] for s in (a, b))
            made = vocab[self.bytes_of[x] + self.bytes_of[y]]
            self.merge[x * size + y] = (r, made)
            pair_keys.append(x * size + y)
            pair_ranks.append(r)
            pair_made.append(made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        order = np.argsort(pair_keys)
        self.pair_keys, self.pair_ranks = np.asarray(pair_keys)[order], np.asarray(pair_ranks)[order]
        # tokens that merging their own bytes gives; only these are proposed
        inner = np.flatnonzero(self.rank >= 0)
        whole = self.compatible(self.left[inner], self.right[inner], self.rank[inner])
        sound = {int(i) for i in inner[whole]} | set(self.byte_id)
        for i in inner.tolist():  # halves come before wholes
            if i in sound and not (int(self.left[i]) in sound and int(self.right[i]) in sound):
                sound.discard(i)
        self.known = {b: i for b, i in vocab.items() if i in sound}
        self.longest = max(map(len, self.known))
        self.reach: dict[bytes, int] = {}  # longest token that begins with these two bytes
        for b in self.known:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 0), len(b))
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = Memo(self.encode_segments, np.uint16 if size <= 1 << 16 else np.uint32)
        self.table = pa.array(self.bytes_of, pa.large_binary())
        self.decimal = pa.array([f"{i},".encode() for i in range(size)], pa.large_binary())

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether byte-pair merging leaves the border between tokens a and b alone (below the given merge ranks).

        Each side's token is undone into its halves, the later merge first; of ties the right
        token's is undone first, since equal merges run from the left.  The border would vanish if a
        merge across it came before the merge that was last undone.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        # times are doubled so that "the same merge, further right" has a place of its own
        bound = np.full(len(a), 2 * len(self.pair_keys) + 2) if limit is None else 2 * np.asarray(limit, np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], bound[live]
            key = x * self.size + y
            spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[spot] == key, 2 * self.pair_ranks[spot], np.iinfo(np.int64).max)
            bad = across < top
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = bad | ((rx < 0) & (ry < 0))
            undo_left = rx > ry
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            bound[live] = np.minimum(top, np.where(undo_left, 2 * rx, 2 * ry + 1))
            live = live[~done]
        return good

    def exact(self, raw: bytes) -> list[int]:
        """Byte-pair merging as defined: the earliest merge first, the leftmost of equals."""
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        get, size = self.merge.get, self.size
        heap = [(got[0], i, ids[i], ids[i + 1], got[1]) for i in range(n - 1) if (got := get(ids[i] * size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if got := get(made * size + ids[after[i]]):
                    heapq.heappush(heap, (got[0], i, made, ids[after[i]], got[1]))
            if (h := before[i]) >= 0 and (got := get(ids[h] * size + made)):
                heapq.heappush(heap, (got[0], h, ids[h], made, got[1]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def greedy(self, raw: bytes) -> list[int]:
        known, reach, byte_id = self.known, self.reach, self.byte_id
        out, at, n = [], 0, len(raw)
        while at < n:
            for to in range(min(n, at + reach.get(raw[at : at + 2], 1)), at, -1):
                if (i := known.get(raw[at:to])) is not None:
                    out.append(i)
                    at = to
                    break
            else:
                out.append(byte_id[raw[at]])
                at += 1
        return out

    def encode_pretokens(self, words: list[bytes]) -> list[list[int]]:
        proposed = [[i] if (i := self.known.get(w)) is not None else self.greedy(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ids = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
        if len(ids) < 2:
            return proposed
        owner = np.repeat(np.arange(len(words)), counts)
        joint = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(ids[joint] * self.size + ids[joint + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        for k in np.unique(owner[joint[~fits[back]]]).tolist():
            proposed[k] = self.exact(words[k])
        return proposed

    def encode_segments(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of text segments, end to end, and their counts."""
        place: dict[bytes, int] = {}
        parts: list[list[int]] = []
        for raw in segments:
            text = raw.decode()
            if (text[1:] if text[0] == " " else text).isalpha() and text.isascii():
                parts.append([place.setdefault(raw, len(place))])
            else:
                parts.append([place.setdefault(p.encode(), len(place)) for p in self.pattern.findall(text)])
        coded = self.encode_pretokens(list(place))
        lists = [coded[p[0]] if len(p) == 1 else [i for k in p for i in coded[k]] for p in parts]
        return np.fromiter((i for x in lists for i in x), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and how many each has."""
        texts = pc.fill_null(texts, "")
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        parts, owner, mark = texts, None, None
        if odd.any():  # cut such texts at the special tokens and code what lies between
            cut: list[str] = []
            owner, mark = [], []
            for k, text in enumerate(texts.to_pylist()):
                for p in self.splitter.split(text) if odd[k] else [text]:
                    special = self.special.get(p) if odd[k] else None
                    owner.append(k)
                    mark.append(-1 if special is None else special)
                    cut.append(p if special is None else "")
            parts = pa.array(cut, pa.large_string())
        data, offsets = flat.buffers(parts)
        starts, ends, first = cuts(data, offsets, keep_spaces=True)
        ids, per_segment = self.memo(data, starts, ends, lower=False)
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_segment)])
        counts = np.diff(done[first])
        if owner is None:
            return ids, counts
        mark_, owner_ = np.asarray(mark), np.asarray(owner)
        found = mark_ >= 0
        all_counts = counts + found
        out = np.empty(int(all_counts.sum()), ids.dtype)
        at = np.cumsum(all_counts) - all_counts
        hole = np.zeros(len(out), bool)
        hole[at[found]] = True
        out[hole], out[~hole] = mark_[found], ids
        return out, np.bincount(owner_, all_counts, len(texts)).astype(np.int64)

    def joined(self, table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The table's entries for the ids end to end, and where each document's end."""
        got = table.take(pa.array(ids))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1]
        return memoryview(got.buffers()[2] or b""), offsets[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[str]:
        """Each document's text again; bytes that are no UTF-8 become U+FFFD."""
        data, at = self.joined(self.table, ids, counts)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield bytes(data[s:e]).decode("utf-8", "replace")


def coder(vocab_path: str) -> ByteBPE:
    if vocab_path not in _workers:
        _workers[vocab_path] = ByteBPE(vocab_path)
    return _workers[vocab_path]


def _map(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(doc ids, texts) -> columns, piece by piece over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.pieces(batch):
                if piece.num_rows:
                    yield make(piece.column(0), piece.column(1))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): every text encoded and its ids decoded again."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def make(doc_ids, texts):
        own = coder(vocab_path)
        ids, counts = own.encode(texts)
        decimals, at = own.joined(own.decimal, ids, counts)
        of_ids = [hashlib.sha256(decimals[s : max(s, e - 1)]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        decoded = [hashlib.sha256(text.encode()).hexdigest() for text in own.decode(ids, counts)]
        columns = [doc_ids, pa.array(counts), pa.array(of_ids), pa.array(decoded)]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _map(docs.withColumn("doc_id", F.col("doc_id").cast("long")), make, schema)
