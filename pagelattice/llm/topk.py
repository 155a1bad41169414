"""Exact top-k search by inner product, a term at a time (operator 6).

A vector's components, times ``scale`` (a power of two) and rounded down, are the weights of
its terms.  Candidates and queries are dealt into blocks of bounded size; a block of candidates is an
inverted index (for each term the candidates that have it and their weights), a block of
queries is sparse rows.  Each query's weights scatter the weighted postings into a dense
array of scores, a partition selection takes its k best, and the blocks' answers are
merged.  Every query meets every candidate, block by block: the work is their product,
nothing is broadcast, and a task holds one block of either kind.

Scores are exact for components of any size: where the largest weights and the number of terms
prove that 64 bits hold every sum, weights are 64-bit integers; else weights are cut into
digits of 24 bits, each pair of digits is a pass of its own, and the passes are added up as
integers without bound.  Candidates with large weights have an index of their own, so they don't
slow down the others.  Answers are ranked by the exact score; a score that a long can't hold is given as the
nearest long.

Defined results: a vector that is null or holds a null or non-finite component takes no
part; terms beyond the shorter vector count 0; equal scores go by the smaller id, null
last; rows that repeat an id are queries and candidates each, and a query's own row alone is no candidate of
it; without candidates a query has no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK = 32_768
QUERY_BLOCK = 8192
#: Bits of a digit: a sum of 16,384 products of two digits fits 62 bits; more terms than that take the smaller digit.
DIGIT, SMALL_DIGIT = 24, 14
#: Candidates whose weights are all below this share the first index of a block.
PLAIN = 1 << 20
_SAFE, _LAST = 1 << 62, (1 << 63) - 1


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def digits(values: np.ndarray, scale: int, bits: int) -> list[np.ndarray]:
    """floor(scale * values) as signed digits of so many bits, the least first."""
    size, whole = np.abs(values), np.zeros(len(values), np.uint64)
    near = size < _SAFE / 2 / scale
    floor = np.floor(values[near] * scale)
    sign = np.where(values < 0, -1, 1)
    whole[near] = np.abs(floor).astype(np.uint64)
    mantissa, power = np.frexp(np.where(near, 0.0, size))
    shift = np.where(near, 0, power - 53 + scale.bit_length() - 1).astype(np.int64)  # far ones are integers already
    whole[~near] = (mantissa[~near] * 2.0**53).astype(np.uint64)
    out, mask = [], np.uint64((1 << bits) - 1)
    top = int(shift.max(initial=0)) + 64
    for low in range(0, top, bits):
        right, left = np.clip(low - shift, 0, 63).astype(np.uint64), np.clip(shift - low, 0, 63).astype(np.uint64)
        part = ((whole >> right) << left) & mask
        part[(low - shift > 63) | (shift - low >= bits)] = 0
        out.append(part.astype(np.int64) * sign)
    while len(out) > 1 and not out[-1].any():
        out.pop()
    return out


class Rows:
    """Sparse rows of a block of vectors."""

    def __init__(self, block: pa.Table, scale: int):
        block = block.combine_chunks()
        lists = pa.concat_arrays(block.column("weights").chunks)
        values = lists.flatten().to_numpy().astype(float)
        lengths = np.diff(np.asarray(lists.offsets))
        row = np.repeat(np.arange(len(lengths)), lengths)
        term = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        has = (values < 0) | (values * scale >= 1)
        self.scale, self.n, self.terms = scale, len(lengths), int(lengths.max(initial=0))
        self.row, self.term, self.value = row[has], term[has], values[has]
        self.ids = block.column("vec_id").to_pylist()
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.own = block.column("row").to_numpy()

    def largest(self) -> np.ndarray:
        """A bound of each row's weights, in floating point."""
        out = np.zeros(self.n)
        np.maximum.at(out, self.row, np.abs(self.value))
        return out * self.scale + 1


class Index:
    """Postings of some candidates of a block; digits of their weights are made when first asked for."""

    def __init__(self, rows: Rows, chosen: np.ndarray):
        number = np.full(rows.n, -1)
        number[chosen] = np.arange(len(chosen))
        mine = np.flatnonzero(number[rows.row] >= 0)
        mine = mine[np.argsort(rows.term[mine], kind="stable")]
        self.rows, self.chosen, self.n = rows, chosen, len(chosen)
        self.row, self.term, self.value = number[rows.row[mine]], rows.term[mine], rows.value[mine]
        self.bounds = np.searchsorted(self.term, np.arange((int(self.term[-1]) if len(self.term) else -1) + 2))
        self.largest = float(np.abs(self.value).max(initial=0.0)) * rows.scale + 1
        self.made: dict[int, list[np.ndarray]] = {}

    def weights(self, bits: int) -> list[np.ndarray]:
        """The postings' weights as digits, or whole (bits 0)."""
        if bits not in self.made:
            scaled = lambda: [np.floor(self.value * self.rows.scale).astype(np.int64)]
            self.made[bits] = digits(self.value, self.rows.scale, bits) if bits else scaled()
        return self.made[bits]

    def scatter(self, terms: np.ndarray, weights: np.ndarray, postings: np.ndarray) -> np.ndarray:
        """Dense scores of all candidates: a term at a time."""
        scores = np.zeros(self.n, np.int64)
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            if weight and term + 1 < len(self.bounds):
                s, e = self.bounds[term], self.bounds[term + 1]
                scores[slice(None) if e - s == self.n else self.row[s:e]] += weight * postings[s:e]
        return scores

    def best(self, k: int, terms: np.ndarray, values: np.ndarray, dims: int, own: int) -> list[tuple[int, int]]:
        """(score, row) of the k best for a query, the query's own row left out."""
        scale, order = self.rows.scale, self.rows.order
        rivals = np.flatnonzero(self.rows.own[self.chosen] != own)
        most = (float(np.abs(values).max(initial=0.0)) * scale + 1) * self.largest * max(1, dims)
        if most < _SAFE:
            scores = self.scatter(terms, np.floor(values * scale).astype(np.int64), self.weights(0)[0])
            if len(rivals) > k:  # all that reach the k-th best score, then ties by id
                floor = np.partition(scores[rivals], len(rivals) - k)[len(rivals) - k]
                rivals = rivals[scores[rivals] >= floor]
            best = rivals[np.lexsort((order[self.chosen[rivals]], -scores[rivals]))[:k]]
            return [(int(scores[i]), int(self.chosen[i])) for i in best.tolist()]
        bits = DIGIT if dims <= 1 << (62 - 2 * DIGIT) else SMALL_DIGIT
        sums: dict[int, np.ndarray] = {}
        for (i, a), (j, b) in product(enumerate(digits(values, scale, bits)), enumerate(self.weights(bits))):
            if a.any() and b.any():
                part = self.scatter(terms, a, b).astype(object)
                sums[i + j] = sums[i + j] + part if i + j in sums else part
        scores = sum((part * (1 << (bits * at)) for at, part in sums.items()), np.zeros(self.n, object))
        return heapq.nsmallest(k, ((int(scores[i]), int(self.chosen[i])) for i in rivals.tolist()), key=lambda x: (-x[0], order[x[1]]))


def beyond(score: int) -> bytes:
    """Orders scores that a long can't hold, as its bytes do; one value for all others."""
    if -_LAST - 1 <= score <= _LAST:
        return b"\x80"
    size = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    size = len(size).to_bytes(2, "big") + size
    return b"\xff" + size if score > 0 else b"\x00" + bytes(255 - x for x in size)


_FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])


def _search(k: int, scale: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _FOUND]
        if candidates.num_rows and queries.num_rows:
            rows, asked = Rows(candidates, scale), Rows(queries, scale)
            large = rows.largest() > PLAIN
            indexes = [Index(rows, chosen) for chosen in (np.flatnonzero(~large), np.flatnonzero(large)) if len(chosen)]
            begins = np.searchsorted(asked.row, np.arange(asked.n + 1))
            dims = min(rows.terms, asked.terms)
            for q in range(asked.n):
                mine = slice(begins[q], begins[q + 1])
                found = [x for index in indexes for x in index.best(k, asked.term[mine], asked.value[mine], dims, int(asked.own[q]))]
                if len(indexes) > 1:
                    found = sorted(found, key=lambda x: (-x[0], rows.order[x[1]]))[:k]
                for score, i in found:
                    for column, value in zip(out, (int(asked.own[q]), asked.ids[q], rows.ids[i], max(-_LAST - 1, min(_LAST, score)), beyond(score)), strict=True):
                        column.append(value)
        return pa.table([pa.array(x, f.type) for x, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score for vectors(vec_id, weights array<double>), all finite, where queries holds."""
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), F.coalesce(queries, F.lit(False)).alias("asked"), F.col("vec_id").cast("long").alias("vec_id"), F.col("weights").cast("array<double>").alias("weights"))
    # written once, so that a row has one number on either side
    vectors = Scratch(vectors.sparkSession, "topk").table(numbered, "vectors")
    asked = vectors.where("asked")
    n, n_asked = vectors.count(), asked.count()
    blocks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK))
    groups = max(1, -(-n_asked // QUERY_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("row", "vec_id", "weights", (own(blocks) if blocks > 1 else F.lit(0)).alias("block"), every(groups).alias("group"))
    # attributes of its own: else the right side's are mistaken for the left's and pruned
    right = asked.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "weights")], every(blocks).alias("block"), own(groups).alias("group"))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(_search(k, scale), "query long, query_id long, vec_id long, score long, beyond binary")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
