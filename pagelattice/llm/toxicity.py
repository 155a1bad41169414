"""Toxic spans by a linear-chain conditional random field (operator 4).

Only documents are labelled, so token labels are drawn from them: a form of a token
(the token itself or one of its beginnings) is indicative if it is found in many toxic
texts of the fitting sample and hardly in others; tokens of toxic texts with an
indicative form are labelled toxic, all others clean.  A two-state chain over hashed
forms is fitted to these labels by gradient descent on its exact likelihood.

Scoring runs forward-backward over every token of every whole text.  Tokens whose
marginal is at least a half are the offending spans, given in code points.  A text's
score is a logistic function of the sum and the maximum of its marginals, fitted on the
same sample.

The sample is bounded: at most ``fit_docs`` labelled texts of either label, each of at
most ``fit_chars`` code points, taken in the order of a hash of doc_id; scoring has no bound.

Defined results: a null or empty text has no token and scores like a text of clean
tokens; null labels and rows to be held out are never fitted; without labelled texts
of both kinds every score is 0; repeated rows score alike; an empty table gives no rows; extra columns, also those
named like the result's, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .neardup import distinct, minima, shingle_hashes

HEADS = (3, 4, 5, 6)
BITS = 18
FAINT = 0.05
#: Chains of more than LONG tokens are worked through in stretches of so many, all abreast.
LONG, STRETCH = 2048, 256
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


@dataclass
class Model:
    weights: np.ndarray  # of a form's bucket, for the toxic state
    bias: float
    moves: np.ndarray  # [from, to] log potentials
    head: np.ndarray  # logistic: constant, log of the sum, maximum


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens are runs of letters and digits: bytes, starts, ends, first token of each text, hashed forms (a row a form)."""
    data, offsets = flat.buffers(texts)
    starts, ends, first = flat.spans(data, offsets, _TOKEN[data])
    forms = np.stack(flat.hash_spans(data, starts, ends, lower=True, heads=HEADS))
    return data, starts, ends, first, forms


def buckets(forms: np.ndarray) -> np.ndarray:
    return (forms >> np.uint64(64 - BITS)).astype(np.int32)


def _short_chains(e: np.ndarray, start: np.ndarray, length: np.ndarray, m: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> None:
    """Forward and backward odds of the toxic state; chains run abreast, the longest first, a step at a time."""
    m00, m01, m10, m11 = m.ravel()
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # chains of at least t tokens
    ahead[start] = odds = e[start]
    for t in range(1, int(length[0])):
        at, odds = start[: alive[t]] + t, odds[: alive[t]]
        ahead[at] = odds = e[at] * (m01 + odds * m11) / (m00 + odds * m10)
    for t in range(int(length[0]) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        nxt = e[at + 1] * behind[at + 1]
        behind[at] = (m10 + m11 * nxt) / (m00 + m01 * nxt)


def _long_chains(e: np.ndarray, start: np.ndarray, length: np.ndarray, m: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> None:
    """The same for chains of many tokens: products of 2 by 2 matrices over the stretches of all chains abreast, then a step a stretch, then all stretches abreast.

    A step takes odds x to (c + d x) / (a + b x), whose matrices are positive; they are scaled as they are multiplied.
    """
    m00, m01, m10, m11 = m.ravel()
    rows = -(-(length - 1) // STRETCH)
    chain = np.repeat(np.arange(len(start)), rows)
    row = np.arange(len(chain)) - np.repeat(np.cumsum(rows) - rows, rows)
    step = (row * STRETCH)[:, None] + np.arange(STRETCH)[None]
    real = step < (length[chain] - 1)[:, None]  # the rest change nothing
    step = np.where(real, step, 0)

    def sweep(at: np.ndarray, swap: bool, first: np.ndarray) -> np.ndarray:
        """Odds after every step; at: the token whose odds of emission the step takes."""
        x = e[at]
        a, d = np.where(real, m00, 1.0), np.where(real, m11 * x, 1.0)
        b, c = (np.where(real, m01 * x, 0.0), np.where(real, m10, 0.0)) if swap else (np.where(real, m10, 0.0), np.where(real, m01 * x, 0.0))
        whole = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), len(chain), axis=1)
        for k in range(STRETCH):
            p, q, r, t = whole
            whole = np.stack([a[:, k] * p + b[:, k] * r, a[:, k] * q + b[:, k] * t, c[:, k] * p + d[:, k] * r, c[:, k] * q + d[:, k] * t])
            whole /= whole.sum(axis=0)
        begin, now = np.empty(len(chain)), 0.0
        for k, (p, q, r, t, new, own) in enumerate(zip(*whole.tolist(), (row == 0).tolist(), first[chain].tolist(), strict=True)):
            begin[k] = now = own if new else now
            now = (r + t * now) / (p + q * now)
        out, now = np.empty(a.shape), begin
        for k in range(STRETCH):
            out[:, k] = now = (c[:, k] + d[:, k] * now) / (a[:, k] + b[:, k] * now)
        return out[real]

    forward = (start[chain] + 1)[:, None] + step
    ahead[start] = e[start]
    ahead[forward[real]] = sweep(forward, False, e[start])
    backward = (start[chain] + length[chain] - 1)[:, None] - step  # x_t = (m10 + m11 e x) / (m00 + m01 e x), of the token behind
    behind[backward[real] - 1] = sweep(backward, True, np.ones(len(start)))


def marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray, counts: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """Forward-backward over chains laid end to end.

    emit: log odds of the toxic state at each token.  Returns the toxic
    marginals and, if counts, the sum of the log partition functions and the expected
    counts of moves (else 0).
    """
    n = np.diff(first)
    p, expected, z = np.zeros(len(emit)), np.zeros((2, 2)), 0.0
    if not n.any():
        return p, z, expected
    top = float(moves.max())
    m = np.exp(moves - top)
    e = np.exp(np.clip(emit, -40, 40))
    ahead, behind = np.empty(len(emit)), np.ones(len(emit))
    for chosen, run in ((n > LONG, _long_chains), ((n > 0) & (n <= LONG), _short_chains)):
        if chosen.any():
            run(e, first[:-1][chosen], n[chosen], m, ahead, behind)
    both = ahead * behind
    p = both / (1 + both)
    if not counts:
        return p, z, expected
    start = first[:-1][n > 0]
    inner = np.ones(len(emit), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    m00, m01, m10, m11 = m.ravel()
    z = float(np.log1p(ahead[start]).sum())
    if len(at):
        f = ahead[at - 1]
        z += float((np.log(m00 + f * m10 + (m01 + f * m11) * e[at]) - np.log1p(f)).sum()) + len(at) * top
    if len(at):  # joint of neighbours
        f, g = ahead[at - 1], e[at] * behind[at]
        joint = np.stack([np.full(len(at), m00), m01 * g, f * m10, f * m11 * g])
        joint /= joint.sum(axis=0)
        expected = joint.sum(axis=1).reshape(2, 2)
    return p, z, expected


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: 1, the log of the sum of its marginals (what clean tokens have, FAINT, taken off), their maximum."""
    out = np.zeros((len(first) - 1, 3))
    out[:, 0], out[:, 1] = 1, np.log(0.3)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full, 1] = np.log(0.3 + np.add.reduceat(np.maximum(p - FAINT, 0), first[full]))
        out[full, 2] = np.maximum.reduceat(p, first[full])
    return out


def without_copies(texts: list[str]) -> list[int]:
    """Places of texts that are no near copies of earlier ones: words of a copied text would seem to be in many."""
    hashes, bounds = distinct(*shingle_hashes(*flat.buffers(pa.array(texts, pa.large_string())), 3))
    pairs = minima(hashes, bounds, 20).view(np.uint32)  # two 16-bit lanes each
    seen, out = set(), []
    for k, row in enumerate(pairs.tolist()):
        keys = set(enumerate(row)) if bounds[k + 1] > bounds[k] else set()
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


def fit(texts: list[str], toxic: np.ndarray, steps: int = 60, seed: int = 3) -> Model:
    """Fits the chain and the score on labelled texts, near copies counted once."""
    kept = without_copies(texts) if texts else []
    texts, toxic = [texts[k] for k in kept], toxic[kept]
    empty = Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros((2, 2)), np.array([-40.0, 0.0, 0.0]))
    if not len(texts) or toxic.min() == toxic.max():
        return empty
    first, forms = tokens(pa.array(texts, pa.large_string()))[3:]
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())
    marks, ids = np.zeros(len(owner), bool), np.empty(forms.shape, np.int32)
    for k, row in enumerate(forms):  # by how many texts of either label is a form used
        ids[k] = buckets(row)
        kinds, code = np.unique(row, return_inverse=True)
        seen = np.unique(code.astype(np.int64) * len(texts) + owner)
        kind, whose = seen // len(texts), toxic[seen % len(texts)]
        a, b = np.bincount(kind, whose, len(kinds)), np.bincount(kind, 1 - whose, len(kinds))
        rate_a, rate_b = a / n_toxic, (b + 0.5) / n_clean
        marks |= ((a >= max(5, min(15, n_toxic / 40))) & (rate_a >= 12 * rate_b))[code]
    del forms, row
    y = marks & (toxic[owner] == 1)
    weights, moves, bias = np.zeros(1 << BITS), np.zeros((2, 2)), -4.0
    sq_w, sq_m, sq_b = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    size = min(len(texts), 256)
    for _ in range(steps):  # AdaGrad on the exact gradient of a batch
        pick = np.sort(rng.choice(len(texts), size, replace=False))
        lengths = np.diff(first)[pick]
        at = flat.gather(np.arange(len(owner), dtype=np.int64), first[pick], lengths)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        if not len(at):
            continue
        x, want = ids[:, at], y[at].astype(float)
        p, _, expected = marginals(weights[x].sum(axis=0) + bias, bounds, moves)
        slope = (p - want) / size
        g = np.bincount(x.ravel(), np.tile(slope, len(x)), 1 << BITS) + 1e-6 * weights
        sq_w += g * g
        weights -= 0.5 * g / np.sqrt(sq_w)
        inner = np.ones(len(at), bool)
        inner[bounds[:-1][lengths > 0]] = False
        k = np.flatnonzero(inner)
        observed = np.bincount((2 * want[k - 1] + want[k]).astype(int), minlength=4).reshape(2, 2)
        gm, gb = (expected - observed) / size, float(slope.sum())
        sq_m += gm * gm
        sq_b += gb * gb
        moves -= 0.1 * gm / np.sqrt(sq_m)
        bias -= 0.1 * gb / np.sqrt(sq_b)
    model = Model(weights.astype(np.float32), bias, moves, np.zeros(3))
    p, _, _ = marginals(model.weights[ids].sum(axis=0) + bias, first, moves, counts=False)
    x, head = summary(p, first), np.zeros(3)
    for _ in range(40):  # Newton's method with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ head, -40, 40)))
        hessian = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(3)
        head -= np.linalg.solve(hessian, x.T @ (q - toxic) + 0.1 * head)
    model.head = head
    return model


def fit_from(docs: DataFrame, labels: DataFrame, fit_docs: int = 2000, fit_chars: int = 20_000) -> Model:
    """Fits on texts of docs(doc_id, text) whose label labels(doc_id, toxic) gives, at most fit_docs of either label.

    The ids are chosen from the labels alone, by a hash, so only these few (bounded by fit_docs) meet the documents.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    ids = [known.where(F.col("y") == k).orderBy("h", "_id").limit(fit_docs) for k in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids[0].unionByName(ids[1])), F.col("doc_id") == F.col("_id")).where(F.length("text").between(1, fit_chars))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "text"))
    rows = rows.withColumn("place", place).where(F.col("place") <= fit_docs).select("text", "y")  # one scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)})  # copies count once
        m = fit([t for t, _ in got], np.array([y for _, y in got], float))
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (m.weights, np.array([m.bias]), m.moves, m.head)]
        yield pa.RecordBatch.from_arrays(parts, ["weights", "bias", "moves", "head"])

    # a worker fits, so the driver holds the model (1 MB) and no text
    found = rows.coalesce(1).mapInArrow(run, "weights binary, bias binary, moves binary, head binary").first()
    if found is None:
        return fit([], np.zeros(0))
    weights, bias, moves, head = (np.frombuffer(x, kind) for x, kind in zip(found, (np.float32, float, float, float), strict=True))
    return Model(weights, float(bias[0]), moves.reshape(2, 2), head)


def _scored(texts: pa.Array, m: Model) -> tuple:
    """Scores of the texts; their bytes, token starts and ends, first tokens, and the tokens' marginals."""
    data, starts, ends, first, forms = tokens(texts)
    emit = np.full(len(starts), m.bias)
    for row in forms:
        emit += m.weights[buckets(row)]
    p, _, _ = marginals(emit, first, m.moves, counts=False)
    return 1 / (1 + np.exp(-np.clip(summary(p, first) @ m.head, -40, 40))), data, starts, ends, first, p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds to docs(doc_id, text) its score and spans (start and end in code points of each token that is toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.pieces(batch):
                if not piece.num_rows:
                    continue
                values, data, starts, ends, first, p = _scored(piece.column(1), shared.value)
                hot = np.flatnonzero(p >= 0.5)
                chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)]) if len(hot) else np.zeros(1, np.int64)
                _, offsets = flat.buffers(piece.column(1))
                owner = np.searchsorted(first, hot, "right") - 1
                base = chars[offsets[owner]] if len(hot) else np.zeros(0, np.int64)
                inner = pa.StructArray.from_arrays([pa.array(((chars[x[hot]] if len(hot) else base) - base).astype(np.int32)) for x in (starts, ends)], names=["start", "end"])
                counts = np.bincount(owner, minlength=piece.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), inner).cast(spans_type)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(values), lists], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in flat.pieces(batch):
                if piece.num_rows:
                    values = _scored(piece.column(piece.schema.get_field_index("text")), shared.value)[0]
                    yield piece.filter(pa.array(values < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """doc_id, score and spans of every document, by a model fitted on the labelled rows that are not held out."""
    return score(docs, fit_from(docs, labels.where(~held_out()), **limits))
