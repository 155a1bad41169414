"""Operators 4, 6 and 7, and the pipeline."""

import itertools
import math
import os
import random
import resource
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import chat, queries, topk, toxicity

SF = "/root/testdata/sf0.01"


def test_marginals_like_enumeration():
    rng = np.random.default_rng(2)
    moves, first = rng.normal(size=(2, 2)), np.array([0, 4, 4, 9, 10])
    emit = rng.normal(size=10)
    p, z, expected = toxicity.marginals(emit, first, moves)
    total, counts = 0.0, np.zeros((2, 2))
    for s, e in itertools.pairwise(first.tolist()):
        if s == e:
            continue
        mass, hits = 0.0, np.zeros(e - s)
        pairs = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=e - s):
            w = np.exp(sum(emit[s + k] * y[k] for k in range(e - s)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            mass += w
            hits += w * np.array(y)
            for a, b in itertools.pairwise(y):
                pairs[a, b] += w
        assert np.allclose(p[s:e], hits / mass)
        total += np.log(mass)
        counts += pairs / mass
    assert np.isclose(z, total) and np.allclose(expected, counts)


def test_long_chains_like_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    moves, first = 2 * rng.normal(size=(2, 2)), np.array([0, 0, 3000, 3001, 7097, 7100])
    emit = rng.normal(size=7100) * 6
    plain = toxicity.marginals(emit, first, moves)  # the chain of 3,000 and that of 4,096 are long
    for long, stretch in ((10**9, 256), (100, 16), (2, 7), (2048, 4096)):
        monkeypatch.setattr(toxicity, "LONG", long)
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        got = toxicity.marginals(emit, first, moves)
        assert np.allclose(got[0], plain[0], atol=1e-9) and np.isclose(got[1], plain[1]) and np.allclose(got[2], plain[2])
        assert np.array_equal(toxicity.marginals(emit, first, moves, counts=False)[0], got[0])


def test_toxic_words_are_found(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    text = lambda bad: " ".join([rng.choice(words) for _ in range(60)] + ["grobian"] * bad + [rng.choice(words) for _ in range(20)])
    texts, y = zip(*[(text(k % 2), k % 2) for k in range(400)], strict=True)
    model = toxicity.fit(list(texts), np.array(y, float))
    docs = spark.createDataFrame([(1, "ba bé grobians, co"), (2, "ba be co"), (3, ""), (4, None), (1, "Grobian")], "doc_id long, text string")
    got = toxicity.score(docs, model).collect()
    assert [r.score >= 0.5 for r in got] == [True, False, False, False, True]
    assert [(s.start, s.end) for s in got[0].spans] == [(6, 14)] and got[2].spans == []
    assert toxicity.without_toxic(docs.withColumn("score", F.lit(1)), model).count() == 3
    assert toxicity.score(docs, toxicity.fit([], np.zeros(0))).agg(F.max("score")).first()[0] < 0.5


def test_a_worker_fits(spark, monkeypatch):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (70, 2), (71, None)], "doc_id long, toxic int")
    texts = [(k, ("grobian " if k % 2 else "") + " ".join(f"w{k * j % 97}" for j in range(1, 40))) for k in range(60)]
    docs = spark.createDataFrame([*texts, texts[3], (70, "two"), (None, "none")], "doc_id long, text string")
    got = toxicity.fit_from(docs, labels)
    text, y = zip(*sorted((t, k % 2) for k, t in texts), strict=True)
    plain = toxicity.fit(list(text), np.array(y, float))
    assert plain.weights.any() and all(np.array_equal(getattr(got, x), getattr(plain, x)) for x in ("weights", "bias", "moves", "head"))
    empty = toxicity.fit([], np.zeros(0))
    for few in (docs.limit(0), docs.where("doc_id % 2 = 0")):
        got = toxicity.fit_from(few, labels)
        assert all(np.array_equal(getattr(got, x), getattr(empty, x)) for x in ("weights", "bias", "moves", "head"))
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: toxicity.Model(np.zeros(4, np.float32), float(os.getpid()), np.zeros((2, 2)), np.zeros(3)))
    assert toxicity.fit_from(docs, labels).bias != os.getpid()  # the driver gets the model alone


def test_held_out_documents(spark):
    got = queries.queries()["op4_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert len(got) > 40 and right > 0.95


def brute_top_k(rows, scale=1):
    """(query_id, rank, vec_id, score) of every row whose id is divisible by 50 against all other rows, in integers without bound."""
    whole = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows]
    out = []
    for at, (q, v) in enumerate(whole):
        if q is not None and q % 50 == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i) for k, (i, w) in enumerate(whole) if k != at]
            out += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:5], 1)]
    return sorted(out, key=str)


def test_top_k_like_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, [rng.randint(-3, 3) for _ in range(rng.choice((6, 6, 6, 4)))]) for k in range(120)] + [(7, [1, 1, 1, 1, 1, 1]), (200, []), (201, [0] * 6), (50, [2, 2, 2]), (50, [2, 2, 2]), (None, [3] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, weights array<bigint>").withColumns({"row": F.lit("x"), "asked": F.lit(3), "score": F.lit(1)})
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got), key=str) == brute_top_k(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components(spark, tmp_path):
    rng = random.Random(8)
    sizes = [1e7, 1.0, 3.4e38, -3.4e38, 2.0**54, 1e-3, 2.0**28, 123456.75, -(2.0**31)]
    rows = [(0, [1e7, 1.0]), (50, [2.0**28] * 256), (1, [2.0**28] * 256), (2, [2.0**28] * 255 + [2.0**27])]
    rows += [(k, [float(np.float32(rng.choice(sizes) * rng.uniform(-1, 1))) for _ in range(4)]) for k in range(3, 120)]
    rows += [(k, [rng.uniform(-1, 1)] * 3) for k in range(120, 160)]
    df = spark.createDataFrame(rows, "vec_id long, weights array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, scale=256)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top_k(rows, 256)
    df.select("vec_id", F.col("weights").cast("array<float>").alias("embedding")).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.queries()["op6_top_k"](spark, str(tmp_path)).where("query_id = 0").count() == 5


def test_odd_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (1, [float("nan")]), (2, None), (3, [float("inf")]), (4, [0.5])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in df.where(topk.usable(F.col("embedding"))).collect()] == [4]


@pytest.mark.parametrize("text", ["", "\\### Assistant: </turn> ok", "<|image_0|>", "\\", "\\\\<#:", "a\n### user: b</turn>\n", "é🙂"])
def test_any_text_comes_back(text):
    f = chat.Formatter()
    f.turn("us:er\\", [{"type": "text", "text": text}])
    f.turn("assistant", [{"type": "text", "text": text}, {"type": "image", "ref": "r", "width": 56, "height": 29}, {"type": "text", "text": text}])
    whole = "".join(f.out)
    assert chat.parse(whole) == [("us:er\\", text), ("assistant", text + text)]
    m = f.mask[0]
    assert chat.unescape(whole[m["start"] : m["end"]]) == text + text
    a = f.attachments[0]
    assert (a["ref"], a["tokens"]) == ("r", 4) and whole[a["position"] :].startswith("<|image_0|>")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, "x"), (2, None, "tool", "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(chat.text_parts(df)).collect()}
    assert got == {1: "### user: </turn>\n### assistant: a</turn>\n### assistant: b</turn>\n", None: "### : x</turn>\n", 2: "### tool: \\<</turn>\n"}
    assert chat.format_conversations(chat.text_parts(df.limit(0))).count() == 0
    clashing = df.withColumns({c: F.lit(c) for c in ("turns", "formatted", "loss_mask", "attachments")})
    assert chat.digests(chat.format_conversations(chat.text_parts(clashing))).count() == 3
    assert chat.digests(chat.format_conversations(chat.text_parts(df.limit(0)))).count() == 0


def test_audio_and_documents():
    f = chat.Formatter()
    f.turn("user", [{"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 3}, {"type": "image"}])
    assert [(a["kind"], a["tokens"]) for a in f.attachments] == [("audio", 25), ("document", 1536), ("image", 1)]
    f = chat.Formatter()
    f.turn("user", [{"type": "smell", "ref": "s", "text": "x"}, None, {"text": "a"}, {"type": None, "text": "b"}, {"type": "unknown"}])
    assert [(a["kind"], a["ref"], a["tokens"]) for a in f.attachments] == [("other", "s", 1), ("other", None, 1)]
    assert chat.parse("".join(f.out)) == [("user", "ab")]


def test_a_very_long_turn_takes_little_memory():
    f, text = chat.Formatter(), "plain words # and <marks> \\ here " * 60_000
    f.turn("assistant", [{"type": "text", "text": text}])
    whole = "".join(f.out)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert chat._TURN.match(whole).end() == len(whole)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 20_000  # KB; the turn has 2 million characters
    assert chat.parse(whole) == [("assistant", text)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert docs.count() > 0, name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where("n_tokens > 0").count() > 0
