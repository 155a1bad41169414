import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import neardup

WORDS = [f"w{k}" for k in range(400)]


def sets_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    sets = [(d, sets_of(t, width)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed, group):
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(120)]
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    for _ in range(group):  # one family of near copies, some linked and some not
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [out[3], out[3].upper(), "", "   ", "a", "a b", "A b", "a b c", None]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "percent", "blocks", "classes"), [(3, 85, 200_000, 512), (5, 80, 3000, 512), (3, 85, 200_000, 7)])
def test_like_brute_force(spark, monkeypatch, width, percent, blocks, classes):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", blocks)
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", classes)
    rows = corpus(width, 150)
    want = brute(rows, width, percent)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (7, "a b c d", 1), (7, "a b c d", 2), (9, None, 3), (4, "A B C D", 4)], "doc_id long, text string, rep long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == [(4, 4, True), (7, 4, False), (7, 4, False), (9, 9, True), (None, None, True)]
    assert neardup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_threshold_has_the_least_chunks():
    assert neardup.chunks_for(0.85) == 11 and neardup.chunks_for(0.8) > 11


def test_an_id_with_two_texts(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(12)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (5, None), (9, b), (2, c), (7, c), (7, d), (7, d), (8, d), (None, a), (None, a), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect()), key=str)
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (5, 3, False), (9, 3, False), (2, 2, True), (7, 2, False), (7, 2, False), (7, 2, False), (8, 2, False), (None, None, True), (None, None, True), (11, 11, True)]
    assert got == sorted(want, key=str)
    stage = corpus_pipeline.near_duplicates(spark, df.where("text is not null"), "")
    assert sorted(map(tuple, stage.collect()), key=str) == sorted([(3, a), (5, b), (2, c), (7, d), (None, a), (None, a)], key=str)


def test_the_six_rows_of_ids_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (8, b), (9, c), (9, b)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("component_id", "kept", "rep", "lo", "family", "salt", "_comp")})
    assert {r.component_id for r in neardup.near_duplicates(df, 3, 85).collect()} == {3}


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_just_at_the_similarity_are_found(spark, percent):
    """Pairs of distinct texts at and barely below the similarity, each pair a component of its own."""
    rng = random.Random(percent)
    rows, linked = [], set()
    for pair in range(400):
        n = rng.randint(40, 90)
        base = [f"p{pair}w{k}" for k in range(n + 2)]
        cut = rng.randint(n * (100 - percent) // 300, n * (100 - percent) // 170)
        other = base[: n + 2 - cut] + [f"q{pair}w{k}" for k in range(cut)]
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
        s, t = (sets_of(x[1], 3) for x in rows[-2:])
        if 100 * len(s & t) >= percent * len(s | t):
            linked.add(2 * pair + 1)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, percent).collect()
    assert 100 < len(linked) < 400 and {r.doc_id for r in got if not r.kept} == linked


def test_runs_of_blocks_over_batches():
    rows = [(k // 7, k // 3, k) for k in range(40)]
    batch = lambda part: pa.RecordBatch.from_pydict({"a": [r[0] for r in part], "b": [r[1] for r in part], "v": [r[2] for r in part]})
    for cuts in ([], [1], [3, 7, 8], list(range(1, 40)), [20, 20]):
        at = [0, *cuts, 40]
        batches = [batch(rows[s:e]) for s, e in itertools.pairwise(at)]
        got = [r["v"] for b in neardup._by_run(("a", "b"), lambda t: pa.table({"v": [t.column("v").to_pylist()]}))(iter(batches)) for r in b.to_pylist()]
        assert got == [[r[2] for r in g] for _, g in itertools.groupby(rows, key=lambda r: r[:2])]


def test_rows_that_go_are_left_out_without_a_shuffle_of_texts(spark):
    import corpus_pipeline

    numbers = [k * 5 + (p << 33) for p in range(3) for k in range(20_000)]
    rows = spark.createDataFrame(pa.table({"row": numbers}).to_pandas()).repartition(4).withColumn("text", F.col("row").cast("string"))
    gone = set(random.Random(1).sample(numbers, 20_000)) | {0, 32_767 * 5, 32_768 * 5, 1 << 33}
    got = neardup.without_rows(rows, spark.createDataFrame([(k,) for k in gone], "row long")).collect()
    assert sorted(r.row for r in got) == sorted(set(numbers) - gone) and all(r.text == str(r.row) for r in got)
    assert neardup.without_rows(rows, rows.where("false").select("row")).count() == len(numbers)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # many rows go
    try:
        docs = spark.createDataFrame([(k, f"t{k % 3} " * 9, "s") for k in range(30)], "doc_id long, text string, source string")
        stage = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = stage._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftAnti" not in plan.split("BroadcastExchange")[0]
        assert sorted(r.doc_id for r in stage.collect()) == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
