"""Operators 2, 5, 8 and 10 against plain Python."""

import math
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from compare import check
from pyspark.sql import functions as F

from pagelattice.llm import mixing, quality, queries, sharding, urlfilter

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "one two three", "a b c d e f g h " * 3, "x " * 30, "line one\nline one\n\n  \nline two\nline one", "#*$%&|<>" * 9, "UPPER CASE WORDS ONLY " * 8, "ä ö ü é " * 5 + "\u00a0 \u2003", "z" * 5000, "a b c d e f g h i a b c d e f g h q r s t u v w x y z 1 2 3"]


def python_features(text):
    text = text or ""
    w = PATTERN.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    covered = {p for i, x in enumerate(windows) if seen[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if PATTERN.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def python_own(text):
    """The own rules that reject a text."""
    n, chars, symbols, dup, _ = python_features(text)
    w, capitals = PATTERN.findall(text or ""), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text or "")
    n_lines = sum(bool(PATTERN.search(x)) for x in (text or "").split("\n"))
    found = {"stutter": 100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > 30 * n, "symbols": 10 * symbols > 3 * n, "shouting": 10 * capitals > 4 * chars, "long_words": chars > 40 * n, "same_lines": n_lines >= 5 and 10 * dup > 6 * n_lines}
    return {x for x, bad in found.items() if bad}


def test_quality_features(spark):
    df = spark.createDataFrame([(k, t, 0, "x", "y") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, _a string, kept string").withColumns({c: F.lit(c) for c in ("_b", "_c", "doc", "got", "words")})
    out = quality.cascade(df)
    assert out.columns == ["doc_id", "text", "_a", "_b", "_c", "doc", "got", "words", *quality.BASE, "base_failed", "rejected_by", "kept"]
    for r in out.collect():
        want, own = python_features(TEXTS[r.doc_id]), python_own(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        base = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert (r.base_failed, r.kept, r._a, r.got) == (base, not base and not own, "x", "got")
        assert r.rejected_by in own if r.rejected_by and not base else (r.rejected_by in {"few_words", "repeats"} if base else r.rejected_by is None)


def test_cascade_gives_the_same_verdict_in_any_order(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    passed = lambda rules: [r.doc_id for r in df.where(quality.verdict(F.col("text"), rules).isNull()).collect()]
    want = [r.doc_id for r in quality.cascade(df).where("kept").collect()]
    assert passed(quality.RULES) == passed(quality.RULES[::-1]) == want == [r.doc_id for r in quality.passing(df).collect()]
    assert [r.kept for r in quality.passing(df).collect()] == ["x"] * len(want)
    assert quality.cascade(df.limit(0)).count() == quality.passing(df.limit(0)).count() == 0
    assert [x["rule"].name for x in quality.estimate(df.limit(0))] == [r.name for r in quality.RULES]


def test_later_rules_are_not_evaluated_for_rejected_texts(spark, monkeypatch):
    """A feature that fails on short texts is never asked for where the base rules reject them."""
    df = spark.createDataFrame([(1, "short"), (2, "word " * 5 + " ".join(f"w{k}" for k in range(40)))], "doc_id long, text string")
    rules = [quality.Rule("costly", ("costly",), lambda c: c < 0)]
    failing = lambda t, w: F.when(F.size(w) < 20, F.raise_error(F.lit("asked for"))).otherwise(F.lit(0)).cast("long")
    monkeypatch.setitem(quality.FEATURES, "costly", failing)
    monkeypatch.setattr(quality, "estimate", lambda docs, rules, **_: [{"rule": r} for r in rules])
    assert [(r.doc_id, r.kept) for r in quality.cascade(df, own=rules).collect()] == [(1, False), (2, True)]
    with pytest.raises(Exception, match="asked for"):
        quality.cascade(df, base=(), own=rules).collect()


def test_costs_are_of_the_features_not_of_jobs(spark):
    found = {x["rule"].name: x for x in quality.estimate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))}
    assert found["repeats"]["cost"] == max(x["cost"] for x in found.values()) > 20 * found["few_words"]["cost"] > 0
    given = {x["rule"].name: x["cost"] for x in quality.estimate(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), quality.OWN_RULES, given=quality.BASE)}
    assert given["long_words"] == 0 < given["stutter"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    check(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def python_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    cap = {s: 2.0 * sizes[s] for s in names}
    total, out, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * unit >= cap[s]}
        for s in full or open_:
            out[s] = cap[s] if full else w[s] * unit
        left -= sum(cap[s] for s in full)
        open_ = open_ - full if full else set()
    return out


def test_mixing(spark):
    rows = [(k, " ".join(["w"] * (k * 37 % 90)), ["big", "small", None, "a"][k % 7 % 4 if k % 3 else 0]) for k in range(400)] + [(900, None, "big"), (901, "", "empty"), (901, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df, block_words=500, shard_words=4000).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, source = python_targets(sizes), {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 89 / 2 for s in want)  # half of the largest document
    again = mixing.mix_report(df.repartition(5), block_words=500, shard_words=4000).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_splitting_tree_is_exact():
    quotas = {1: 100, 2: 7, 3: 0, 4: 1000}
    leaves = mixing.split(quotas, 8)
    assert {s: sum(x[s] for x in leaves) for s in quotas} == quotas
    assert max(sum(x.values()) for x in leaves) - min(sum(x.values()) for x in leaves) <= 3
    assert mixing.split(quotas, 8) == leaves


def mixed_rows(n=300):
    return [(k, "w " * (k % 50), f"s{k % 3}") for k in range(n)]


def test_shards_hold_what_the_tree_deals_in_shuffled_order(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string").repartition(3)
    asked = []
    tree = mixing.split
    monkeypatch.setattr(mixing, "split", lambda quotas, shards: asked.append(tree(quotas, shards)) or asked[-1])
    folder = str(tmp_path / "shards")
    got = mixing.write_shards(df, folder, block_words=200, shard_words=500)
    blocks = {(b.place, b.block): b for b in got.blocks.collect()}
    assert got.shards == len(asked[0]) > 4
    dealt = Counter((d.shard, b.place % 3) for b in blocks.values() for d in b.draws)
    assert dealt == Counter({(k, s): n for k, leaf in enumerate(asked[0]) for s, n in leaf.items() if n})
    units = {u.key: u for u in got.units.collect()}
    files, held = sorted((tmp_path / "shards").glob("shard=*/*.parquet")), Counter()
    assert len(files) == got.shards
    for f in files:
        shard, rows = int(f.parent.name[6:]), pq.ParquetFile(f).read().to_pylist()
        at = [r["position"] for r in rows]
        assert at == sorted(at) and len(set(at)) == len(at)
        assert len(rows) < 10 or [r["doc"]["doc_id"] for r in rows] != sorted(r["doc"]["doc_id"] for r in rows)
        held.update((shard, r["key"]) for r in rows)
    block = lambda u: int(u.key[:6], 16) % max(1, math.ceil(u.source_size / 200))
    for (shard, key), n in held.items():
        assert n <= sum(d.shard == shard for d in blocks[units[key].place, block(units[key])].draws)
    taken = {r.doc_id: r.taken for r in mixing.mix_report(df, block_words=200, shard_words=500).collect()}
    again = Counter()
    for (_, key), n in held.items():
        again[units[key].doc_id] += n * units[key].size
    assert all(taken[d] == again[d] for d in taken)


def test_taken_words_are_read_from_the_shards(spark, monkeypatch):
    """Without a leaf of the tree its blocks are in no shard, and no report of them."""
    df = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string")
    options = {"block_words": 200, "shard_words": 500}
    whole = sum(r.taken for r in mixing.mix_report(df, **options).collect())
    tree = mixing.split
    monkeypatch.setattr(mixing, "split", lambda quotas, shards: [{s: 0 for s in quotas}, *tree(quotas, shards)[1:]])
    assert 0 < sum(r.taken for r in mixing.mix_report(df, **options).collect()) < whole


def test_any_number_of_cells(spark):
    rows = [(k, "w " * (k % 50 + 1), f"s{k % 11}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.taken) for r in mixing.mix_report(df, block_words=100, shard_words=500).collect())
    for cells in (1, 7, 40):
        got = mixing.mix(df, block_words=100, shard_words=500, max_cells=cells)
        draws = [(b.place, b.block, d.turn, d.shard) for b in got.blocks.collect() for d in b.draws]
        per = Counter(d[3] for d in draws)
        assert len({d[:3] for d in draws}) == len(draws) and len(per) == got.shards and max(per.values()) - min(per.values()) <= 11
        assert sorted((r.doc_id, r.taken) for r in mixing.mix_report(df, block_words=100, shard_words=500, max_cells=cells).collect()) == want


def test_mixing_stage_takes_rows_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(k if k % 3 else None if k % 2 else 7, f"t{k} " * (k % 40 + 1), f"s{k % 3}" if k % 5 else None, k, "p") for k in range(300)]
    rows += [(5, "t5 " * 6, "s2", 5, "p")] * 9 + [(1000 + k, None if k % 2 else "", "s1", k, None) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long, position string").withColumns({c: F.lit(c) for c in ("_id", "_times", "_copy", "_row", "key", "place", "block", "doc", "draws", "whole", "size", "target", "taken")}).repartition(5)
    report = Counter()
    for r in mixing.mix_report(df).collect():
        assert r.taken <= 2 * r.size
        report[r.doc_id] += r.taken
    stage = corpus_pipeline.mixing_sources(spark, df, SF)
    assert stage.columns == df.columns
    got = stage.collect()
    taken = Counter()
    for r in got:
        taken[r.doc_id] += len((r.text or "").split())
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in report.items() if n} and taken[None] and taken[7]
    assert {tuple(r)[:5] for r in got} <= set(rows) and {r.key for r in got} == {"key"}
    sizes, per = Counter(), Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        per[r.source] += len((r.text or "").split())
    assert all(abs(per[s] - w) <= 60 for s, w in python_targets(sizes).items())
    assert corpus_pipeline.mixing_sources(spark, df.limit(0), SF).count() == 0


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else "x" * (k % 300), "monday") for k in range(2000)] + [(None, None, None)] * 3, "doc_id long, text string, arrival string")
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=40_000)
    versions = store.append_each(df.repartition(6), sharding.arrivals(4))
    assert versions == [1, 2, 3, 4]
    before = store.manifest()["files"]
    store.compact()
    after = store.manifest()["files"]
    assert len(after) < len(before)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(store.read()) == key(df) == key(store.read(4))
    assert key(store.read(1)) != key(df)
    assert store.vacuum() == len({f["path"] for f in before} - {f["path"] for f in after})
    assert key(store.read()) == key(df)
    with pytest.raises(ValueError):
        store.append(df.withColumn("more", df.doc_id))
    v = store.append(df.limit(0))
    assert key(store.read(v)) == key(df)


def test_a_version_is_committed_once(spark, tmp_path):
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    assert a.read().count() == 0 and a.read().columns == []
    a.append(spark.range(5).toDF("doc_id"))
    with pytest.raises(sharding.Conflict):
        b._commit(0, None, [], [])
    b.append(spark.range(5, 9).toDF("doc_id"))
    assert a.read().count() == 9 and a.read(1).count() == 5
    with pytest.raises(ValueError):
        a.append(spark.range(3).selectExpr("cast(id as int) as doc_id"))


def test_of_two_writers_one_wins(spark, tmp_path):
    """Both write the next version's file and then claim its name; the loser applies its change to the winner's."""
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(spark.range(1).toDF("doc_id"))
    paths = [a._path(f"{a.root}/staging/_{x}") for x in "ab"]
    for p in paths:
        a._write(p, "{}")
    final = a._path(f"{a.root}/manifest/v00000002.json")
    assert [a._claim(paths[0], final), b._claim(paths[1], final)] == [True, False]
    a._fs.delete(final, False)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: (a, b)[k % 2].append(spark.range(10 * k, 10 * k + 10).toDF("doc_id")), range(1, 5)))
    assert sorted(versions) == [2, 3, 4, 5] and a.read().count() == 41


def test_vacuum_leaves_files_of_runs_that_are_not_committed(spark, tmp_path):
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(spark.range(5).toDF("doc_id"))
    more = spark.range(5, 9).toDF("doc_id")
    run, files = a._run(more)
    assert b.vacuum() == 0
    a._append(more.schema, files)
    a._done(run)
    assert b.vacuum() == 0 and b.read().count() == 9
    run, files = a._run(more)
    assert b.vacuum(abandoned=0) == len(files) and b.read().count() == 9


def test_versions_that_list_changes_add_up(spark, tmp_path):
    a = sharding.ShardStore(spark, str(tmp_path / "s"))
    for k in range(13):
        a.append(spark.range(k, k + 1).toDF("doc_id").coalesce(1))
    a.compact()
    assert [a.read(v).count() for v in (1, 5, 10, 11, 13)] == [1, 5, 10, 11, 13] and a.read().count() == 13
    assert len(a.manifest()["files"]) < 13


def python_ranks(hosts, links, good, bad, d=0.85, steps=200):
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    t = {h: (1 - d) * good(h) for h in hosts}
    x = {h: (1 - d) * bad(h) for h in hosts}
    for _ in range(steps - 1):
        t2 = {h: (1 - d) * good(h) + d * sum(t[a] * n / out[a] for (a, b), n in links.items() if b == h) for h in hosts}
        x = {h: (1 - d) * bad(h) + d * sum(x[b] * n / into[b] for (a, b), n in links.items() if a == h) for h in hosts}
        t = t2
    return t, x


def test_url_filter(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/x'>" for h in hosts)
    rows = [
        (1, "https://Sub.Example.com/en/7x?q#f", link("spam.org", "good.org")),
        (2, "http://a.net/de/8", link("farm.org")),
        (3, "http://farm.org/", link("spam.org") * 5),
        (4, "http://feeder.org", link("farm.org") * 3),
        (5, "http://good.org/en/x", link("feeder.org", "other.org")),
        (6, None, None),
        (7, "no scheme", "<a href=/local>"),
        (8, "http://example.net/de/8?x", None),
        (9, "http://notexample.net/x", ""),
        (9, "http://notexample.net/x", ""),
        (10, "http://x.spam.org/es/1", None),
        (11, "http://spam.org/", None),
        (12, "http://lone.org/", link("x.spam.org")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urlfilter.url_filter(df, trusted=("good.org",), blocked=("spam.org",)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert tuple(by[1])[1:] == ("sub.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (by[2].rule, by[2].verdict) == ("net/de/", "block")
    assert (by[8].rule, by[10].rule) == ("example.net/de/8", "org/es/")
    assert tuple(by[6])[1:] == ("", "", None, "allow") and tuple(by[7])[1:] == ("", "", None, "allow")
    links = {("sub.example.com", "spam.org"): 1, ("sub.example.com", "good.org"): 1, ("a.net", "farm.org"): 1, ("farm.org", "spam.org"): 5, ("feeder.org", "farm.org"): 3, ("good.org", "feeder.org"): 1, ("good.org", "other.org"): 1, ("lone.org", "x.spam.org"): 1}
    hosts = {h for e in links for h in e} | {"example.net", "notexample.net"}
    t, x = python_ranks(hosts, links, lambda h: float(h == "good.org"), lambda h: float(h == "spam.org" or h.endswith(".spam.org")))
    for k in (3, 4, 5, 9, 11, 12):
        h = by[k].host
        assert by[k].verdict == ("block" if x[h] - t[h] >= urlfilter.THRESHOLD else "allow"), h
    assert (by[5].verdict, by[11].verdict, by[12].verdict) == ("allow", "block", "block")
    assert urlfilter.url_filter(df.limit(0)).count() == 0


def test_every_host_of_a_link_farm_is_blocked(spark):
    link = lambda *hosts: "".join(f"<a href='https://{h}/x'>" for h in hosts)
    verdicts = {}
    for n in (2, 40):
        rows = [(k, f"http://farm{k}.org/", link("spam.org")) for k in range(n)]
        rows += [(100, "http://feeder.org/", link("farm0.org")), (101, "http://list.org/", link("spam.org", *[f"site{k}.org" for k in range(9)])), (102, "http://good.org/", link("liked.org")), (103, "http://liked.org/", link("spam.org"))]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        verdicts[n] = {r.page_id: r.verdict for r in urlfilter.url_filter(df, trusted=("good.org",), blocked=("spam.org",)).collect()}
        assert verdicts[n] == {**dict.fromkeys(range(n), "block"), 100: "block", 101: "allow", 102: "allow", 103: "allow"}


def test_settled_verdicts_are_like_sql(spark, tmp_path):
    import random

    rng = random.Random(10)
    hosts = [f"h{k}.org" for k in range(60)] + ["example.com", "example.org", "www.example.net", "spam-farm.example.net", "x.casino-win.example.org", "free-bets.example.com"]
    link = lambda *names: "".join(f"<a href='https://{h}/x'>" for h in names)
    rows = [(k, f"http://{hosts[k % len(hosts)]}/p{k}", link(*[rng.choice(hosts if k % 3 else hosts[40:]) for _ in range(rng.randint(0, 5))]) or None, "c") for k in range(300)]
    # a pair that sends trust to and fro: after 20 steps a thirtieth of it is still missing
    rows += [(900, "http://example.net/", link("one.org"), "c"), (901, "http://one.org/", link("two.org"), "c"), (902, "http://two.org/", link("one.org"), None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumns({"path": F.lit(1), "rule": F.lit(2), "bad": F.lit(3), "verdict": F.lit(4), "fit": F.lit(5)})
    df.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    check(urlfilter.url_filter(df), queries.oracle_sql()["op10_url_filter"], tmp_path)
