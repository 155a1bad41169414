"""The measure of baselines against plain loops over ticks, and cases worked by hand."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.functions import geometry as geo
from pagelattice.operators import measure, polygons
from pagelattice.plans import queries

SF = "/root/testdata/sf0.001"


def plain_ticks(points, distance=5, least=20):
    """Every pixel of the line, then some of them."""
    pixels = [points[0]]
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        n = max(abs(x2 - x1), abs(y2 - y1))
        pixels += [(math.floor(x1 + (x2 - x1) * k / n + 0.5), math.floor(y1 + (y2 - y1) * k / n + 0.5)) for k in range(1, n + 1)]
    if len(pixels) <= least:
        return pixels
    count = max(least, (len(pixels) - 1) // distance + 1)
    step = (len(pixels) - 1) / (count - 1)
    return [pixels[int(k * step)] for k in range(count - 1)] + [pixels[-1]]


def test_ticks(spark):
    rng = random.Random(3)
    lines = [[(rng.randint(-50, 900), rng.randint(-50, 300)) for _ in range(rng.randint(1, 5))] for _ in range(80)]
    lines += [[(5, 5), (5, 5)], [(0, 0), (19, 0)], [(0, 0), (20, 0)], [(0, 0), (0, 0), (7, 7)], [(3, 3), (3, 3), (40, 3), (40, 3)], [(10, 0), (0, 0)]]
    rows = [(k, [{"x": x, "y": y} for x, y in line]) for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "k int, p array<struct<x:int,y:int>>")
    got = df.select("k", geo.ticks(F.col("p")).alias("a"), geo.thin_out(geo.blow_up(F.col("p"))).alias("b")).collect()
    for r in got:
        assert [tuple(p) for p in r.a] == [tuple(p) for p in r.b] == plain_ticks(lines[r.k]), lines[r.k]
    # a line of 501 pixels has 101 ticks, one of 101 has 21, one of 96 the least number of 20
    by_hand = {(0, 500): 101, (0, 100): 21, (0, 95): 20, (0, 20): 20, (0, 19): 20, (0, 18): 19}
    for (a, b), n in by_hand.items():
        assert len(plain_ticks([(a, 0), (b, 0)])) == n
    huge = spark.createDataFrame([([{"x": 0, "y": 7}, {"x": 100_000, "y": 7}],), ([{"x": 5, "y": 7}, {"x": 100_004, "y": 7}],)], "p array<struct<x:int,y:int>>")
    assert [[len(r.t), tuple(r.t[0])] for r in huge.select(geo.ticks(F.col("p")).alias("t")).collect()] == [[1, (0, 0)], [20_000, (5, 7)]]


def plain_score(d, t):
    return 1.0 if d <= t else (3 * t - d) / (2 * t) if t and d <= 3 * t else 0.0


def plain_measure(truth, reco, tolerances):
    """Recall and precision by loops; tolerances: a list for each truth line."""
    away = lambda p, line: min(abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in line)
    n = len(tolerances[0])
    recall = [[sum(plain_score(min(away(p, r) for r in reco), tolerances[j][k]) for p in line) / len(line) for j, line in enumerate(truth)] for k in range(n)]
    precision = []
    for k in range(n):
        hits = {(i, j): sum(plain_score(away(p, line), tolerances[j][k]) for p in r) / len(r) for i, r in enumerate(reco) for j, line in enumerate(truth)}
        best = [0.0] * len(reco)
        while hits:
            i, j = min(hits, key=lambda ij: (-hits[ij], ij))
            best[i] = hits[i, j]
            hits = {x: v for x, v in hits.items() if x[0] != i and x[1] != j}
        precision.append(best)
    return float(np.mean(recall)), float(np.mean(precision))


def page(seed, n):
    rng = random.Random(seed)
    make = lambda x, y, w: plain_ticks([(x, y), (x + w // 2, y + rng.randint(-3, 3)), (x + w, y)])
    truth = [make(rng.randint(0, 60), 40 * k, rng.randint(10, 260)) for k in range(n)]
    reco = [make(rng.randint(0, 60), 40 * k + rng.randint(-25, 25), rng.randint(10, 260)) for k in range(n - seed % 2)]
    return truth, reco


@pytest.mark.parametrize("seed", range(5))
def test_measure_like_loops(seed):
    truth, reco = page(seed, 5)
    arrays = [[np.array(line) for line in side] for side in (truth, reco)]
    for least, most in ((10, 30), (1, 4), (0, 2)):
        want = plain_measure(truth, reco, [list(range(least, most + 1))] * len(truth))
        assert np.allclose(measure.detection(*arrays, measure.Tolerances(least, most)), want)
    own = measure.neighbour_tolerances(arrays[0])
    assert np.allclose(measure.detection(*arrays, measure.Tolerances(least=-1)), plain_measure(truth, reco, [[t] for t in own]))


def test_many_pages_like_each():
    rng = random.Random(8)
    line = lambda: np.array([(x, rng.randint(0, 60)) for x in range(rng.randint(0, 40), rng.randint(60, 300), 5)])
    side = lambda: {a: [line() for _ in range(rng.randint(1, 3))] for a in rng.sample([None, 0, 1, 2], rng.randint(0, 4))}
    pages = [(side(), side()) for _ in range(120)]
    def noise(truth, reco, tolerances):
        """Whether scores that are equal differ in their last bits, so that the alignment hangs on these."""
        both = [[x for own in s.values() for x in own] for s in (truth, reco)]
        steps = np.diff(np.sort(measure.pair_scores(both[1], both[0], tolerances.of(both[0])).reshape(len(tolerances.of(both[0])), -1))) if all(both) else np.zeros(0)
        return ((steps > 0) & (steps < 1e-9)).any()

    for tolerances in (measure.Tolerances(), measure.Tolerances(4, 9), measure.Tolerances(-1)):
        for (truth, reco), got in zip(pages, measure.page_measures(pages, tolerances), strict=True):
            if noise(truth, reco, tolerances):
                continue
            expected = measure.page_measure(truth, reco, tolerances)
            assert [x and pytest.approx(x, abs=1e-12) for x in expected] == got
    whole = [both for both in ([[x for own in s.values() for x in own] for s in page] for page in pages if not noise(*page, measure.Tolerances())) if all(both)]
    assert len(whole) > 20
    for (truth, reco), (recall, precision) in zip(whole, measure.page_line_scores(whole), strict=True):
        assert np.allclose(recall, measure.line_recall(truth, reco, measure.Tolerances()), atol=1e-12)
        assert np.allclose(precision, measure.line_precision(truth, reco, measure.Tolerances()), atol=1e-12)


def test_many_ticks_are_those_of_the_column_expression(spark):
    rng = random.Random(5)
    lines = [[(rng.randint(-50, 900), rng.randint(-50, 300)) for _ in range(3)] for _ in range(150)]
    lines += [[(5, 5)] * 3, [(0, 0), (0, 0), (19, 0)], [(0, 0), (20, 0), (20, 0)], [(9, 0), (9, 0), (0, 7)], [(0, 7), (9, 9), (100_000, 7)]]
    ticks, counts = polygons.many_ticks(np.array(lines))
    parts = np.split(ticks, np.cumsum(counts)[:-1])
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in line]) for k, line in enumerate(lines)], "k int, p array<struct<x:int,y:int>>")
    for r in df.select("k", geo.ticks(F.col("p")).alias("t")).collect():
        assert [tuple(p) for p in r.t] == list(map(tuple, parts[r.k].tolist())), lines[r.k]


def test_many_pages_take_less_time_than_each():
    rows = [(np.stack([np.arange(0, 500, 5), np.full(100, 40 * k)], axis=1)) for k in range(6)]
    pages = [({0: rows[:3], 1: rows[3:]}, {0: [r + 3 for r in rows[:2]], 1: [r + 3 for r in rows[2:]]})] * 60
    start = time.perf_counter()
    measure.page_measures(pages)
    middle = time.perf_counter()
    for page in pages:
        measure.page_measure(*page)
    assert 2 * (middle - start) < time.perf_counter() - middle


def test_measure_by_hand():
    line = lambda y, x0=0, x1=100: np.array(plain_ticks([(x0, y), (x1, y)]))
    at = measure.Tolerances(10, 10)
    assert measure.detection([line(0)], [line(10)], at) == (1.0, 1.0)
    assert measure.detection([line(0)], [line(20)], at) == (0.5, 0.5)
    assert measure.detection([line(0)], [line(30)], at) == (0.0, 0.0)
    assert measure.detection([line(0), line(100)], [line(0)], at) == (0.5, 1.0)
    assert measure.detection([line(0)], [line(0), line(5)], at) == (1.0, 0.5)  # one is aligned, the other left over
    assert measure.detection([], [line(0)], at) is None and measure.detection([line(0)], [], at) == (0.0, 0.0)
    assert measure.detection([line(0)], [line(0), line(20)], measure.Tolerances(10, 30)) == (1.0, 0.5)
    # two articles of one line each, one found, its lines' share is a half
    found = measure.page_measure({"a": [line(0)], "b": [line(200)], None: [line(400)]}, {"x": [line(0)], None: [line(400)]}, at)
    assert found[0] == (2 / 3, 1.0, 0.8) and found[1] == (0.5, 1.0, 2 / 3) and found[2] == (0.5, 1.0, 2 / 3)
    assert measure.page_measure({}, {"x": [line(0)]}, at) == [None, None, None]
    assert measure.page_measure({None: [line(0)]}, {"x": [line(0)]}, at) == [(1.0, 1.0, 1.0), None, None]
    assert measure.page_measure({"a": [line(0)]}, {None: [line(0)]}, at) == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def plain_distances(lines, tick=5, most=250):
    """The distance of lines as a walk over ticks, other lines and their ticks, in this order."""
    out = []
    for a in lines:
        angle = measure.regression(np.array(a))[0]
        c, s = math.cos(angle), math.sin(angle)
        along = lambda p, q: (p[0] - q[0]) * c + (q[1] - p[1]) * s  # noqa: B023, E731
        across = lambda p, q: abs((p[0] - q[0]) * s - (q[1] - p[1]) * c)  # noqa: B023, E731
        dist = most
        for p in a:
            for b in lines:
                if b is a:
                    continue
                x0, x1, y0, y1 = min(q[0] for q in b), max(q[0] for q in b) + 1, min(q[1] for q in b), max(q[1] for q in b) + 1
                if max(0, x0 - p[0]) + max(0, p[0] - x1) + max(0, y0 - p[1]) + max(0, p[1] - y1) > dist:
                    continue
                four = [along(e, f) for e in (a[0], a[-1]) for f in (b[0], b[-1])]
                if all(v < 0 for v in four) or all(v > 0 for v in four):
                    continue
                for q in b:
                    if abs(along(p, q)) <= 2 * tick:
                        dist = min(dist, across(p, q))
        out.append(min(dist, most))
    return out


def test_neighbour_distances():
    rng = random.Random(9)
    for n in (1, 2, 5, 6):
        lines = [plain_ticks([(rng.randint(0, 300), rng.randint(0, 300)), (rng.randint(0, 300), rng.randint(0, 300))]) for _ in range(n)]
        assert np.allclose(measure.neighbour_distances([np.array(x) for x in lines]), plain_distances(lines))
    line = lambda y, x0=0, x1=100: np.array(plain_ticks([(x0, y), (x1, y)]))
    lines = [line(0), line(30), line(90), line(90, 300, 400)]
    assert measure.neighbour_distances(lines).tolist() == [30, 30, 60, 250]
    assert np.allclose(measure.neighbour_tolerances(lines), [7.5, 7.5, 10, 10])  # the mean is 40
    assert measure.neighbour_tolerances([line(0)]).tolist() == [62.5]


def test_regression():
    at = lambda *p: measure.regression(np.array(p))
    assert np.allclose(at((0, 0), (10, 0)), (0, 0)) and np.allclose(at((10, 5), (0, 5)), (math.pi, -5))
    assert np.allclose(at((0, 0), (10, -10)), (math.pi / 4, 0)) and np.allclose(at((10, -10), (0, 0)), (math.pi * 5 / 4, 0))
    assert at((3, 0), (3, 9)) == (math.pi / 2, math.inf) and at((3, 0), (3, 5), (4, 9)) == (math.pi / 2, 10 / 3) and at((3, 0)) == (0.0, 0.0)
    assert np.allclose(at((0, 0), (1, 3), (2, 6), (3, 9))[0], 2 * math.pi - math.atan(3))


def test_queries(spark):
    """The registered queries against the loops, on every page."""
    rows = queries._ticked(queries.Layout(spark, SF)).collect()
    pages = {}
    for r in sorted(rows, key=lambda r: (r.side, r.line_no)):
        pages.setdefault(r.page_id, ([], []))[r.side].append((r.article, list(zip(r.xs, r.ys, strict=True))))
    got = {r.page_id: r for r in queries.queries()["baseline_measure"](spark, SF).collect()}
    assert set(got) == set(pages)
    for p, (truth, reco) in sorted(pages.items())[:40]:
        r = got[p]
        lines = []
        for side in (truth, reco):  # by article, in order of the articles' first lines
            order = list(dict.fromkeys(a for a, _ in side))
            lines.append([line for x in order for a, line in side if a == x])
        if lines[1]:
            assert np.allclose((r.lines_recall, r.lines_precision), plain_measure(*lines, [list(range(10, 31))] * len(lines[0])), atol=1e-8)
        else:
            assert (r.lines_recall, r.lines_precision, r.lines_f) == (0, 0, 0)
        assert (r.named_f is None) == all(a < 0 for a, _ in truth) and (r.articles_f is None) == (r.named_f is None)
    total = queries.queries()["baseline_summary"](spark, SF).first()
    assert total.pages == total.lines_pages == len(got) and total.named_pages == sum(r.named_f is not None for r in got.values())
    assert abs(total.lines_recall - sum(r.lines_recall for r in got.values()) / len(got)) < 1e-5
    hits = queries.queries()["baseline_hits"](spark, SF).collect()
    per = {}
    for h in hits:
        per.setdefault((h.page_id, h.side), []).append(h.score)
    # the alignment of ties goes by the order of lines, which here is not by article
    assert all(abs(np.mean(v) - got[p].lines_recall) < 1e-8 for (p, side), v in per.items() if side == 0)
    sides = queries.queries()["true_false_lines"](spark, SF).collect()
    assert {(r.page_id, r.side): r.n_true for r in sides} == {k: sum(v >= 0.5 for v in x) for k, x in per.items()} and all(r.n_true + r.n_false == len(per[r.page_id, r.side]) for r in sides)
    assert queries.queries()["line_tolerances"](spark, SF).where("tolerance > 0 and distance <= 500").count() == sum(len(t) for t, _ in pages.values())


def plain_neighbours(lines, distance, factor=1.25):
    """Box by box: each is (x, y, width, height)."""
    known = [d for d in distance if d > 0]
    mean = sum(known) / (len(known) + 1e-8)
    reach = [factor * (d if 0.5 * mean <= d <= 1.5 * mean else mean) for d in distance]
    out = set()
    for i, (x, y, w, h) in enumerate(lines):
        for j, (p, q, v, u) in enumerate(lines):
            if i == j:
                continue
            grown = (x, int(y - reach[i]), w, int(h + 2 * reach[i]))
            wide = min(grown[0] + grown[2], p + v) - max(grown[0], p)
            high = min(grown[1] + grown[3], q + u) - max(grown[1], q)
            if wide >= 0 and high >= 0 and (wide + 1) * (high + 1) >= 0.95 * (v + 1) * (u + 1):
                out |= {(i, j), (j, i)}
    return out


def plain_clusters(n, near, least=2):
    label, now = {}, 0
    of = lambda k: [j for j in range(n) if (k, j) in near]
    for s in range(n):
        if s in label:
            continue
        if len(of(s)) < least:
            label[s] = "noise"
            continue
        label[s], queue = now, of(s)
        while queue:
            k = queue.pop(0)
            if label.get(k) == "noise":
                label[k] = now
            elif k not in label:
                label[k] = now
                if len(of(k)) >= least:
                    queue += of(k)
        now += 1
    for k in range(n):
        if label[k] == "noise":
            label[k], now = now, now + 1
    return [label[k] for k in range(n)]


def test_clusters_of_baselines_like_loops():
    from pagelattice.operators import clustering

    rng = random.Random(12)
    for n in (1, 2, 3, 8, 14):
        boxes = [(rng.randint(0, 300), rng.randint(0, 300), rng.randint(20, 200), rng.randint(1, 30)) for _ in range(n)]
        distance = np.array([rng.choice((0, 20, 30, 40, 120)) for _ in range(n)], float)
        near = plain_neighbours(boxes, distance.tolist())
        assert {tuple(p) for p in np.argwhere(clustering.line_neighbours(np.array(boxes), distance)).tolist()} == near
        assert clustering.grown(clustering.line_neighbours(np.array(boxes), distance)) == plain_clusters(n, near)
    # two columns of five lines, 50 apart from each other; a lone line is a cluster of its own
    lines = [np.array([(x, 20 * k), (x + 100, 20 * k)]) for x in (0, 400) for k in range(5)] + [np.array([(0, 900), (100, 900)])]
    assert clustering.grown(clustering.baseline_neighbours(lines)) == [0] * 5 + [1] * 5 + [2]


def test_neighbours_of_many_pages_are_those_of_one_by_one():
    from pagelattice.operators import clustering

    rng = np.random.default_rng(8)
    pages = []
    for k in range(80):
        n = int(rng.integers(1, 9))
        start = np.stack([rng.integers(0, 900, n), np.sort(rng.integers(0, 30 + 300 * (k % 3), n))], axis=1)
        across = rng.integers(-200 if k % 4 == 3 else 60, 600, (n, 2)) * [1, 1 if k % 4 == 3 else 0]
        lines = np.stack([start, start + across // 2 + rng.integers(0, 9, (n, 2)), start + across], axis=1)
        pages.append(np.repeat(lines[:1], n, axis=0) if k % 20 == 19 else lines)
    got = clustering.many_baseline_neighbours(pages)
    for lines, near in zip(pages, got, strict=True):
        assert (near == clustering.baseline_neighbours(list(lines))).all()
    own = [[polygons.ticks(line, 5) for line in lines] for lines in pages]
    flat = [line for lines in own for line in lines]
    found = measure.many_neighbour_distances(np.concatenate(flat).astype(np.int64), np.array([len(x) for x in flat]), np.repeat(np.arange(len(own)), [len(x) for x in own]), 5, 500.0)
    assert np.allclose(found, np.concatenate([measure.neighbour_distances(lines, 5, 500.0) for lines in own]), rtol=0, atol=1e-9)


def random_sides(rng, pages, odd):
    """Three points of each line, and its page, side and article; odd: every third line goes anywhere."""
    points, place = [], []
    for p in range(pages):
        n = int(rng.integers(1, 8))
        for side in (0, 1):
            for k in range(n):
                x, w, y = 25 * int(rng.integers(0, 9)), 100 + 10 * int(rng.integers(1, 30)), 40 * k + int(rng.integers(-3, 16))
                line = [(x, y), (x + w // 2, y + k % 3 * 2), (x + w, y + int(rng.integers(-9, 9)))]
                points.append(rng.integers(0, 200, (3, 2)).tolist() if odd and rng.random() < 0.3 else line)
                place.append((p, side, int(rng.integers(-1, 3))))
    keep = np.array([side == 0 or rng.random() < 0.8 for _, side, _ in place])
    return np.array(points)[keep], *np.array(place)[keep].T


def test_measures_of_many_pages_are_those_of_one_by_one():
    rng = np.random.default_rng(21)
    for odd in (False, True):
        points, page, side, article = random_sides(rng, 120, odd)
        ticks, counts = polygons.many_ticks(points)
        got = measure.many_page_measures(ticks, counts, page, side, article, 121)  # the last page has no lines
        pages = [({}, {}) for _ in range(120)]
        for line, p, s, a in zip(np.split(ticks, np.cumsum(counts)[:-1]), page.tolist(), side.tolist(), article.tolist(), strict=True):
            pages[p][s].setdefault(None if a < 0 else a, []).append(line)
        wanted = [[v for x in found for v in x or (np.nan,) * 3] for found in measure.page_measures(pages)]
        assert np.allclose(got[:120], wanted, rtol=0, atol=1e-12, equal_nan=True) and np.isnan(got[120]).all()


def test_both_sides_from_one_pass(spark):
    t = queries.Layout(spark, SF)
    wanted = t.table("fx_base").selectExpr("page_id", "side", "line_no", "coalesce(article, -1)", "x0", "y0", "x1", "y1", "x2", "y2")
    assert sorted(map(tuple, queries._based(t).collect())) == sorted(map(tuple, wanted.collect()))
    plan = queries.queries()["baseline_measure"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # lines are dealt by their page once


def test_tolerances_of_many_pages_are_those_of_one_by_one():
    rng = np.random.default_rng(22)
    for odd in (False, True):
        points, page, side, _ = random_sides(rng, 120, odd)
        points, page = points[side == 0], page[side == 0]
        ticks, counts = polygons.many_ticks(points)
        far, near = measure.many_neighbour_distances(ticks, counts, page, most=(500.0, 250.0))
        stats, tolerance = np.stack(measure.many_regressions(ticks, counts)), measure.many_neighbour_tolerances(near, page)
        lines = np.split(ticks, np.cumsum(counts)[:-1])
        for p in range(120):
            own = np.flatnonzero(page == p)
            some = [lines[k] for k in own]
            assert np.allclose(far[own], measure.neighbour_distances(some, most=500.0), rtol=0, atol=1e-9)
            assert np.allclose(tolerance[own], measure.neighbour_tolerances(some), rtol=0, atol=1e-9)
            assert np.allclose(stats[:, own].T, [measure.regression(x) for x in some], rtol=0, atol=1e-6)
    # a tent is level, in every bit
    assert measure.regression(np.array(plain_ticks([(475, 228), (600, 232), (725, 228)])))[0] == 0.0


def test_groups_longer_than_a_batch(spark):
    from pagelattice.operators import per_page

    df = spark.range(9000).selectExpr("case when id < 7000 then 1 else id % 50 + 2 end as page", "9000 - id as v")
    run = lambda r, counts: (np.arange(len(counts)), [counts, r["v"][np.cumsum(counts) - counts], r["v"][np.cumsum(counts) - 1]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = {r.page: (r.n, r.least, r.most) for r in per_page.per_pages(df, ["page"], ["v"], run, "n long, least long, most long").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.page: (r.n, r.least, r.most) for r in df.groupBy("page").agg({"v": "min"}).withColumnRenamed("min(v)", "least").join(df.groupBy("page").agg({"v": "max"}).withColumnRenamed("max(v)", "most"), "page").join(df.groupBy("page").count().withColumnRenamed("count", "n"), "page").collect()}
