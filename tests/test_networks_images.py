"""Message rounds against plain loops; strokes, drawing and holes on images and rings worked by hand; noise and stopping rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.operators import augment, graph_network, per_page, polygons, raster
from pagelattice.plans import queries
from pagelattice.sources import files, pagexml

SF = "/root/testdata/sf0.001"


def plain_scores(net, nodes, edges, edge_features, pairs):
    """The network with lists and loops."""
    layer = lambda d, x: [sum(x[i] * d.weights[i][j] for i in range(len(x))) + d.bias[j] for j in range(len(d.bias))]

    def run(layers, x):
        for d in layers:
            x = layer(d, x)
            x = [float(d.activation(np.array(v))) for v in x] if d.activation else x
        return x

    def four(a, b):
        return [*a, *b, *[q - p for p, q in zip(a, b, strict=True)], *[(q - p) ** 2 for p, q in zip(a, b, strict=True)]]

    n, size = len(nodes), len(net.gates["in"].bias)
    state, cell = [[0.0] * size for _ in nodes], [[0.0] * size for _ in nodes]
    for _ in range(net.rounds):
        got = [[] for _ in nodes]
        for head in net.heads:
            sent = [four(nodes[a], nodes[b]) + list(f) + four(state[a], state[b]) for (a, b), f in zip(edges, edge_features, strict=True)]
            for k in range(n):
                coming = [m for m, (_, b) in enumerate(edges) if b == k]
                score = [math.exp(run(head.score, sent[m])[0]) for m in coming] if head.score else [1.0] * len(coming)
                parts = [[s / sum(score) * v for v in run(head.message, sent[m])] for s, m in zip(score, coming, strict=True)]
                got[k] += [sum(v) for v in zip(*parts, strict=True)] if parts else [0.0] * len(head.message[-1].bias)
        for k in range(n):
            x = got[k] + state[k] + list(nodes[k])
            gate = {g: run([d], x) for g, d in net.gates.items()}
            cell[k] = [f * c + i * z for f, c, i, z in zip(gate["forget"], cell[k], gate["in"], gate["cell"], strict=True)]
            got[k] = [o * math.tanh(c) for o, c in zip(gate["out"], cell[k], strict=True)]
        state = got
    out = []
    for a, b in pairs:
        z = run(net.relation, state[a] + list(nodes[a]) + state[b] + list(nodes[b]))
        out.append([math.exp(v) / sum(map(math.exp, z)) for v in z])
    return out


def test_message_rounds_like_loops():
    rng = np.random.default_rng(4)
    nodes, edges = rng.normal(size=(4, 3)), np.array([(0, 1), (1, 0), (2, 1), (0, 2), (1, 2)])  # node 3 has no edges
    features, pairs = rng.normal(size=(5, 2)), np.array([(0, 1), (2, 3), (3, 3)])
    net = graph_network.example(3, 2)
    got = graph_network.relation_scores(net, nodes, edges, features, pairs)
    assert np.allclose(got, plain_scores(net, nodes.tolist(), edges.tolist(), features.tolist(), pairs.tolist()))
    for head in net.heads:
        head.score = None
    assert np.allclose(graph_network.relation_scores(net, nodes, edges, features, pairs), plain_scores(net, nodes.tolist(), edges.tolist(), features.tolist(), pairs.tolist()))
    net.merge = "average"
    assert graph_network.messages(net, nodes, np.zeros((4, 4)), edges, features).shape == (4, 3)
    assert np.allclose(graph_network.attention(rng.normal(size=5), edges, 4).sum(), 3)


def test_straight_distances():
    rng = np.random.default_rng(6)
    for _ in range(5):
        mask = (rng.uniform(size=(17, 23)) < 0.85).astype(np.uint8)
        zeros = np.argwhere(mask == 0)
        want = [[0 if not mask[y, x] else math.floor(math.sqrt(((zeros - (y, x)) ** 2).sum(axis=1).min())) for x in range(23)] for y in range(17)]
        assert raster.straight_distances(mask).tolist() == want
    assert raster.straight_distances(np.ones((3, 3), np.uint8)).tolist() == [[255] * 3] * 3


def test_strokes():
    image = np.full((60, 200), 240, np.uint8)
    image[20:40, 10:21] = 10  # a bar 11 wide and 20 high
    image[20:30, 60:65] = 10  # 5 wide, 10 high
    image[20:50, 100:103] = 10  # ten times as high as wide: left out
    depth = raster.stroke_image(image)
    assert raster.strokes(depth, (0, 10, 50, 55))[1] == 20 and 5 <= raster.strokes(depth, (0, 10, 50, 55))[0] <= 7
    both = raster.strokes(depth, (0, 10, 90, 55))
    assert both[1] == 20 and both[0] == np.median([raster.strokes(depth, (0, 10, 50, 55))[0], raster.strokes(depth, (50, 10, 90, 55))[0]])
    assert raster.strokes(depth, (95, 10, 110, 55)) == raster.strokes(depth, (150, 10, 190, 55)) == (0.0, 0)


def test_drawing():
    line = raster.drawn((20, 30), [[(5, 10), (25, 10)]], closed=False, width=3)
    assert sorted(set(np.argwhere(line)[:, 0])) == [9, 10, 11] and set(np.unique(line)) == {0, 255}
    square = [(5, 5), (14, 5), (14, 14), (5, 14)]
    assert (raster.drawn((20, 20), [square], fill=True, width=1) > 0).sum() == 100
    assert (raster.drawn((20, 20), [square], width=1) > 0).sum() == 36
    got = raster.ground_truth((20, 20), {"a": [square], "b": [[(10, 10), (19, 10), (19, 19), (10, 19)]]})
    assert [int((x > 0).sum()) for x in got.values()] == [100, 75, 400 - 175]
    assert not (got["a"].astype(int) + got["b"] + got["other"] != 255).any()


def test_images_leave_a_worker_in_pieces():
    made = []

    def groups():
        for k in range(500):
            made.append(k)
            yield [(k, bytes(100_000)), (k, None)]

    most = 0
    for n, rows in enumerate(per_page.in_pieces(groups(), [1])):
        most = max(most, sum(len(r[1] or b"") for r in rows))
        if not n:
            assert len(made) < 100  # the others aren't made yet
    assert len(made) == 500 and most <= per_page.OUT_BYTES + 100_000
    assert sum(map(len, per_page.in_pieces(groups(), [1]))) == 1000


def test_upright_lines_are_drawn_like_slanted_ones():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:30, :40]
    for _ in range(300):
        x0, x1, y0, y1 = rng.integers(-6, 46, 4).tolist()
        x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
        for width in (1, 2, 3, 7):
            bar = (np.maximum(0, np.maximum(x0 - x, x - x1)) ** 2 + (y - y0) ** 2) <= (width / 2) ** 2
            assert ((raster.drawn((30, 40), [[(x0, y0), (x1, y0)]], closed=False, width=width) > 0) == bar).all()
            assert ((raster.drawn((40, 30), [[(y0, x0), (y0, x1)]], closed=False, width=width) > 0) == bar.T).all()
        whole = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
        assert ((raster.drawn((30, 40), [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]], fill=True, width=1) > 0) == whole).all()


def test_holes():
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    assert abs(polygons.signed_area(polygons.bridged(outer, [hole]))) == 96
    parts = polygons.split_at_holes(outer, [hole])
    assert [abs(polygons.signed_area(p)) for p in parts] == [48, 48] and all(max(p[0] for p in q) - min(p[0] for p in q) == 5 for q in parts)
    assert polygons.split_at_holes(outer, []) == [outer]
    two = polygons.split_at_holes(outer, [hole, [(1, 1), (2, 1), (2, 2), (1, 2)][::-1]])
    assert len(two) == 3 and abs(sum(abs(polygons.signed_area(p)) for p in two) - 95) < 1e-9


def test_outlines_without_holes_cover_the_same(spark):
    got = queries.queries()["outlines_without_holes"](spark, SF).collect()
    lines = {}
    for r in queries.Layout(spark, SF).table("fx_line").orderBy("page_id", "y", "x", "w", "h").collect():
        lines.setdefault(r.page_id, []).append(r)
    for r in got[:200]:
        xs, ys, area, end = [], [], 0, -1
        for z in lines[r.page_id]:
            if z.y > end:
                xs, ys, area, end = [*xs, z.x, z.x + z.w], [*ys, z.y, z.y + z.h], area + z.w * z.h, z.y + z.h
        whole = (max(xs) - min(xs) + 18) * (max(ys) - min(ys) + 18) - area
        assert abs(r.area_of_joined - whole) < 1e-6 and abs(r.area_of_parts - whole) < 1e-6


def test_augmentation(spark):
    feature = [float(k + 1) for k in range(17)]
    df = spark.createDataFrame([(1, feature), (2, feature[:4]), (3, feature[:12])], "k int, f array<double>")
    rows = df.select("k", augment.scaled(F.col("f"), F.lit(2.0), F.lit(3.0)).alias("s"), augment.moved(F.col("f"), F.lit(10.0), F.lit(20.0)).alias("m"), augment.rotated(F.col("f"), F.lit(math.pi / 2), F.lit(0.0), F.lit(0.0)).alias("r")).orderBy("k").collect()
    assert rows[0].s == [2, 6, 6, 12, 10, 18, 14, 24, 18, 30, 22, 36, 13, 14, 15, 48, 17]
    assert rows[1].s == [2, 6, 6, 12] and rows[2].s == rows[0].s[:12]
    assert rows[0].m == [1, 2, 13, 24, 5, 6, 17, 28, 9, 10, 21, 32, 13, 14, 15, 16, 17] and rows[1].m == [1, 2, 13, 24]
    assert np.allclose(rows[0].r[:12], [1, 2, -4, 3, 5, 6, -8, 7, 9, 10, -12, 11]) and np.allclose(rows[1].r, [1, 2, -4, 3])
    draws = spark.range(4000).select(augment.normal(F.col("id"), "x", 0.04, 1.0).alias("n"), augment.uniform(F.col("id"), "u").alias("u")).agg(F.avg("n"), F.stddev("n"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(draws[0] - 1) < 0.004 and abs(draws[1] - 0.04) < 0.003 and abs(draws[2] - 0.5) < 0.02 and draws[3] > 0 and draws[4] < 1


def test_early_stopping_by_hand(spark):
    from pagelattice.operators.sqlop import OPERATORS

    days = [(f"2024-01-{d:02d} 10:00:00", "loss", float(v)) for d, v in ((1, 5), (2, 7), (3, 7), (4, 6), (5, 6), (6, 9))]
    events = spark.createDataFrame(days, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = OPERATORS["early_stopping"](events=events).orderBy("step").collect()
    first = got[0].step
    assert [(r.step - first, r.best_step - first, r.stopped) for r in got] == [(0, 0, 0), (1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1), (5, 5, 1)]


def test_truth_words_are_refused(spark):
    from pagelattice.operators.sqlop import OPERATORS

    text = OPERATORS["booleans"].spark[0][1]
    with pytest.raises(Exception, match="not a truth value"):
        spark.sql(f"select {text} as x").collect()


def test_elimination_by_loops(spark):
    wins = {(r.method0, r.method1): r.wins for r in queries.queries()["win_matrix"](spark, SF).collect()}
    methods = sorted({a for a, _ in wins})
    total, want, turn = {m: sum(wins[m, o] for o in methods) for m in methods}, set(), 1
    while total:
        out = sorted(total, key=lambda m: (total[m], m))[0]
        want |= {(turn, m, n, m == out) for m, n in total.items()}
        total, turn = {m: n - wins[m, out] for m, n in total.items() if m != out}, turn + 1
    assert {tuple(r) for r in queries.queries()["elimination"](spark, SF).collect()} == want


def test_metadata_order(spark):
    wrap = lambda inner: f"<PcGts><Metadata>{inner}</Metadata><Page imageWidth='1' imageHeight='2'/></PcGts>"
    first = "<Creator>a</Creator><Created>b</Created><LastChange>c</LastChange>"
    cases = {first: True, first + "<Comments>x</Comments>": True, first + "<TranskribusMetadata docId='1'/>": True, first + "<Comments/><TranskribusMetadata docId='1'/>": True, first + "<TranskribusMetadata/><Comments/>": False, "<Created>b</Created><Creator>a</Creator><LastChange>c</LastChange>": False, "<Creator>a</Creator>": False}
    rows = [(k, wrap(x)) for k, x in enumerate(cases)] + [(90, "<PcGts/>"), (91, "no xml"), (92, None), (93, wrap(first).replace("<Page", f"<Metadata>{first}</Metadata><Page"))]
    got = {r.page_id: r.is_valid for r in pagexml.parse(spark.createDataFrame(rows, "page_id int, xml string")).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and not any(got[k] for k in (90, 91, 92, 93))


def test_graph_json(spark):
    nodes = spark.createDataFrame([(1, 1, [3.0, 4.0]), (1, 0, [1.0, 2.0]), (2, 0, [5.0, 6.0])], "page_id int, node int, features array<double>")
    edges = spark.createDataFrame([(1, 0, 1, [9.0])], "page_id int, src int, dst int, features array<double>")
    relations = spark.createDataFrame([(1, 1, 0)], "page_id int, i int, j int")
    texts = files.graph_json(nodes, edges, relations)
    assert texts.where("page_id = 1").first().json == '{"num_nodes":2,"interacting_nodes":[[0,1]],"num_interacting_nodes":1,"node_features":[[1.0,2.0],[3.0,4.0]],"edge_features":[[9.0]],"gt_relations":[[1,0]],"gt_num_relations":1}'
    got = {r.page_id: r for r in files.parsed_graphs(texts, [1]).collect()}
    assert got[1].node_features == [[2.0], [4.0]] and got[2].interacting_nodes == [] and files.graph_folder(15, "delaunay", 1, True, "line") == "json15d1vline"


def test_stacks_of_images_are_measured_as_one_by_one():
    rng = np.random.default_rng(6)
    images = [np.zeros((4, 5), np.uint8), np.full((3, 3), 9, np.uint8), np.array([[7]], np.uint8)]
    for k in range(120):
        image = np.full(rng.integers(1, 60, 2), 225 - k % 3, np.uint8)
        for _ in range(rng.integers(0, 9)):
            y, x, h, w = rng.integers(0, 40, 4)
            image[y : y + h // 5, x : x + w] = rng.integers(0, 60) if k % 4 else 20
        images.append(rng.integers(0, 256, image.shape).astype(np.uint8) if k % 10 == 9 else image)
    for few in (images[:1], images[3:40], images):
        stack, *size = raster.stacked(few)
        mask, threshold = raster.many_binarized(stack, *size)
        masks = [raster.binarize(im) for im in few]
        assert threshold.tolist() == [raster.otsu(im) for im in few]
        assert all((m[: o.shape[0], : o.shape[1]] == o).all() and m.sum() == o.sum() for m, o in zip(mask, masks, strict=True))
        image, _, _, _, root = raster.runs(mask)
        assert np.bincount(image[root == np.arange(len(root))], minlength=len(few)).tolist() == [len(raster.connected(m)) for m in masks]
        assert raster.many_distances(mask).max(axis=(1, 2)).tolist() == [raster.distances(m).max() for m in masks]
        for how, kernel in (("open", (1, 5)), ("close", (3, 15)), ("open", (4, 2))):
            got = raster.many_morphed(mask, how, kernel, *size)
            assert all((g[: o.shape[0], : o.shape[1]] == o).all() and g.sum() == o.sum() for g, m in zip(got, masks, strict=True) for o in [raster.morphology(m, how, kernel)])
        for depth in (0, 1, 4):
            boxes, of = raster.many_xy_cuts(mask, *size, depth=depth)
            assert [list(map(tuple, boxes[of == k].tolist())) for k in range(len(few))] == [raster.xy_cut(m, depth) for m in masks]
        assert raster.many_rotations(mask)[0].tolist() == [raster.rotation(m) for m in masks]
    seen = []
    assert raster.by_size(images, lambda own: seen.append(len(own)) or [im.shape for im in own], 5000) == [im.shape for im in images] and len(seen) > 3


def test_strokes_of_many_images_are_those_of_one_by_one():
    rng = np.random.default_rng(7)
    images = [np.array([[7]], np.uint8), np.full((2, 3), 9, np.uint8), np.full((30, 40), 20, np.uint8), rng.integers(0, 256, (40, 50)).astype(np.uint8)]
    for _ in range(60):
        image = np.full(rng.integers(2, 90, 2), 225, np.uint8)
        for _ in range(rng.integers(1, 12)):
            y, x, h, w = rng.integers(0, 70, 4)
            image[y : y + h // 3, x : x + w // 2] = 20
        images.append(image)
    for few in (images[:2], images[4:], images):
        depth, heights, widths = raster.many_stroke_images(few)
        own = [raster.stroke_image(im) for im in few]
        assert all((d[: o.shape[0], : o.shape[1]] == o).all() and d.sum() == o.sum() for d, o in zip(depth, own, strict=True))
        boxes = [tuple(np.sort(rng.integers(0, n, 2)).tolist() for n in o.shape) for o in own]
        assert raster.many_strokes([o[y0 : y1 + 1, x0 : x1 + 1] for o, ((y0, y1), (x0, x1)) in zip(own, boxes, strict=True)]) == [raster.strokes(o, (x0, y0, x1, y1)) for o, ((y0, y1), (x0, x1)) in zip(own, boxes, strict=True)]


def test_ground_truth_of_a_page_keeps_every_pixel(spark):
    """The bands and the PNG of ground_truth_images against the plain drawing of every page, and what leaves a worker."""
    from pagelattice.plans import queries
    from pagelattice.sources import images

    folder = "/root/testdata/sf0.001"
    pages: dict = {}
    for r in queries.Layout(spark, folder).table("fx_region").collect():
        pages.setdefault(r.page_id, []).append((r.x0 // 4, r.y0 // 4, r.x1 // 4, r.y1 // 4, r.region_type or "paragraph"))
    got: dict = {}
    for r in queries.queries()["ground_truth_images"](spark, folder).collect():
        got.setdefault(r.page_id, {})[r.channel] = r
    assert set(got) == set(pages)
    for page, boxes in pages.items():
        shape = (max(b[3] for b in boxes) + 2, max(b[2] for b in boxes) + 2)
        rings = {n: [[(a, b), (c, b), (c, d), (a, d)] for a, b, c, d, kind in boxes if kind == n] for n in ("heading", "paragraph", "caption")}
        wanted = raster.ground_truth(shape, rings) | {"baselines": raster.drawn(shape, [[(a, d), (c, d)] for a, _, c, d, _ in boxes], closed=False, width=3)}
        assert list(got[page]) == list(wanted)
        for name, image in wanted.items():
            r = got[page][name]
            assert (images.decode_png(bytes(r.image)) == image).all()
            assert (r.n_regions, r.n_pixels, r.share) == (len(rings.get(name, [])), (image > 0).sum(), round(float((image > 0).mean()), 6))
            assert len(r.image) < image.size / 20 + 200
    noise = np.random.default_rng(3).random((40, 1003)) < 0.5
    assert (images.decode_png(images.encode_png(noise, np.full(40, 3))) == np.repeat(noise, 3, axis=0) * 255).all()


def test_noise_is_drawn_once_a_row(spark):
    """No lambda draws anew for each feature; arrays of any size keep what isn't touched."""
    from pagelattice.plans import queries

    plan = queries.queries()["augmented_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("md5(") <= 3 + 2 * (2 + 2) + 3 * 2 + 3 * 8
    rows = [(n, [float(n + k) for k in range(n)]) for n in (4, 5, 12, 15, 16, 17, 40)] + [(99, None)]
    got = spark.createDataFrame(rows, "k int, f array<double>").select("k", augment.moved(F.col("f"), F.lit(10.0), F.lit(20.0)).alias("m"), augment.scaled(F.col("f"), F.lit(2.0), F.lit(3.0)).alias("s")).collect()
    for r in got:
        f = dict(rows)[r.k]
        if f is None:
            assert r.m is None and r.s is None
            continue
        own = [k < 4 or (k < 12 and len(f) >= 12) for k in range(len(f))]
        assert r.m == [v + (10 if k % 2 == 0 else 20) if ok and k in (2, 3, 6, 7, 10, 11) else v for k, (v, ok) in enumerate(zip(f, own, strict=True))]
        assert r.s == [v * (2 if k % 2 == 0 else 3) if ok else v * 3 if k == 15 and len(f) >= 16 else v for k, (v, ok) in enumerate(zip(f, own, strict=True))]
