"""Article rectangles, outlines and their smoothing, on cases worked by hand."""

import random

import numpy as np

from pagelattice.operators import clustering, polygons, rectangles
from pagelattice.operators.rectangles import TextLine


def line(article, name, x, y, w=100, outline=None):
    return TextLine(article, name, [(x, y), (x + w, y)], outline)


def boxes(placed):
    return {a: [(r.box, [x.name for x in r.lines]) for r in rs] for a, rs in placed.items()}


def test_lines_of_one_column_are_one_rectangle():
    got = rectangles.from_baselines([line("a", 3, 0, 60), line("a", 1, 0, 20), line("a", 2, 0, 40)])
    assert boxes(got) == {"a": [((0, 20, 101, 41), [1, 2, 3])]}


def test_a_lone_line_is_a_strip_above_it_unless_it_has_an_outline():
    got = rectangles.from_baselines([line("a", 1, 5, 50), line("b", 2, 5, 150, outline=[(5, 130), (105, 130), (105, 155), (5, 155)])])
    assert boxes(got) == {"a": [((5, 40, 101, 10), [1])], "b": [((5, 130, 101, 26), [2])]}


def test_a_rectangle_does_not_grow_over_another_article():
    # b's line between a's two: a stays in two pieces
    got = rectangles.from_baselines([line("a", 1, 0, 20), line("a", 2, 0, 60), line("b", 3, 0, 40)])
    assert boxes(got)["a"] == [((0, 10, 101, 10), [1]), ((0, 50, 101, 10), [2])]
    # a line that only touches the top row is cut off
    got = rectangles.from_baselines([line("a", 1, 0, 20), line("a", 2, 0, 60), TextLine("b", 3, [(200, 10), (300, 10)])])
    assert boxes(got)["a"] == [((0, 20, 101, 41), [1, 2])]


def test_columns_side_by_side():
    got = rectangles.from_baselines([line("a", 1, 0, 20), line("a", 2, 300, 22), line("a", 3, 0, 40), line("a", 4, 300, 42)])
    assert boxes(got) == {"a": [((0, 20, 101, 21), [1, 3]), ((300, 22, 101, 21), [2, 4])]}


def test_crosses():
    box = (10, 10, 20, 20)
    assert rectangles.crosses(box, [(0, 20), (50, 20)]) and rectangles.crosses(box, [(12, 12), (13, 13)]) and rectangles.crosses(box, [(0, 25), (25, 0)])
    assert not rectangles.crosses(box, [(0, 10), (50, 10)]) and not rectangles.crosses(box, [(0, 15), (15, 0)]) and not rectangles.crosses(box, [(31, 0), (31, 50)])
    assert not rectangles.crosses(box, [(15, 15)])


def test_aligned():
    at = lambda a, b: [(a, 0), (b, 0)]
    assert rectangles.aligned(at(0, 100), at(10, 90)) and rectangles.aligned(at(0, 100), at(-15, 50)) and rectangles.aligned(at(0, 100), at(15, 300))
    assert not rectangles.aligned(at(0, 100), at(120, 200)) and not rectangles.aligned(at(0, 100), at(-50, 50))


def test_stretching():
    ink = np.zeros((100, 100), np.uint8)
    ink[20:50, 10:60] = 1
    assert rectangles.stretched(ink, (10, 50, 50, 10)) == (10, 18, 50, 42)  # a strip of height 1 looks at two rows
    assert rectangles.stretched(ink, (10, 50, 50, 10), limit=5) == (10, 50, 50, 10)
    ink[:20, 10:60] = 1
    assert rectangles.stretched(ink, (10, 50, 50, 10)) == (10, 0, 50, 60)
    assert rectangles.stretched(ink, (10, 0, 50, 10)) == (10, 0, 50, 10)
    assert rectangles.is_white(ink, (70, 0, 5, 5)) and not rectangles.is_white(ink, (10, 0, 5, 5))


def rect(x, y, w, h):
    return rectangles.Rectangle((x, y, w, h))


def test_merging_from_top_to_bottom():
    a = [rect(0, 0, 100, 20), rect(0, 30, 100, 20), rect(0, 150, 100, 20), rect(10, 32, 20, 5)]
    got = rectangles.merged({"a": a})["a"]
    # the first two with the gap between them; the third is too far; the fourth lies inside the second
    assert got == [[(0, 0, 100, 20), (0, 30, 100, 20), (0, 20, 100, 10), (10, 32, 20, 5), (10, 20, 20, 12)], [(0, 150, 100, 20)]] or got[-1] == [(0, 150, 100, 20)]
    b = {"a": [rect(0, 0, 100, 20), rect(0, 30, 100, 20)]}
    assert rectangles.merged(b)["a"] == [[(0, 0, 100, 20), (0, 30, 100, 20), (0, 20, 100, 10)]]
    assert [sorted(x) for x in rectangles.outlines(rectangles.merged(b))["a"]] == [[(0, 0), (0, 50), (100, 0), (100, 50)]]
    assert rectangles.merged(b | {"z": [rect(50, 22, 20, 5)]})["a"] == [[(0, 0, 100, 20)], [(0, 30, 100, 20)]]  # something lies in the gap
    over = {"a": [rect(0, 0, 100, 20), rect(50, 10, 100, 20)]}
    assert rectangles.merged(over)["a"] == [[(0, 0, 100, 20), (50, 10, 100, 20), (50, 10, 50, 10)]]
    ring = rectangles.outlines(rectangles.merged(over))["a"]
    assert len(ring) == 1 and polygons.area(ring[0]) == 100 * 20 * 2 - 50 * 10
    assert polygons.area(rectangles.outlines(rectangles.merged(over), hull=True)["a"][0]) == 150 * 30 - 50 * 10


def test_smoothing():
    box = [(0, 0), (1000, 0), (1000, 800), (0, 800)]
    assert set(polygons.smooth(box)) == set(box)
    # small steps along the top become one side at their mean
    top = [(0, 0), (200, 0), (200, 6), (400, 6), (400, 0), (600, 0), (600, 6), (1000, 6), (1000, 800), (0, 800)]
    got = polygons.smooth(top)
    assert len(got) == 4 and {p[0] for p in got} == {0, 1000} and {p[1] for p in got} == {round(sum(p[1] for p in top[:8]) / 8), 800}
    # every side of a smoothed ring is level or upright
    rng = random.Random(2)
    for _ in range(20):
        ring = [(0, 0)]
        for _ in range(6):
            ring += [(ring[-1][0] + rng.randint(60, 200), ring[-1][1]), (ring[-1][0] + 200, ring[-1][1] + rng.randint(-8, 8))]
        ring += [(ring[-1][0], 700), (0, 700)]
        got = polygons.smooth(ring)
        assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(got, got[1:] + got[:1], strict=True))


def test_ticks_are_those_of_the_column_expression():
    from test_measure import plain_ticks

    rng = random.Random(7)
    for _ in range(60):
        ring = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(rng.randint(1, 6))]
        assert polygons.ticks(ring, 10).astype(int).tolist() == [list(p) for p in plain_ticks(ring, 10)]


def test_elbow():
    assert clustering.elbow([10, 3, 2, 1.5, 1.2, 1.0, 0]) == 2
    assert clustering.elbow([5, 5, 5]) is None and clustering.elbow([4, 3, 2, 1, 0]) in (None, 1, 2, 3, 4)
    conf = np.full((6, 6), 0.05)
    conf[:3, :3] = conf[3:, 3:] = 0.95
    assert clustering.validated(conf, "merge") == clustering.validated(conf) == [0, 0, 0, 1, 1, 1]
    assert clustering.validated(np.full((4, 4), 0.9)) == [0] * 4
    assert len(set(clustering.validated(np.full((3, 3), 0.1)))) in (2, 3)
    merges = clustering.linkage(-np.log(conf), "centroid")
    assert [len(set(clustering.cut_to(merges, 6, k))) for k in range(1, 7)] == [1, 2, 3, 4, 5, 6]
