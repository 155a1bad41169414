"""Declared operators on small tables whose rows are worked out by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import aggregates, extraction, joins, windows_sets  # noqa: F401
from pagelattice.operators.sqlop import OPERATORS

REGION = "page_id long, region_no long, x0 long, x1 long, y0 long, y1 long, n_lines long, region_type string"
SEP = "page_id long, x0 long, x1 long, y0 long, y1 long, orientation string"
LINE = "page_id long, line_no long, region_no long, gt_id long, hyp_id long, x long, y long, w long, h long, txt string"
EDGE = "page_id long, src long, dst long, score double, u0 double, u1 double"


@pytest.fixture
def run(spark):
    def go(name, *columns, **tables):
        kinds = {"fx_region": REGION, "fx_sep": SEP, "fx_line": LINE, "fx_page": "page_id long, width long, height long, method string", "fx_edge": EDGE}
        out = OPERATORS[name](**{n: spark.createDataFrame(rows, kinds[n]) for n, rows in tables.items()})
        return sorted((tuple(r) for r in out.select(*columns).collect()), key=str)

    return go


def region(n, x0, x1, y0, y1, kind=None, lines=1, page=1):
    return (page, n, x0, x1, y0, y1, lines, kind)


def line(n, x, y, w, h=20, region=1, gt=0, hyp=0, txt="a", page=1):
    return (page, n, region, gt, hyp, x, y, w, h, txt)


def test_separators_between_boxes(run):
    regions = [region(1, 0, 100, 0, 50), region(2, 0, 100, 100, 150), region(3, 200, 300, 0, 50)]
    seps = [(1, 0, 100, 70, 74, "horizontal"), (1, 150, 154, 0, 40, None)]  # the second is ten times as high as wide
    got = run("edge_separator", "ra", "rb", "hsep", "vsep", fx_region=regions, fx_sep=seps)
    # 1 and 2 have the first between them; 1 and 3, as 2 and 3, the second, beside at least one of them
    # the first lies between the top of 1 and the bottom of 2, also where 3 is the upper one, as only both on one side are off
    assert got == [(1, 2, 1, 0), (1, 3, 0, 1), (2, 1, 1, 0), (2, 3, 1, 1), (3, 1, 0, 1), (3, 2, 1, 1)]
    low = [(1, 0, 100, 70, 90, None)]  # five times as wide as high: level
    assert run("edge_separator", "ra", "rb", "hsep", "vsep", fx_region=regions[:2], fx_sep=low) == [(1, 2, 1, 0), (2, 1, 1, 0)]
    assert run("edge_separator", "ra", "rb", "hsep", "vsep", fx_region=regions[:2], fx_sep=[(1, 100, 200, 70, 74, "horizontal")]) == [(1, 2, 0, 0), (2, 1, 0, 0)]


def test_pairs_in_one_column(run):
    regions = [region(1, 0, 100, 0, 50), region(2, 0, 100, 100, 150, "heading"), region(3, 200, 300, 100, 150), region(4, 90, 250, 200, 250)]
    got = run("separated_pairs", "i", "j", "by_separator", "by_heading", fx_region=regions, fx_sep=[(1, 0, 300, 74, 76, "horizontal"), (1, 0, 300, 160, 260, "vertical")])
    # 2 is a heading below 1; 4 lies below 2, so the heading is the upper one; only the level separator counts
    assert got == [(1, 2, 1, 1), (1, 3, 1, 0), (1, 4, 1, 0), (2, 3, 0, 0), (2, 4, 0, 0), (3, 4, 0, 0)]


def test_lines_between_centres(run):
    regions = [region(1, 0, 10, 0, 10), region(2, 0, 10, 100, 110), region(3, 100, 110, 0, 10)]
    got = run("edge_separator_line", "ra", "rb", "orientation", "n", fx_region=regions, fx_sep=[(1, 0, 20, 50, 54, "horizontal"), (1, 50, 54, 0, 20, "vertical"), (1, 500, 600, 0, 9, "horizontal")])
    assert got == [(1, 2, "horizontal", 1), (1, 3, "vertical", 1)]  # from 2 to 3 the way is between the two


def test_headings(run):
    lines = [line(1, 0, 0, 100, 20), line(2, 0, 0, 100, 20), line(3, 90, 0, 100, 40), line(4, 0, 50, 100, 20, region=2), line(5, 95, 0, 9, 20, region=3)]
    got = run("heading_confidence", "line_no", "stroke_width", "text_height", "confidence", "is_heading", fx_line=[(5, *x[1:]) for x in lines])
    # strokes (7 n + 5) mod 5 are 2, 4, 1, 3, 0; the net says 0, 0, 0.9, 0.5, 0.95
    two = lambda v: round(float(v), 4)
    assert [(a, two(b), two(c), two(d), e) for a, b, c, d, e in got] == [(1, 0.5, 0.0, 0.165, 0), (2, 1.0, 0.0, 1.0, 1), (3, 0.25, 1.0, 1.0, 1), (4, 0.75, 0.0, 0.4125, 0), (5, 0.0, 0.0, 1.0, 1)]


def test_small_regions_and_images(run):
    regions = [region(1, 0, 360, 0, 27), region(2, 0, 359, 0, 27), region(3, 0, 360, 0, 26), region(4, 0, 360, 0, 27, lines=0)]
    lines = [line(n, 0, 0, 5, region=n) for n in (1, 2, 3, 4)]
    assert run("discard_small_regions", "line_no", fx_region=regions, fx_line=lines) == [(1,)]  # 10 by 10 when scaled
    texts = [region(1, 0, 50, 0, 50), region(2, 279, 500, 0, 50), region(3, 281, 500, 0, 50), region(4, 10, 20, 10, 20), region(5, 10, 20, 10, 20, "heading"), region(6, 0, 500, 40, 90)]
    assert run("text_regions_off_images", "region_no", fx_region=texts, fx_sep=[(1, 0, 9, 0, 9, None)]) == [(3,)]
    assert run("text_regions_off_images", "region_no", fx_region=[region(7, 0, 500, 41, 90)], fx_sep=[(1, 0, 9, 0, 9, None)]) == [(7,)]


def test_border_lines(run):
    lines = [line(1, 10, 0, 100), line(2, 10, 0, 1000), line(3, 100, 0, 100), line(4, 1950, 0, 40), line(5, 80, 0, 10), line(6, 1910, 0, 10)]
    # the mean length is 210; short ones go if they begin before 80 or end beyond 1920
    assert run("border_lines", "line_no", fx_line=lines, fx_page=[(1, 2000, 1000, "m")]) == [(2,), (3,), (5,), (6,)]


def test_partitions(run):
    two = [line(1, 0, 0, 1, gt=1, hyp=1), line(2, 0, 0, 1, gt=1, hyp=2), line(3, 0, 0, 1, gt=2, hyp=2)]
    same = [line(1, 0, 0, 1, gt=1, hyp=7, page=2), line(2, 0, 0, 1, gt=3, hyp=5, page=2)]
    got = run("partition_compare", "page_id", "gt_nis", "hyp_nis", "corrects", "splits", "merges", "dist", "consistent", fx_line=two + same)
    assert got == [(1, 2, 2, 0, 1, -1, 2, True), (2, 2, 2, 2, 0, 0, 0, True)]
    assert run("overwrite_ids_by_region", "line_no", "article_id", fx_line=[line(1, 0, 0, 1, hyp=1), line(2, 0, 0, 1, hyp=0), line(3, 0, 0, 1, hyp=2), line(4, 0, 0, 1, hyp=2, region=2)]) == [(1, 0), (2, 0), (3, 0)]


def test_attention(run):
    edges = [(1, 1, 3, 0.0, 1.0, 2.0), (1, 2, 3, 0.0, 3.0, 4.0), (1, 3, 1, 5.0, 1.0, 1.0)]
    assert run("balanced_attention", "src", "dst", "weight", fx_edge=edges) == [(1, 3, 0.5), (2, 3, 0.5), (3, 1, 1.0)]
    assert run("softmax_attention", "src", "dst", "weight", fx_edge=edges) == [(1, 3, 0.5), (2, 3, 0.5), (3, 1, 1.0)]
    assert run("message_sum", "dst", "s0", "s1", "m0", "q0", fx_edge=edges) == [(1, 1.0, 1.0, 1.0, 1.0), (3, 4.0, 6.0, 3.0, 10.0)]


def test_cut_lines(run):
    lines = [line(1, 0, 0, 100), line(2, 45, 0, 9), line(3, 0, 500, 100)]
    got = run("split_lines", "line_no", "part", "x0", "x1", fx_line=lines, fx_sep=[(1, 40, 60, 0, 100, "vertical"), (1, 0, 100, 0, 4, "horizontal")])
    assert got == [(1, 0, 0, 40), (1, 1, 60, 100), (3, 0, 0, 100)]  # the second is covered, the third lies below


def test_blank_rectangles(run):
    lines = [line(1, 0, 0, 100, 20, gt=0), line(2, 0, 100, 100, 20, gt=0), line(3, 200, 0, 100, 20, gt=1)]
    seps = [(1, 10, 20, 40, 60, None), (1, 90, 210, 5, 15, None), (1, 500, 600, 0, 9, None)]
    assert run("blank_rectangles", "x0", "article_id", fx_sep=seps, fx_line=lines) == [(10, 0)]  # inside the box of article 0
    assert run("blank_by_parts", "x0", "article_id", fx_sep=seps, fx_line=[*lines[:1], (*lines[1][:2], 2, *lines[1][3:]), lines[2]]) == []


def test_reading_order_and_masks(run, spark):
    lines = [line(1, 50, 40, 9, 10), line(2, 0, 0, 9, 100), line(3, 0, 40, 9, 10)]
    assert run("reading_order", "line_no", "place", fx_line=lines) == [(1, 1), (2, 2), (3, 0)]
    got = OPERATORS["sequence_mask"](fx_region=spark.createDataFrame([region(1, 0, 1, 0, 1, lines=2)], REGION)).agg(F.count_if("used")).first()[0]
    assert got == 2
