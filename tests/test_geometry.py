import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.functions import geometry as geo
from pagelattice.functions import page_attributes as attr


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_points(spark):
    r = one(spark, a=geo.points(F.lit("0,0 1,2 3,4")), bad=geo.points(F.lit("0,0 1")), word=geo.points(F.lit("a,b")), p=geo.polygon(F.lit("1,2;3,4")), short=geo.polygon(F.lit("1,2")), t=geo.points_text(geo.points(F.lit("1,2 3,4 5,6"))))
    assert [tuple(p) for p in r.a] == [(0, 0), (1, 2), (3, 4)]
    assert r.bad is None and r.word is None and r.short is None
    assert [tuple(p) for p in r.p] == [(1, 2), (3, 4)] and r.t == "1,2 3,4 5,6"


def test_custom_attribute(spark):
    c = attr.parse(F.lit("readingOrder {index:4;} structure {type:catch-word;}"))
    r = one(spark, c=c, order=attr.reading_order(c), article=attr.article_id(c), text=attr.render(attr.with_article_id(c, F.lit("a7"))), gone=attr.with_value(c, "readingOrder", "index", F.lit(None).cast("string")))
    assert r.c == {"readingOrder": {"index": "4"}, "structure": {"type": "catch-word"}}
    assert r.order == 4 and r.article is None
    assert r.text == "readingOrder {index:4;} structure {id:a7; type:article;}"
    assert r.gone == {"readingOrder": {}, "structure": {"type": "catch-word"}}


def test_boxes(spark):
    n = lambda *v: [F.lit(x) for x in v]
    r = one(spark, i=geo.box_intersection(*n(0, 0, 10, 10, 5, 5, 10, 10)), apart=geo.box_intersection(*n(0, 0, 2, 2, 5, 0, 2, 2)), g=geo.gap(*n(0, 0, 2, 4, 5, 1, 2, 4)), none=geo.gap(*n(0, 0, 2, 2, 5, 5, 2, 2)), inside=geo.box_contains_point(*n(0, 0, 4, 4, 4, 4)), d=geo.point_box_distance(*n(0, 0, 3, 4, 9, 9)), a=geo.vertically_aligned(*n(0, 100, 15, 400)))
    assert tuple(r.i) == (5, 5, 5, 5) and r.apart.w == -3
    assert tuple(r.g) == (2, 1, 3, 3) and tuple(r.none) == (2, 2, 3, 3)
    assert not r.inside and r.d == 7 and r.a


def test_blow_up_and_thin_out(spark):
    line = geo.points(F.lit("0,0 100,50"))
    r = one(spark, b=geo.blow_up(line), t=geo.thin_out(geo.blow_up(line)), short=geo.thin_out(geo.blow_up(geo.points(F.lit("0,0 5,0")))))
    assert len(r.b) == 101 and tuple(r.b[1]) == (1, 1) and tuple(r.b[-1]) == (100, 50)
    assert len(r.t) == 21 and tuple(r.t[0]) == (0, 0) and tuple(r.t[-1]) == (100, 50)
    assert len(r.short) == 6


def test_orientation(spark):
    r = one(spark, flat=geo.orientation(geo.points(F.lit("0,0 10,0"))), back=geo.orientation(geo.points(F.lit("10,0 0,0"))), up=geo.orientation(geo.points(F.lit("0,10 0,0"))), down=geo.orientation(geo.points(F.lit("0,0 0,10"))))
    assert math.isclose(r.flat, 0) and math.isclose(r.back, math.pi) and math.isclose(r.up, math.pi / 2) and math.isclose(r.down, 1.5 * math.pi)


def test_contains_point_like_a_brute_force(spark):
    rng = random.Random(3)
    ring = [(0, 0), (10, 0), (10, 4), (6, 4), (6, 10), (0, 10)]
    pts = [(rng.uniform(-2, 12), rng.uniform(-2, 12)) for _ in range(200)]
    inside = lambda x, y: (0 < x < 10 and 0 < y < 4) or (0 < x < 6 and 0 < y < 10)
    df = spark.createDataFrame(pts, "x double, y double").withColumn("p", geo.points(F.lit(" ".join(f"{a},{b}" for a, b in ring))))
    for r in df.select("x", "y", geo.contains_point(F.col("p"), F.col("x"), F.col("y")).alias("c")).collect():
        assert r.c == inside(r.x, r.y)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25))
def test_hull_holds_all_points(points):
    from pagelattice.operators import polygons

    hull = polygons.convex_hull(points)
    assert set(hull) <= set(points)
    if len(hull) > 2:
        for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
            assert all(polygons.cross(a, b, p) >= 0 for p in points)
