"""Noise on a page's features, as column expressions over an array of features.

A feature array holds width, height and centre of a region (0 to 3), with 12 or more also sizes and centres of its first and
last baseline (4 to 11), and with 16 or more its text height (15).  Noise is a hash of the page (or node), a name and a seed: the
same on every run, and in any engine that has md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the features that a change touches: x sizes and centres, y sizes and centres, x and y of centres.
XS, YS, TEXT_HEIGHT, CENTRES = (0, 2, 4, 6, 8, 10), (1, 3, 5, 7, 9, 11), 15, ((2, 3), (6, 7), (10, 11))
SCALE, ANGLE, SHIFT_PAGE, SHIFT_NODE = 0.04, 0.052, 0.01, 0.005


def uniform(key: Column, name: str) -> Column:
    """A number in (0, 1)."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{name}")).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(key: Column, name: str, deviation: float, mean: float = 0.0) -> Column:
    """A normal number, from two uniform ones."""
    return mean + deviation * F.sqrt(-2 * F.log(uniform(key, name + "1"))) * F.cos(2 * math.pi * uniform(key, name + "2"))


def _rebuilt(features: Column, new: dict[int, Column]) -> Column:
    """Features with new values at some places; those of baselines need 12 features, the text height 16.

    Place by place, without a lambda: in a lambda Spark works out anew, for each feature, what all of them share.
    """
    size, most = F.size(features), TEXT_HEIGHT + 1
    old = lambda i: F.get(features, F.lit(i))
    places = [new[i] if i in new and i < 4 else F.when(size >= (12 if i < 12 else most), new[i]).otherwise(old(i)) if i in new else old(i) for i in range(most)]
    whole = F.concat(F.slice(F.array(*places), F.lit(1), F.least(size, F.lit(most))), F.slice(features, F.lit(most + 1), F.greatest(size - most, F.lit(0))))
    return F.when(features.isNotNull(), whole)


def scaled(features: Column, across: Column, down: Column) -> Column:
    by = dict.fromkeys(XS, across) | dict.fromkeys((*YS, TEXT_HEIGHT), down)
    return _rebuilt(features, {i: F.get(features, F.lit(i)) * by[i] for i in by})


def rotated(features: Column, angle: Column, centre_x: Column, centre_y: Column) -> Column:
    """Centres turned about a point."""
    new = {}
    for i, k in CENTRES:
        x, y = F.get(features, F.lit(i)) - centre_x, F.get(features, F.lit(k)) - centre_y
        new |= {i: F.cos(angle) * x - F.sin(angle) * y + centre_x, k: F.sin(angle) * x + F.cos(angle) * y + centre_y}
    return _rebuilt(features, new)


def moved(features: Column, dx: Column, dy: Column) -> Column:
    return _rebuilt(features, {i: F.get(features, F.lit(i)) + by for pair in CENTRES for i, by in zip(pair, (dx, dy), strict=True)})


def augmented(nodes: DataFrame, page: str, node: str, seed: int = 0) -> DataFrame:
    """nodes(page, node, features) with each of scaling, rotation and translation at a half of the pages.

    Scaling and rotation are the page's, translation the page's and the node's own; a page turns about the mean of its centres.
    """
    key, own = F.col(page), F.concat_ws("-", F.col(page).cast("string"), F.col(node).cast("string"))
    name = lambda n: f"{seed}{n}"
    on = lambda n: uniform(key, name(n)) < 0.5
    f = F.col("features")
    # what is drawn is a column of its own, so that it is drawn once a row
    drawn = lambda n, **of: {f"_{n}": on(n)} | {f"_{k}": F.when(on(n), c) for k, c in of.items()}
    shift = lambda axis: normal(own, name("own" + axis), SHIFT_NODE) + normal(key, name("all" + axis), SHIFT_PAGE)
    got = nodes.withColumns(drawn("scale", across=normal(key, name("x"), SCALE, 1.0), down=normal(key, name("y"), SCALE, 1.0)))
    got = got.withColumn("features", F.when(F.col("_scale"), scaled(f, F.col("_across"), F.col("_down"))).otherwise(f))
    whole = Window.partitionBy(page)
    got = got.withColumns({"_cx": F.avg(F.get(f, 2)).over(whole), "_cy": F.avg(F.get(f, 3)).over(whole)} | drawn("turn", angle=normal(key, name("angle"), ANGLE)) | drawn("move", dx=shift("x"), dy=shift("y")))
    got = got.withColumn("features", F.when(F.col("_turn"), rotated(f, F.col("_angle"), F.col("_cx"), F.col("_cy"))).otherwise(f))
    got = got.withColumn("features", F.when(F.col("_move"), moved(f, F.col("_dx"), F.col("_dy"))).otherwise(f))
    return got.drop("_cx", "_cy", *(f"_{n}" for n in ("scale", "across", "down", "turn", "angle", "move", "dx", "dy")))
