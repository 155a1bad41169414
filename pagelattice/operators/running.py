"""Running sums and numbers over all rows, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, head: Column, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, for each column of sums, its sum over all rows up to each (named by the value) in order.

    head is an expression that ascends with the order and cuts it into stretches: the stretches' own sums come
    first, so one window holds a row a stretch and the others the rows of one.
    """
    at = df.withColumn("_head", head)
    whole = at.groupBy("_head").agg(*[F.sum(c).alias(f"_{n}") for c, n in sums.items()])
    before = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_head", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums.values()])
    inner = Window.partitionBy("_head").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = at.select("*", *[F.sum(c).over(inner).alias(n) for c, n in sums.items()]).join(whole, "_head")
    return got.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums.values()])


def places(df: DataFrame, head: Column, order: list[str]) -> DataFrame:
    """df with place, each row's number from 1 in order (which must leave no ties)."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), head, order, {"_one": "place"}).drop("_one")
