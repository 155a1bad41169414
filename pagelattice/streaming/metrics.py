"""Incremental forms: counters that a stream keeps up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_counts(scores: DataFrame, steps: int = 200) -> DataFrame:
    """Scores(p, y) counted by the last of steps + 1 thresholds that they reach (-1: none), batch or stream: bucket, pos, neg."""
    bucket = F.least(F.lit(steps), F.floor(F.col("p") * steps + 1e-9).cast("int"))  # scores a rounding below a threshold reach it
    one = lambda y: F.sum(F.when(F.col("y") == y, 1).otherwise(0)).cast("long")
    return scores.groupBy(F.greatest(F.lit(-1), bucket).alias("bucket")).agg(one(1).alias("pos"), one(0).alias("neg"))


def confusion_counts(buckets: DataFrame, steps: int = 200) -> DataFrame:
    """k, tp, fp, tn, fn at every threshold k / steps, from bucket_counts; all windows here hold steps + 2 rows."""
    every = buckets.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("k"))
    got = every.join(buckets, F.col("k") == F.col("bucket"), "left").select("k", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    up, all_ = Window.orderBy(F.desc("k")), Window.partitionBy()
    got = got.select("k", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(all_).alias("p"), F.sum("neg").over(all_).alias("n"))
    return got.where("k >= 0").select("k", "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def windowed(events: DataFrame, time: str, key: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and mean of a value by tumbling window and key; rows later than the watermark are dropped on a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    got = marked.groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return got.select(F.col("window.start").alias("start"), key, "n", "mean")


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drives a stream over what there is and gives its table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
