"""Mixing sources to target weights (operator 5), in DataFrame functions.

Targets: sources share 150 % of all words by weight; a target stops at twice its source's
words, and the excess is shared again by weight.  Sources by saturation level (twice their
words over their weight) make this one pass of running sums: a source is full if its level is at
most what the others before it leave per unit of weight.

Blocks: rows of a source are dealt by a hash of doc_id and text into blocks of about
``block_words`` words (at most 2**24 blocks a source).  A source draws all its blocks once for
each whole pass of its target, and for the rest the first blocks of a hash order that fit, of the
next block the first documents that fit, and then up to four times the document of that
block that fits the gap best.

Shards: a multivariate-hypergeometric splitting tree deals the sources' quotas of block draws
to the output shards: a node halves its shards and draws, source by source, how many of
each source's blocks go to the left half.  Quotas are exact: no block is lost or drawn twice.
The tree has at most ``max_cells`` cells.  With more shards, its leaves are groups of shards, and each
group deals its own draws to its shards in a hash order, which is the same law; with more sources,
several share a stratum.  A leaf takes its run of every stratum's permuted draws.

``write_shards`` writes the documents into the shard that their block's draw went to, one
file a shard, shuffled in it by a hash; ``mix_report`` and ``mixed_documents`` read these files and nothing
else, so quotas and order are what a reader gets.  Texts are shuffled once, to their shard; a block's draws
reach its rows by a join on (source, block) that Spark broadcasts while it is small.

No task holds a source: sums over a source's blocks and the numbers of its draws are running sums over
4096 prefixes of the hash order and over the few rows of a prefix.  Copies of a text under one id are counted
before any shuffle.

Defined results: a null text has no words, and such documents take none; a null source
is a source, the last; rows that repeat doc_id and text go together, and rows that repeat an id with another text don't; a
null id is an id like others; a source without words has target 0; an empty table gives no rows; extra columns
are kept by the shards, whatever their names; all choices are hashes, so reruns agree.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import WORD
from .scratch import Scratch

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS, MAX_BLOCKS, SHARD_WORDS = 1 << 16, 1 << 24, 1 << 24
#: Cells (strata times leaves) of the splitting tree, and strata: what the driver holds and the plan carries (some 4 MB).
MAX_CELLS, MAX_STRATA = 1 << 16, 1 << 12
#: Tasks that write shards; with more shards, a task writes several, one after another.
MAX_TASKS = 1 << 14
#: Bytes of a row group, the least that a reader's task can take of a shard.
ROW_GROUP = 8 << 20
#: Documents that fill what the last block's first documents leave open, each the best fit.
FILL_ROUNDS = 4
#: Hexadecimal digits of a hash that make a prefix of its order, and copies that are counted out at once.
PREFIX, COUNTED = 3, 4096


def digest(*parts: Column) -> Column:
    """A hash as 32 hexadecimal digits, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def number(key: Column, digits: int) -> Column:
    """The first hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """What names a row within its source; rows that share it can't be told apart."""
    return digest(doc_id.cast("long"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, copies: rows that share id, text and source are one unit, counted before the shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", row_key(F.col("doc_id"), F.col("text")).alias("key"), words(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("copies"))


def targets(units: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row a source: source, place, weight, source_size, target."""
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # a row a source
    rows = totals.select("source", "source_size", place.alias("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    rows = rows.select("*", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", (share * F.sum("source_size").over(whole)).alias("all"), F.sum("weight").over(whole).alias("w"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("c0"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("w0"))
    rows = rows.withColumn("full", F.col("cap") / F.col("weight") <= (F.col("all") - F.col("c0")) / (F.col("w") - F.col("w0")))
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    used = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(whole)
    rows = rows.select("*", taken.alias("ct"), used.alias("wt"))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("all") - F.col("ct")) / (F.col("w") - F.col("wt")))
    return rows.select("source", "place", "weight", "source_size", target.alias("target"))


def block_number(key: Column, source_size: Column, block_words: int) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(source_size / F.lit(block_words)).cast("int")))
    return number(key, 6) % n


def running(df: DataFrame, part: str, key: str, value: str, tie: str, name: str) -> DataFrame:
    """Adds the sum of value over rows before each, by key (a hash) and tie within part, as name.

    Sums of the key's prefixes come first, so no window holds more than a part's prefixes or a prefix's rows.
    """
    prefix = F.substring(key, 1, PREFIX)
    whole = df.groupBy(F.col(part).alias("_part"), prefix.alias("_head")).agg(F.sum(value).alias("_sum"))
    heads = Window.partitionBy("_part").orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_part", "_head", F.coalesce(F.sum("_sum").over(heads), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(part, "_head").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    got = df.withColumn("_head", prefix).withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    got = got.join(whole, (got[part] == whole["_part"]) & (got["_head"] == whole["_head"]))
    return got.select(*df.columns, (F.col(name) + F.col("_before")).alias(name))


def blocks_of(units: DataFrame) -> DataFrame:
    """place, block, passes (whole passes of the source), whole, upto, fills of units with place, source_size, target, block.

    A block is drawn once more if whole; of the block where the rest runs out, rows with keys up to upto or among fills are.
    """
    units = units.select("place", "block", "key", (F.col("size") * F.col("copies")).alias("words"), "source_size", "target")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    blocks = units.groupBy("place", "block").agg(F.sum("words").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = blocks.withColumn("passes", passes).withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    blocks = running(blocks.withColumn("order", digest(F.col("place"), F.col("block"), F.lit("block"))), "place", "order", "words", "block", "before")
    whole = F.col("before") + F.col("words") <= F.col("rest")
    blocks = blocks.select("place", "block", "passes", whole.alias("whole"), F.when(~whole & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before")).alias("room"))
    # one block a source
    edge = units.join(blocks.where("room is not null").select("place", "block", "room"), ["place", "block"]).select("place", "block", "key", "words", "room")
    fits = Window.partitionBy("place").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("first", F.sum("words").over(fits) <= F.col("room")).withColumn("edge", F.col("first"))
    for _ in range(FILL_ROUNDS):
        gap = F.col("room") - F.sum(F.when(F.col("edge"), F.col("words")).otherwise(0)).over(Window.partitionBy("place"))
        off = F.abs(F.col("words") - F.col("gap"))
        best = F.first("key").over(Window.partitionBy("place").orderBy("edge", off, "key"))
        edge = edge.withColumn("gap", gap).withColumn("best", best).withColumn("edge", F.col("edge") | ((F.col("key") == F.col("best")) & (off < F.col("gap"))))
    picked = edge.groupBy("place", "block").agg(F.max(F.when(F.col("first"), F.col("key"))).alias("upto"), F.collect_list(F.when(F.col("edge") & ~F.col("first"), F.col("key"))).alias("fills"))
    return blocks.drop("room").join(picked, ["place", "block"], "left")


def split(quotas: dict[int, int], shards: int, seed: int = 5) -> list[dict[int, int]]:
    """The leaves of the splitting tree: of every shard, how many block draws of each source it takes."""
    rng = random.Random(seed)

    def draw(good: int, bad: int, n: int) -> int:
        """Hypergeometric: how many of n drawn from good + bad are good, by inversion from the mode outwards."""
        low, high = max(0, n - bad), min(n, good)
        if low == high:
            return low
        logc = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
        mass = math.exp(logc(good, mode) + logc(bad, n - mode) - logc(good + bad, n))
        u = rng.random() - mass
        if u < 0:
            return mode
        up, down, p, q = mode, mode, mass, mass
        while up < high or down > low:
            if up < high:
                p *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
                up += 1
                u -= p
                if u < 0:
                    return up
            if down > low:
                q *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
                down -= 1
                u -= q
                if u < 0:
                    return down
            if p < 1e-18 and q < 1e-18:
                break
        return mode

    def node(counts: dict[int, int], n: int) -> list[dict[int, int]]:
        if n == 1:
            return [counts]
        total = sum(counts.values())
        wanted = total * (n // 2) // n
        left: dict[int, int] = {}
        for source in sorted(counts):
            total -= counts[source]
            left[source] = draw(counts[source], total, wanted)
            wanted -= left[source]
        return node(left, n // 2) + node({s: c - left[s] for s, c in counts.items()}, n - n // 2)

    return node(dict(quotas), shards)


@dataclass
class Mix:
    """units: doc_id, source, key, size, copies, source_size, target; plan: targets(); blocks: with their draws (turn, shard)."""

    units: DataFrame
    plan: DataFrame
    blocks: DataFrame
    shards: int
    block_words: int


def deal(blocks: DataFrame, sources: int, shards: int, scratch: Scratch, max_cells: int) -> DataFrame:
    """place, block, draws: the shard of every draw of every block, by the splitting tree."""
    strata = max(1, min(sources, MAX_STRATA, max_cells))
    groups = min(shards, 1 << int(math.log2(max(1, max_cells // strata))))
    drawn = blocks.withColumn("n", F.col("passes") + (F.col("whole") | F.col("upto").isNotNull() | (F.coalesce(F.size("fills"), F.lit(0)) > 0)).cast("int")).where("n > 0")
    drawn = drawn.select("place", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("turn"))
    drawn = drawn.select("*", (F.col("place") % strata).alias("stratum"), digest(F.col("place"), F.col("block"), F.col("turn")).alias("order"), F.lit(1).alias("one"))
    drawn = drawn.withColumn("tie", F.struct("place", "block", "turn"))
    drawn = scratch.table(running(drawn, "stratum", "order", "one", "tie", "ordinal").drop("tie", "one"), "draws")
    quotas = {r.stratum: r.n for r in drawn.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # at most MAX_STRATA rows
    runs, at = [], dict.fromkeys(quotas, 0)
    for group, counts in enumerate(split(quotas, groups)):
        for stratum, n in counts.items():
            if n:
                runs.append({"stratum": stratum, "group": group, "lo": at[stratum], "hi": at[stratum] + n - 1})
                at[stratum] += n
    kind = "array<struct<stratum:int,group:int,lo:long,hi:long>>"
    located = drawn.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(runs)), kind)).alias("r")).select("r.*")
    located = located.select("stratum", "group", F.explode(F.sequence("lo", "hi")).alias("ordinal"))
    placed = drawn.join(located, ["stratum", "ordinal"]).select("place", "block", "turn", "group", "order")
    if groups < shards:  # a group's draws, in another hash order, fill its shards evenly
        placed = placed.withColumn("again", digest(F.col("order"), F.lit("shard")))
        here = F.row_number().over(Window.partitionBy("group").orderBy("again", "place", "block", "turn")) - 1
        every = F.count("*").over(Window.partitionBy("group"))
        inner = F.floor(here * (shards // groups) / every).cast("int")
        placed = placed.withColumn("group", F.col("group") * (shards // groups) + inner)
    return placed.groupBy("place", "block").agg(F.collect_list(F.struct("turn", F.col("group").alias("shard"))).alias("draws"))  # a few a block


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_cells: int = MAX_CELLS) -> Mix:
    """Which blocks of docs(doc_id, source, text) are taken, how often, and into which shard each time."""
    scratch = Scratch(docs.sparkSession, "mixing")
    units = scratch.table(units_of(docs), "units")
    plan = scratch.table(targets(units, weights, share, most).coalesce(1), "targets")
    units = units.join(plan, units.source.eqNullSafe(plan.source)).drop(plan.source)
    blocks = units.withColumn("block", block_number(F.col("key"), F.col("source_size"), block_words))
    blocks = scratch.table(blocks_of(blocks), "blocks")
    whole = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("words"), F.count("*").alias("sources")).first()
    shards = 1 << max(0, math.ceil(math.log2(max(1.0, whole.words / shard_words))))
    draws = deal(blocks, whole.sources, shards, scratch, max_cells)
    return Mix(units, plan, scratch.table(blocks.join(draws, ["place", "block"]), "dealt"), shards, block_words)


def write_shards(docs: DataFrame, folder: str, **options) -> Mix:
    """Mixes docs and writes the shards: a file each under folder/shard=<number>, its rows place, key, position and doc (all columns), by position."""
    got = mix(docs, **options)
    rows = docs.select(F.struct("*").alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    plan = got.plan.select("source", "place", "source_size").where("source_size > 0")
    rows = rows.join(plan, F.col("doc.source").eqNullSafe(plan.source)).drop(plan.source)
    rows = rows.withColumn("block", block_number(F.col("key"), F.col("source_size"), got.block_words)).drop("source_size")
    rows = rows.join(got.blocks, ["place", "block"])
    extra = F.coalesce(F.col("whole") | (F.col("key") <= F.col("upto")), F.col("whole")) | F.coalesce(F.array_contains("fills", F.col("key")), F.lit(False))
    takes = F.filter("draws", lambda d: (d["turn"] < F.col("passes")) | extra)
    rows = rows.select("place", "key", "doc", F.explode(takes).alias("draw")).select("place", "key", "doc", "draw.*")
    # a shard (some shard_words words) lies in one task and is sorted there
    tasks = min(got.shards, MAX_TASKS)
    rows = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / got.shards).cast("int"))
    position = digest(F.col("key"), F.col("turn"), F.col("shard"))
    rows = rows.select("shard", "place", "key", position.alias("position"), "doc").sortWithinPartitions("shard", "position")
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": 6, "parquet.block.size": ROW_GROUP}
    rows.write.partitionBy("shard").options(**options).parquet(folder)
    return got


def read_shards(docs: DataFrame, folder: str) -> DataFrame:
    """shard, place, key, position, doc of all files; docs gives the columns of doc."""
    kind = docs.select(F.lit(0).alias("place"), F.lit("").alias("key"), F.lit("").alias("position"), F.struct("*").alias("doc"), F.lit(0).alias("shard")).schema
    return docs.sparkSession.read.schema(kind).parquet(folder)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: the words of it that the shards hold."""
    folder = Scratch(docs.sparkSession, "mixed").folder("shards")
    got = write_shards(docs, folder, **options)
    held = read_shards(docs, folder).select("place", "key", words(F.col("doc.text")).alias("held")).groupBy("place", "key").agg(F.sum("held").alias("held"))
    rows = got.units.join(held, ["place", "key"], "left")
    taken = F.coalesce(F.col("held") / F.col("copies"), F.lit(0)).cast("long")
    rows = rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")
    # copies are counted out in runs of bounded length, dealt anew in between
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COUNTED))))
    length = F.least(F.lit(COUNTED), F.col("copies") - F.col("run") * COUNTED).cast("int")
    runs = runs.select("doc_id", "size", "source_size", "target", "taken", length.alias("length")).hint("rebalance")
    return runs.withColumn("length", F.explode(F.sequence(F.lit(1), F.col("length")))).drop("length")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The shards' documents: docs with each row as often as the mix takes it, in files by shard, in each by position."""
    folder = Scratch(docs.sparkSession, "mixed").folder("shards")
    write_shards(docs, folder, **options)
    return read_shards(docs, folder).select("doc.*")
