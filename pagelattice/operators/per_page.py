"""Applies a function to the rows of each page, many pages to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes and rows of results after which they leave a worker.
OUT_BYTES, OUT_ROWS = 4 << 20, 20_000
#: Pages that are worked on together.
TOGETHER = 500


def in_pieces(groups: Iterable[list[tuple]], wide: list[int]) -> Iterator[list[tuple]]:
    """The groups' rows in lists of about OUT_BYTES of the wide columns or OUT_ROWS, each group's as soon as it is made."""
    rows, held = [], 0
    for found in groups:
        rows += found
        held += sum(len(r[k] or b"") for r in found for k in wide)
        if held > OUT_BYTES or len(rows) > OUT_ROWS:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def per_page(df: DataFrame, keys: list[str], values: list[str], function: Callable[[dict[str, np.ndarray]], list[tuple]], columns: str, together: int = 0) -> DataFrame:
    """The function's tuples for each group, behind the group's keys.

    With together it gets a list of that many groups at most, and gives a list for each: what is alike in many pages is then done at once.

    A group's rows are gathered in the JVM with map-side partials and sorted by the values in
    their order; a group is one page (or a part of one), which is bounded by what a page holds.
    The function gets a numpy array for each value.  Results leave in pieces of OUT_BYTES or OUT_ROWS, as a page may give images.
    """
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("_rows"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + columns
    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    wide = [k for k, f in enumerate(out_schema) if k >= len(keys) and (pa.types.is_binary(f.type) or pa.types.is_string(f.type))]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            flat, at = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            arrays = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(values, flat.flatten(), strict=True)}
            got = [batch.column(k).to_pylist() for k in range(len(keys))]
            groups = ({n: a[at[g] : at[g + 1]] for n, a in arrays.items()} for g in range(batch.num_rows))
            results = map(function, groups) if not together else (r for many in batched(groups, together) for r in function(list(many)))
            found = ([(*(c[g] for c in got), *r) for r in rows] for g, rows in enumerate(results))
            yield from map(as_batch, in_pieces(found, wide))

    return packed.mapInArrow(run, schema)


#: Rows of a table that are worked on together.
FLAT_ROWS = 2_000


def per_pages(df: DataFrame, keys: list[str], values: list[str], function: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, list]], columns: str) -> DataFrame:
    """The function's rows for many groups at once, behind each group's keys.

    The function gets the values of several groups end to end, each group's rows sorted by the values in their order, and how
    many rows each group has; it gives the group of each of its rows and its columns (arrays, those of floats with NaN for null).

    A window brings a group's rows together, so rows that are dealt by the keys already aren't shuffled anew, and no lists are made in the JVM.
    """
    counted = df.select(*keys, *values).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out_schema = to_arrow_schema(StructType.fromDDL(", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + columns))

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = table["_rows"].to_numpy()
        firsts = [0]  # of each group
        while firsts[-1] < len(rows):
            firsts.append(firsts[-1] + int(rows[firsts[-1]]))
        counts, firsts = np.diff(firsts), np.array(firsts[:-1])
        arrays = {n: table[n].to_numpy() for n in values}
        group = np.repeat(np.arange(len(counts)), counts)
        order = np.lexsort([*(arrays[n] for n in reversed(values)), group])
        if (np.diff(order) < 0).any():
            arrays = {n: a[order] for n, a in arrays.items()}
        owner, found = function(arrays, counts)
        heads = [table[k].take(pa.array(firsts)).combine_chunks() for k in keys]
        step = OUT_ROWS
        for at in range(0, len(owner), step):
            own = pa.array(owner[at : at + step])
            cells = [pa.array(c[at : at + step], f.type, from_pandas=True) for c, f in zip(found, list(out_schema)[len(keys) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*(h.take(own) for h in heads), *cells], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows > FLAT_ROWS:
                end, seen = whole(held["_rows"].to_numpy(), FLAT_ROWS)
                if not end:
                    break
                yield from work(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from work(held)

    def whole(rows: np.ndarray, most: int) -> tuple[int, int]:
        """The end of the last whole group that begins before so many rows."""
        end = 0
        while end < most and end + int(rows[end]) <= len(rows):
            end += int(rows[end])
            if end == len(rows):
                break
        return end, len(rows)

    return counted.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + columns)
