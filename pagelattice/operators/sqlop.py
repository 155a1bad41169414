"""Operators stated as one SQL query over named input tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Every declared operator by name.
OPERATORS: dict[str, SqlOperator] = {}


@dataclass(frozen=True)
class SqlOperator:
    """A query over its inputs.  ``rows`` are the survey's rows it answers.

    ``spark`` has (from, to) pairs that turn the common text into Spark's dialect, ``duck`` into DuckDB's.
    """

    name: str
    rows: str
    inputs: tuple[str, ...]
    text: str
    doc: str
    spark: tuple[tuple[str, str], ...] = ()
    duck: tuple[tuple[str, str], ...] = ()
    other: str | None = None  # the oracle's own text, if it is stated another way

    def __call__(self, **tables: DataFrame) -> DataFrame:
        session: SparkSession = next(iter(tables.values())).sparkSession
        text = _swapped(self.text, self.spark)
        for name in self.inputs:
            text = re.sub(rf"\b{name}\b", "{" + name + "}", text)
        return session.sql(text, **{n: tables[n] for n in self.inputs})

    def oracle(self) -> str:
        return _swapped(self.other or self.text, self.duck)


def _swapped(text: str, pairs) -> str:
    for old, new in pairs:
        text = text.replace(old, new)
    return text


def operator(name: str, rows: str, inputs: str, text: str, doc: str, spark=(), duck=(), other: str | None = None) -> SqlOperator:
    made = SqlOperator(name, rows, tuple(inputs.split()), text.strip(), doc, tuple(spark), tuple(duck), other)
    assert name not in OPERATORS, name
    OPERATORS[name] = made
    return made
