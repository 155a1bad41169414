"""A corpus pipeline: quality, toxicity, near duplicates, mixing, byte-pair encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and
read again as the next stage's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm import bpe, mixing, neardup, quality, toxicity
from pagelattice.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts by the rule cascade; short texts pass as long as they have a word.

    A null or blank text has no word and goes; repeated rows and rows without an id are judged by their texts alone; an
    empty table stays empty; all columns, whatever their names, are kept.
    """
    return quality.passing(docs, (*quality.base_rules(1), *quality.OWN_RULES))


def toxic_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the span model scores 0.5 or more.

    A null or empty text scores like clean tokens and stays; without labels of both kinds nothing is rejected; rows are
    judged by their texts alone, and all columns are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.fit_from(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the least doc_id's, of each group of rows linked at 0.8 of five-word shingles.

    Rows are linked by their own texts, also those of one doc_id; rows without an id and texts without words
    all stay; an empty table stays empty; all columns, whatever their names, are kept.
    """
    scratch = Scratch(spark, "rows")
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.table(rows, "documents", codec="zstd")
    named = rows.where("doc.doc_id is not null")
    work = Scratch(spark, "neardup")
    found = neardup.linked_rows(named.select("row", "doc.text"), width=5, percent=80, scratch=work)
    found = scratch.table(named.select("row", "doc.doc_id").join(found.hint("merge"), "row"), "found")
    work.drop()  # only found and the documents are read from here on
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("m")).select("m.row")
    gone = found.select("row").join(first, "row", "left_anti")
    return neardup.without_rows(rows, gone).select("doc.*")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, read from the shards that the mix writes.

    A null source is a source; a null id is an id like others; empty texts go with their block; an
    empty table stays empty; all columns, whatever their names, are kept.
    """
    return mixing.mixed_documents(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the digests of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    A null text counts as empty and has no ids; each row of the input is one of the output; other columns go.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_spans),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_sources),
    ("bpe", bpe_ids),
]

#: The span model's weights come from gradient descent, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result a table that the next reads."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
