"""A corpus pipeline of five stages over ``documents``.

Each stage takes the documents that the one before kept; each result is
written as Parquet and read again.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, jaccard, langid, mixing, quality
from helixframe.llm.idbits import without
from helixframe.llm.scratch import Scratch

#: SQL can't express the trained stages.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.accepted(docs, labels, F.col("source"), F.col("lang"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of every component of near duplicates.

    Rows without a doc_id stay; of rows that repeat a doc_id the smallest stays,
    compared column by column.
    """
    scratch = Scratch(spark, "duplicates")
    found = jaccard.join_components(docs.select("doc_id", "text"))
    lost = scratch.table(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(), "lost")
    kept = without(docs, lost, jaccard.BROADCAST_IDS)
    named = kept.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        others = [c for c in docs.columns if c != "doc_id"]
        named = named.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*").select(*docs.columns)
    return named.unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin documents to their sources' target weights."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe.encode_documents(docs.select("doc_id", "source", "text"), path, pattern)
    return made.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
