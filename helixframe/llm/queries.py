"""Queries over the test tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, jaccard, langid, licenses, mixing, quality, tokenfile, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_read(spark, sf_dir, "documents", "doc_id", "text"), percent=75, k=5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0, k=20, scale=64)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.round_trip(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its host, the part of the source in its language the path."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    told = quality.scored(docs, _read(spark, sf_dir, "labels", "doc_id", "quality"), F.col("source"), F.col("lang"))
    return told.select("doc_id", "p_document", "host_posterior", "path_posterior", "quality_score", (F.col("quality_score") >= quality.KEEP).alias("keep"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Query]:
    return {"op1_jaccard_join": op1_jaccard_join, "op2_mix_sources": op2_mix_sources, "op3_exact_top_k": op3_exact_top_k, "op4_token_files": op4_token_files, "op5_quality": op5_quality, "op6_warc": op6_warc, "op7_language": op7_language, "op8_licenses": op8_licenses, "op9_ann": op9_ann, "op10_byte_bpe": op10_byte_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.REPORT_SQL, "op3_exact_top_k": topk.TOP_K_SQL, "op6_warc": warc.ROUND_TRIP_SQL, "op8_licenses": licenses.scan_sql()}
