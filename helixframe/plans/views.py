"""Views over the test tables, as DataFrames and as DuckDB SQL.

The expressions are one text for both engines; only the regular-expression
replacement needs a flag in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READS = {
    "qname": "concat('d', doc_id // 2)",
    "flag": "CAST((doc_id * 37 + 13) % 4096 AS INT)",
    "tid": "CAST(doc_id % 20 AS INT)",
    "rname": "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('s', doc_id % 20 + 1) END",
    "pos": "doc_id * 7919 % 100000",
    "mapq": "CAST(doc_id % 61 AS INT)",
    "mtid": "CAST(doc_id % 19 AS INT)",
    "mrname": "concat('s', doc_id % 19 + 1)",
    "mpos": "doc_id * 104729 % 100000",
    "tlen": "doc_id % 1000 - 500",
    "rg": "concat('x', doc_id % 3)",
    "seq": "upper(letters)",
    "cigar": "CASE WHEN length(letters) < 20 THEN concat(length(letters), 'M') WHEN doc_id % 4 = 0 THEN concat(length(letters), 'M')"
    " WHEN doc_id % 4 = 1 THEN concat('5S', length(letters) - 5, 'M') WHEN doc_id % 4 = 2 THEN concat('10M3D', length(letters) - 10, 'M')"
    " ELSE concat('10M2I', length(letters) - 12, 'M') END",
    "nm": "CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 END",
    "md": "CASE WHEN doc_id % 4 <> 0 THEN concat(doc_id % 50, 'A', doc_id % 9, CASE WHEN doc_id % 3 = 0 THEN 'CA' ELSE 'T' END, doc_id % 11) END",
}


def _select(exprs: dict[str, str], spark: bool) -> list[str]:
    return [f"{e.replace('//', 'div') if spark else e} AS {name}" for name, e in exprs.items()]


READS_SQL = (
    f"SELECT doc_id, {', '.join(_select(_READS, False))} FROM (SELECT doc_id, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS letters FROM documents)"
)
_ALIGNMENTS = {"chrom": "concat('s', l_suppkey)", "beg": "(l_partkey * 37 + l_linenumber * 1009) % 100000", "end": "(l_partkey * 37 + l_linenumber * 1009) % 100000 + CAST(l_quantity AS BIGINT)", "mapq": "CAST(l_partkey % 61 AS INT)", "flag": "CAST((l_orderkey * 7 + l_linenumber * 13) % 4096 AS INT)"}
_REGIONS = {"chrom": "concat('s', 1 + p_partkey % 100)", "beg": "p_partkey * 53 % 100000", "end": "p_partkey * 53 % 100000 + p_size", "payload": "p_brand"}
_VARIANTS = {
    "chrom": "concat('s', l_suppkey % 10 + 1)", "pos": "l_partkey * 3 % 5000", "ref": "substr('ACGTAC', CAST(1 + l_orderkey % 4 AS INT), CAST(1 + l_linenumber % 3 AS INT))",
    "alt": "substr('GATTACA', CAST(1 + l_partkey % 5 AS INT), CAST(1 + l_suppkey % 3 AS INT))", "gt": "CASE WHEN l_orderkey % 11 = 0 THEN './1' ELSE concat(l_orderkey % 3, CASE WHEN l_partkey % 2 = 0 THEN '/' ELSE '|' END, l_partkey % 3) END",
    "filters": "CASE WHEN l_partkey % 4 = 0 THEN 'PASS' WHEN l_partkey % 4 = 1 THEN 'q10;s50' WHEN l_partkey % 4 = 2 THEN 'q10' ELSE '.' END", "sample": "l_linenumber",
}


def _sql(exprs: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in exprs.items()) + f" FROM {table}"


ALIGNMENTS_SQL, REGIONS_SQL, VARIANTS_SQL = _sql(_ALIGNMENTS, "lineitem"), _sql(_REGIONS, "part"), _sql(_VARIANTS, "lineitem")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ACGTacgt]", "").alias("letters"))
    plain = letters.selectExpr("doc_id", *_select(_READS, True))
    tags = F.map_filter(
        F.create_map(
            F.lit("NM"), F.struct(F.lit(None).cast("string").alias("s"), F.col("nm").cast("double").alias("d")),
            F.lit("MD"), F.struct(F.col("md").alias("s"), F.lit(None).cast("double").alias("d")),
        ),
        lambda _, v: v["s"].isNotNull() | v["d"].isNotNull(),
    )
    library = F.when(F.col("rg") == "x0", "libA").when(F.col("rg") == "x1", "libB")
    return plain.withColumns({"tags": tags, "library": library, "qual": F.translate("seq", "ACGT", "5:?D")})


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _ALIGNMENTS.items()))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _REGIONS.items()))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {n}" for n, e in _VARIANTS.items()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events")
