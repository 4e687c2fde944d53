"""Counts and quality statistics over ``reads``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def idxstats(reads: DataFrame) -> DataFrame:
    """rname, mapped, unmapped; reads without a reference have a null rname."""
    unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0
    return reads.groupBy("rname").agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))


def duplicate_table(reads: DataFrame, short: int = 12, long: int = 32, start: int = 0) -> DataFrame:
    """key, kmer, n, gc: for each short k-mer the smallest long k-mer and how many reads have it.

    Both k-mers start at the same letter.  Supplementary reads, reads shorter than ``long`` and reads with other bases
    than ACGT there don't count.
    """
    kmer = F.substring("seq", start + 1, long)
    valid = reads.filter((F.col("flag").bitwiseAND(F.lit(2048)) == 0) & (F.length("seq") >= start + long) & kmer.rlike("^[ACGT]+$"))
    coded = valid.select(S.kmer_code(F.col("seq"), short, start).alias("key"), S.kmer_code(F.col("seq"), long, start).alias("kmer"), S.gc(F.col("seq")).alias("gc"))
    groups = coded.groupBy("key", "kmer").agg(F.count("*").alias("n"), F.avg("gc").alias("gc"))
    return groups.groupBy("key").agg(F.min_by(F.struct("kmer", "n", "gc"), "kmer").alias("least")).select("key", "least.*")


def duplicate_histogram(table: DataFrame, size: int = 32) -> DataFrame:
    """bucket, keys, mean_gc: keys by their number of reads, the last bucket for all beyond."""
    return table.groupBy(F.least("n", F.lit(size - 1)).alias("bucket")).agg(F.count("*").alias("keys"), F.round(F.avg("gc") / 255, 6).alias("mean_gc"))


def duplicate_rate(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.sum(F.col("n") - 1) / F.sum("n"), F.lit(0.0)).alias("rate"))


def overrepresented(reads: DataFrame) -> DataFrame:
    """(largest group of equal sequences - 1) / reads."""
    groups = reads.groupBy(S.complement(F.col("seq")).alias("s")).count()
    return groups.agg(((F.max("count") - 1) / F.sum("count")).alias("rate"))


def read_summary(reads: DataFrame) -> DataFrame:
    unmapped = F.col("flag").bitwiseAND(F.lit(4)) != 0
    n = F.length("seq")
    return reads.agg(F.count("*").alias("total"), F.count_if(~unmapped).alias("aligned"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(n).alias("bases"))


def base_by_position(reads: DataFrame) -> DataFrame:
    """place, base, n: the bases that reads have at each place."""
    cut = reads.select(F.posexplode(F.split("seq", "")).alias("place", "base")).filter("base <> ''")
    return cut.groupBy("place", "base").agg(F.count("*").alias("n"))


def kmer_histogram(reads: DataFrame, k: int = 5) -> DataFrame:
    return reads.select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
