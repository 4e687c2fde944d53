"""Quality metrics of reads (seq, qual): all of them aggregates with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is added to a quality to make it a letter.
OFFSET = 33


def _letters(reads: DataFrame) -> DataFrame:
    """place, base, q of every letter."""
    pairs = F.arrays_zip(F.split("seq", "").alias("base"), F.split("qual", "").alias("mark"))
    cut = reads.select(F.posexplode(pairs).alias("place", "p"))
    return cut.select("place", F.col("p.base").alias("base"), (F.ascii("p.mark") - OFFSET).alias("q")).filter("base <> ''")


def quality_by_position(reads: DataFrame) -> DataFrame:
    """place, n, mean_quality."""
    return _letters(reads).groupBy("place").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean_quality"))


def quality_histogram(reads: DataFrame) -> DataFrame:
    """q, n: how many letters have a quality."""
    return _letters(reads).groupBy("q").agg(F.count("*").alias("n"))


def mean_quality_histogram(reads: DataFrame) -> DataFrame:
    """mean_quality (rounded down), n: reads by the mean of their qualities."""
    total = F.aggregate(F.transform(F.split("qual", ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    own = reads.filter(F.length("qual") > 0).select(F.floor(total / F.length("qual") - OFFSET).cast("int").alias("mean_quality"))
    return own.groupBy("mean_quality").agg(F.count("*").alias("n"))


def base_fractions(reads: DataFrame) -> DataFrame:
    """place and the fractions of A, C, G, T and other letters there."""
    base, total = F.col("base"), F.count("*")
    shares = [F.round(F.count_if(base == b) / total, 6).alias(f"{b.lower()}_share") for b in "ACGT"]
    return _letters(reads).groupBy("place").agg(*shares, F.round(F.count_if(~base.isin(*"ACGT")) / total, 6).alias("other_share"))


def statuses(reads: DataFrame, least_quality: float = 20.0, most_bias: float = 0.1) -> DataFrame:
    """check, worst, passed: mean quality and balance of bases, each at the worst place."""
    quality = quality_by_position(reads).agg(F.min("mean_quality").alias("worst")).select(F.lit("quality").alias("check"), "worst", (F.col("worst") >= least_quality).alias("passed"))
    bias = F.greatest(F.abs(F.col("a_share") - F.col("t_share")), F.abs(F.col("g_share") - F.col("c_share")))
    content = base_fractions(reads).agg(F.round(F.max(bias), 6).alias("worst")).select(F.lit("content").alias("check"), "worst", (F.col("worst") <= most_bias).alias("passed"))
    return quality.unionByName(content)


def report_html(reads: DataFrame) -> str:
    """A page with tables of the metrics; their rows are bounded by read length and quality, not by reads."""
    parts = []
    for title, table in (("Quality by position", quality_by_position(reads).orderBy("place")), ("Base fractions", base_fractions(reads).orderBy("place")), ("Reads by mean quality", mean_quality_histogram(reads).orderBy("mean_quality")), ("Checks", statuses(reads))):
        rows = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in table.collect())
        parts.append(f"<h2>{title}</h2><table><tr>{''.join(f'<th>{c}</th>' for c in table.columns)}</tr>{rows}</table>")
    return "<!doctype html><title>Quality report</title>" + "".join(parts)
