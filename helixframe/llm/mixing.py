"""Mixing sources to target weights (operator 2), DataFrame functions only.

Words per source are aggregated first; targets come from water filling over
the table of sources; a document is then taken floor(rate) times and once more
with a probability of the remaining fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

#: A word is a run of bytes other than these.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, the same in every run and engine: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], limit: int, scratch: Scratch) -> DataFrame:
    """source, source_size, target for a table of (source, size).

    Sources in order of code points (null last) take ``weights`` in turn;
    targets add up to share[0] / share[1] of all sizes, none above ``limit``
    times its source's size; what a limit cuts off goes to the others by
    weight.  A source without words gets 0.  Sources are numbered within
    ranges of names, so no task sees all of them.
    """
    spark = sizes.sparkSession
    dealt = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = scratch.table(dealt.repartitionByRange(shuffle_width(spark), *order).select("*", F.spark_partition_id().alias("part")), "sources")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for a partition
    before, starts = 0, []
    for row in counts:
        starts.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    turn = F.pmod(place, F.lit(len(weights))).cast("int") + 1
    weighed = ranged.join(F.broadcast(offsets), "part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))
    weighed = scratch.table(weighed, "weights")
    # Water filling: the level rises until the set of sources at their limit stays the same.
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    full, numerator, denominator = -1, 0, 1
    at_limit = F.lit(False)
    while True:
        row = weighed.agg(
            F.count_if(at_limit).alias("full"),
            F.coalesce(F.sum(F.when(at_limit, limit * F.col("source_size"))), F.lit(0)).alias("cut"),
            F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0)).alias("rest"),
        ).first()
        if row["full"] == full or not row["rest"]:
            break
        full, numerator, denominator = row["full"], share[0] * total - share[1] * row["cut"], share[1] * row["rest"]
        at_limit = F.lit(limit) * F.col("source_size") * F.lit(denominator) <= F.col("weight") * F.lit(numerator)
    level = F.col("weight") * F.lit(numerator).cast("double") / F.lit(denominator).cast("double")
    target = F.when(at_limit, (limit * F.col("source_size")).cast("double")).otherwise(level)
    return weighed.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), limit: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies.

    ``copies`` is how often the mix takes the row.  Null sources are a source
    of their own, null and empty texts have size 0.  A row's draw hangs on its
    doc_id and, where that is null, on its text; rows equal in these share it.
    Columns of ``docs`` with the added names are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    scratch = Scratch(docs.sparkSession, "mixing")
    targets = scratch.table(source_targets(kept.select("source", words(F.col("text")).alias("size")), weights, share, limit, scratch), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    key = F.coalesce(F.col("x.row.doc_id").cast("string"), F.col("x.row.text"))
    copies = whole + (draw(key, seed) < rate - whole).cast("long")
    sized = kept.select(F.struct(*kept.columns).alias("row"), words(F.col("text")).alias("size"))
    # Few sources: the size of the written table lets Spark broadcast it; else the skewed side is split.
    joined = sized.alias("x").join(targets.alias("y"), F.col("x.row.source").eqNullSafe(F.col("y.source")))
    return joined.select("x.row.*", "x.size", "y.source_size", "y.target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    taken = mix(docs, **options)
    copy = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return taken.filter("copies > 0").withColumn("_copy", copy).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB SQL; water filling by sums over the sources in order of the level at which they fill.
REPORT_SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(2 * source_size) OVER w, 0) AS cut, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM weighed
  WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(3 * total - 2 * cut AS DOUBLE) AS numerator, CAST(2 * rest AS DOUBLE) AS denominator
  FROM ordered WHERE 2 * source_size * 2 * rest > weight * (3 * total - 2 * cut)
  ORDER BY source_size / weight, source IS NULL, source LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN numerator IS NULL OR 2 * source_size * denominator <= weight * numerator THEN CAST(2 * source_size AS DOUBLE) ELSE weight * numerator / denominator END AS target
  FROM weighed LEFT JOIN level ON true
), rated AS (
  SELECT doc_id, text, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '') || ':17'), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
