"""Position merges of several inputs, and lookups between reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar


def synced(inputs: list[DataFrame]) -> DataFrame:
    """chrom, pos, key, in_0, in_1, ...: which inputs have a record at a position with the same alleles.

    Inputs are (chrom, pos, ref, alt); one shuffle serves all of them.
    """
    tagged = [df.select("chrom", "pos", F.upper(F.concat_ws(">", "ref", "alt")).alias("key"), F.lit(i).alias("i")) for i, df in enumerate(inputs)]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy("chrom", "pos", "key").agg(*(F.max((F.col("i") == i).cast("int")).alias(f"in_{i}") for i in range(len(inputs))))


def mates(reads: DataFrame) -> DataFrame:
    """qname, first_pos, second_pos of proper pairs whose ends may overlap.

    A read counts if it is in a proper pair with a mapped mate on its own
    reference and, by its template length, not too far from it.
    """
    far = (F.abs("tlen") >= 2 * F.length("seq")) & (F.col("mpos") >= cigar.endpos(F.col("flag"), F.col("pos"), F.col("cigar")))
    near = reads.filter((F.col("flag").bitwiseAND(F.lit(10)) == 2) & ((F.col("mtid") < 0) | (F.col("tid") == F.col("mtid"))) & ~far)
    first = near.filter(F.col("flag").bitwiseAND(F.lit(64)) != 0).select("qname", "tid", F.col("pos").alias("first_pos"))
    second = near.filter(F.col("flag").bitwiseAND(F.lit(128)) != 0).select("qname", "tid", F.col("pos").alias("second_pos"))
    return first.join(second, ["qname", "tid"]).select("qname", "first_pos", "second_pos")
