"""CIGAR strings as columns: parsed operations and what they consume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY, REFERENCE = "MIS=X", "MDN=X"


def ops(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR text; null and ``*`` have none."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("len")))


def consumed(cigar: Column, kinds: str) -> Column:
    """Sum of the lengths of the operations in ``kinds``, without building structs."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total + x.cast("long"))


def qlen(cigar: Column) -> Column:
    return consumed(cigar, QUERY)


def rlen(cigar: Column) -> Column:
    return consumed(cigar, REFERENCE)


def endpos(flag: Column, pos: Column, cigar: Column) -> Column:
    """0-based end: pos plus the reference length, 1 at least; an unmapped read spans 1."""
    span = F.when(flag.bitwiseAND(F.lit(4)) != 0, F.lit(0).cast("long")).otherwise(rlen(cigar))
    return pos + F.greatest(span, F.lit(1).cast("long"))


def restore_long(cigar: Column, read_length: Column, long_cigar: Column) -> Column:
    """The real CIGAR where it was moved into a tag: the text one then starts with <read length>S."""
    fake = cigar.startswith(F.concat(read_length.cast("string"), F.lit("S")))
    return F.when(fake & long_cigar.isNotNull(), long_cigar).otherwise(cigar)
