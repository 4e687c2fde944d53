"""Sequences and flags as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the flag bits, lowest first.
FLAGS = ["PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY"]


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_at(seq: Column, i: Column) -> Column:
    """The base at a 0-based place, null beyond the end."""
    return F.nullif(F.substring(seq, i + 1, F.lit(1)), F.lit(""))


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, base, ""))


def gc(seq: Column) -> Column:
    """round(255 * (C + G) / length); null for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.floor(255.0 * (base_count(seq, "C") + base_count(seq, "G")) / n + 0.5)).cast("int")


def kmer_code(seq: Column, k: int, start: int = 0) -> Column:
    """The k-mer as digits of its complement's codes, which sort like the packed integers."""
    return F.translate(F.substring(seq, start + 1, k), "TGAC", "0123")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence, from left to right."""
    last = F.length(seq) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def flag_names(flag: Column) -> Column:
    return F.concat_ws(",", *(F.when(flag.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(FLAGS)))


def flag_value(text: Column) -> Column:
    """A flag from decimal, hexadecimal (0x), octal (0) or names between commas; -1 where a name is unknown."""
    bits = {name: 1 << i for i, name in enumerate(FLAGS)}
    known = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    named = F.aggregate(F.split(F.upper(text), ","), F.lit(0), lambda total, x: F.when((total < 0) | known[x].isNull(), F.lit(-1)).otherwise(total.bitwiseOR(known[x])))
    return (
        F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("int"))
        .when(text.rlike("^0[0-7]+$"), F.conv(text, 8, 10).cast("int"))
        .when(text.rlike("^[0-9]+$"), text.cast("int"))
        .otherwise(named)
    )
