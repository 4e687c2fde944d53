"""Reference sequences cut into windows, and the letters of regions fetched from them; index lines of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a window.
WINDOW = 1 << 16


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """value: the lines of each record (name, seq, and comment where there is one), sequences in lines of ``width`` letters."""
    head = F.concat_ws(" ", "name", "comment") if "comment" in df.columns else F.col("name")
    lines = F.rtrim(F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return df.select(F.rtrim(F.concat(F.lit(">"), head, F.lit("\n"), lines), F.lit("\n")).alias("value"))


def windows(sequences: DataFrame, size: int = WINDOW) -> DataFrame:
    """chrom, window, letters: sequences (name, seq) in windows of ``size`` letters, so a long one is many rows."""
    last = F.greatest(F.floor((F.length("seq") - 1) / size), F.lit(0))
    cut = sequences.filter(F.length("seq") > 0).select(F.col("name").alias("chrom"), "seq", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    return cut.select("chrom", "window", F.substring(F.col("seq"), (F.col("window") * size + 1).cast("int"), F.lit(size)).alias("letters"))


def fetch(regions: DataFrame, pieces: DataFrame, size: int = WINDOW) -> DataFrame:
    """``regions`` (chrom, beg, end half-open, ...) with ``seq``, cut at the end of the sequence.

    A negative begin counts as 0.  Regions that are empty, or beyond or without
    their sequence, have no row.  Equal regions are fetched once.
    """
    wanted = regions.select("chrom", "beg", "end").distinct().filter("end > greatest(beg, 0)")
    start = F.greatest("beg", F.lit(0))
    spread = wanted.select("*", F.explode(F.sequence(F.floor(start / size), F.floor((F.col("end") - 1) / size))).alias("window"))
    found = spread.join(pieces, ["chrom", "window"])
    low, high = F.greatest(start - F.col("window") * size, F.lit(0)), F.least(F.col("end") - F.col("window") * size, F.lit(size))
    parts = found.select("chrom", "beg", "end", "window", F.substring(F.col("letters"), (low + 1).cast("int"), (high - low).cast("int")).alias("part")).filter("part <> ''")
    whole = parts.groupBy("chrom", "beg", "end").agg(F.array_sort(F.collect_list(F.struct("window", "part"))).alias("parts"))
    return regions.join(whole.select("chrom", "beg", "end", F.array_join("parts.part", "").alias("seq")), ["chrom", "beg", "end"])


def index_lines(content: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, letters, offset of the first one, letters a line, bytes a line) of each record of a FASTA file.

    ValueError where lines within a record, but for the last one, differ in length.
    """
    out, at = [], 0
    name, letters, offset, per, width, short = None, 0, 0, 0, 0, False
    for line in content.splitlines(keepends=True):
        bare = line.rstrip(b"\r\n")
        if bare.startswith(b">"):
            if name is not None:
                out.append((name, letters, offset, per, width))
            words = bare[1:].split(None, 1)
            name, letters, offset, per, width, short = words[0].decode() if words else "", 0, at + len(line), 0, 0, False
        elif bare:
            if name is None:
                raise ValueError("letters before the first name")
            if short or (per and len(bare) > per):
                raise ValueError(f"lines of {name} differ in length")
            per, width = per or len(bare), width or len(line)
            short = len(bare) < per
            letters += len(bare)
        else:
            short = short or per > 0
        at += len(line)
    if name is not None:
        out.append((name, letters, offset, per, width))
    return out


def fetch_bytes(content: bytes, entry: tuple[str, int, int, int, int], beg: int, end: int) -> str:
    """Letters [beg, end) of an indexed record, by arithmetic alone."""
    _, letters, offset, per, width = entry
    beg, end = max(0, beg), min(end, letters)
    if beg >= end:
        return ""
    first, last = (offset + x // per * width + x % per for x in (beg, end - 1))
    return content[first : last + 1].replace(b"\n", b"").replace(b"\r", b"").decode()
