"""Line formats as DataFrames: SAM, FASTA and FASTQ, VCF, and tab-separated intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of formats; text formats are told by what their first lines look like.
MAGIC = [(b"BAM\1", "bam"), (b"CRAM", "cram"), (b"BCF\2", "bcf"), (b"BAI\1", "bai"), (b"CSI\1", "csi"), (b"TBI\1", "tbi"), (b"\x1f\x8b", "gzip")]
#: Columns of tab formats: place of name, begin and end (from 0), first position, mark of comments.
PRESETS = {"bed": (0, 1, 2, 0, "#"), "gff": (0, 3, 4, 1, "#"), "psl": (13, 15, 16, 0, ""), "vcf": (0, 1, 1, 1, "#"), "sam": (2, 3, 3, 1, "@")}


def sniff(head: bytes) -> str:
    """Name of the format that a file's first bytes (decompressed) show; ``text`` or ``binary`` if none."""
    for magic, name in MAGIC:
        if head.startswith(magic):
            return name
    if head.startswith(b"##fileformat=VCF"):
        return "vcf"
    if head[:3] in (b"@HD", b"@SQ", b"@RG", b"@PG", b"@CO") and head[3:4] == b"\t":
        return "sam"
    if head[:1] in b">@" and head[:1]:
        return "fasta" if head[:1] == b">" else "fastq"
    line = head.split(b"\n", 1)[0].rstrip(b"\r").split(b"\t")
    if len(line) >= 11 and line[1].isdigit() and line[3].isdigit() and line[4].isdigit():
        return "sam"
    if len(line) >= 3 and line[1].isdigit() and line[2].isdigit():
        return "bed"
    return "text" if all(b >= 32 or b in (9, 10, 13) for b in head[:512]) else "binary"


def _missing(x: Column, mark: str = "*") -> Column:
    return F.when(x != mark, x)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM files below ``path``; positions become 0-based, ``*`` null, tags a map of name to (kind, value)."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 0))
    part = F.split("value", "\t")
    rname = _missing(part[2])
    tags = F.transform(F.slice(part, F.lit(12), F.greatest(F.size(part) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("name"), F.struct(F.substring(t, 4, 1).alias("kind"), F.substring(t, F.lit(6), F.length(t)).alias("value")).alias("tag")))
    return lines.select(
        _missing(part[0]).alias("qname"), part[1].cast("int").alias("flag"), rname.alias("rname"), (part[3].cast("long") - 1).alias("pos"), part[4].cast("int").alias("mapq"), _missing(part[5]).alias("cigar"),
        F.when(part[6] == "=", rname).otherwise(_missing(part[6])).alias("mrname"), (part[7].cast("long") - 1).alias("mpos"), part[8].cast("long").alias("tlen"), _missing(part[9]).alias("seq"), _missing(part[10]).alias("qual"),
        F.map_from_entries(tags).alias("tags"),
    )


def read_sam_header(spark: SparkSession, path: str) -> DataFrame:
    """kind, fields (map) of the header lines."""
    part = F.split("value", "\t")
    fields = F.transform(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(4), F.length(t))))
    lines = spark.read.text(path).filter(F.col("value").rlike("^@[A-Z][A-Z]\t"))
    return lines.select(F.substring("value", 2, 2).alias("kind"), F.when(F.substring("value", 2, 2) == "CO", F.create_map(F.lit("CO"), F.substring("value", 5, 1 << 30))).otherwise(F.map_from_entries(fields)).alias("fields"))


def sam_lines(df: DataFrame) -> DataFrame:
    """value: a SAM line for each record of the columns that ``read_sam`` gives."""
    star = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("*"))
    mate = F.when(F.col("mrname") == F.col("rname"), F.lit("=")).otherwise(star("mrname"))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["kind"], F.lit(":"), e["value"]["value"]))
    main = F.concat_ws("\t", star("qname"), "flag", star("rname"), F.coalesce("pos", F.lit(-1)) + 1, "mapq", star("cigar"), mate, F.coalesce("mpos", F.lit(-1)) + 1, "tlen", star("seq"), star("qual"))
    return df.select(F.concat_ws("\t", main, tags).alias("value"))


def _named(head: Column) -> list[Column]:
    part = F.split(head, r"\s+", 2)
    return [part[0].alias("name"), F.get(part, F.lit(1)).alias("comment")]


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq, qual of four-line FASTQ files.

    A quality may start with ``@``, so only counting lines tells records apart:
    a file goes to one task, many files to many.
    """
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x, i: (i % 4 != 0) | (x != ""))
    whole = spark.read.text(path, wholetext=True).select(lines.alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines") - 3, F.lit(4))
    record = F.explode(F.when(F.size("lines") >= 4, F.transform(starts, lambda i: F.slice("lines", i, F.lit(4))))).alias("r")
    head = F.when(F.col("r")[0].startswith("@") & F.col("r")[2].startswith("+"), F.col("r")[0]).otherwise(F.raise_error(F.lit("not FASTQ of four lines a record")))
    return whole.select(record).select(*_named(F.substring(head, 2, 1 << 30)), F.col("r")[1].alias("seq"), F.col("r")[3].alias("qual"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, comment, seq of FASTA files, sequences over any number of lines; cut into records by Spark's line reader."""
    raw = spark.read.option("lineSep", "\n>").text(path).filter(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", ""), "\n")
    return raw.select(*_named(lines[0]), F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("seq"))


def fastq_lines(df: DataFrame) -> DataFrame:
    """value: four lines for each record (name, comment, seq, qual)."""
    return df.select(F.concat(F.lit("@"), F.concat_ws(" ", "name", "comment"), F.lit("\n"), F.coalesce("seq", F.lit("")), F.lit("\n+\n"), F.coalesce("qual", F.lit(""))).alias("value"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (0-based), id, ref, alts, qual, filters, info (map; flags are null), format, samples (arrays); ``.`` is missing."""
    part = F.split("value", "\t")
    info = F.transform(F.split(part[7], ";"), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x)))))
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    return lines.select(
        part[0].alias("chrom"), (part[1].cast("long") - 1).alias("pos"), _missing(part[2], ".").alias("id"), part[3].alias("ref"), F.when(part[4] != ".", F.split(part[4], ",")).alias("alts"), F.when(part[5] != ".", part[5].cast("double")).alias("qual"),
        F.when(part[6] != ".", F.split(part[6], ";")).alias("filters"), F.when(part[7] != ".", F.map_from_entries(info)).alias("info"), F.when(F.size(part) > 8, F.split(part[8], ":")).alias("format"),
        F.transform(F.slice(part, F.lit(10), F.greatest(F.size(part) - 9, F.lit(0))), lambda x: F.split(x, ":")).alias("samples"),
    )


def vcf_lines(df: DataFrame) -> DataFrame:
    """value: a VCF line for each record (chrom, pos, id, ref, alts, qual, filters, info) without samples."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return df.select(F.concat_ws("\t", "chrom", F.col("pos") + 1, dot(F.col("id")), "ref", dot(F.array_join("alts", ",")), dot(F.col("qual").cast("string")), dot(F.array_join("filters", ";")), dot(info)).alias("value"))


def read_intervals(spark: SparkSession, path: str, preset: str = "bed") -> DataFrame:
    """chrom, beg, end (half-open, from 0), fields (all columns) of a tab format; comments go."""
    name, beg, end, first, comment = PRESETS[preset]
    part = F.split("value", "\t")
    lines = spark.read.text(path).filter(F.length("value") > 0)
    if comment:
        lines = lines.filter(~F.col("value").startswith(comment))
    start = part[beg].cast("long") - first
    return lines.select(part[name].alias("chrom"), start.alias("beg"), (start + 1 if beg == end else part[end].cast("long")).alias("end"), part.alias("fields"))
