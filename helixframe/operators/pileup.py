"""Depth and pileup over alignments (chrom, beg, end half-open, or pos with a CIGAR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar

#: Positions of a chromosome that one task orders.
BLOCK_SHIFT = 20
#: Positions of a chromosome whose alignments go to one task for the depth of each.
DEPTH_SHIFT = 13


def running(steps: DataFrame, shift: int = BLOCK_SHIFT) -> DataFrame:
    """(chrom, at, d, total, next): the sum of d up to each place and the place after it, for one row a place.

    Places are ordered within blocks of a chromosome; sums and first places of
    the blocks, which are few, are carried over.  No task holds a chromosome.
    """
    cut = steps.withColumn("_block", F.shiftright("at", shift))
    order = Window.partitionBy("chrom").orderBy("_block")
    blocks = cut.groupBy("chrom", "_block").agg(F.sum("d").alias("_sum"), F.min("at").alias("_first"))
    carried = blocks.select("chrom", "_block", (F.sum("_sum").over(order) - F.col("_sum")).alias("_carry"), F.lead("_first").over(order).alias("_after"))
    by = Window.partitionBy("chrom", "_block").orderBy("at")
    total = F.col("_carry") + F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0))
    found = cut.join(carried, ["chrom", "_block"]).withColumns({"total": total, "next": F.coalesce(F.lead("at").over(by), F.col("_after"))})
    return found.select("chrom", "at", "d", "total", "next")


def steps(alignments: DataFrame) -> DataFrame:
    """(chrom, at, d): by how much depth changes at each place where it does; empty and unplaced alignments don't count."""
    ends = F.array(F.struct(F.col("beg").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    cut = alignments.filter("end > beg AND chrom IS NOT NULL").select("chrom", F.explode(ends).alias("s"))
    return cut.groupBy("chrom", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d")).filter("d <> 0")


def depth(alignments: DataFrame) -> DataFrame:
    """chrom, beg, end, depth: runs of equal depth above 0, from +1 and -1 at the ends of alignments.

    Two rows for an alignment, summed before the shuffle; nothing is exploded
    to positions.
    """
    return running(steps(alignments)).filter("total > 0").select("chrom", F.col("at").alias("beg"), F.col("next").alias("end"), F.col("total").alias("depth"))


def position_depth(alignments: DataFrame, shift: int = DEPTH_SHIFT) -> DataFrame:
    """chrom, pos, depth for every covered position.

    Alignments are cut where blocks of positions end, so that a block has its
    depths to itself: one shuffle of the alignments and one sort, no sums to carry.
    """
    cut = alignments.filter("end > beg AND chrom IS NOT NULL").select("chrom", "beg", "end", F.explode(F.sequence(F.shiftright("beg", shift), F.shiftright(F.col("end") - 1, shift))).alias("_block"))
    first = F.shiftleft("_block", shift)
    dealt = cut.select("chrom", "_block", F.greatest("beg", first).alias("beg"), F.least("end", first + (1 << shift)).alias("end")).repartition("chrom", "_block")
    ends = F.array(F.struct(F.col("beg").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))
    edges = dealt.select("chrom", "_block", F.explode(ends).alias("s")).groupBy("chrom", "_block", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d")).filter("d <> 0")
    by = Window.partitionBy("chrom", "_block").orderBy("at")
    runs = edges.select("chrom", "at", F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lead("at").over(by).alias("next")).filter("depth > 0")
    return runs.select("chrom", F.explode(F.expr("sequence(at, next - 1)")).alias("pos"), "depth")


def pileup(reads: DataFrame) -> DataFrame:
    """chrom, pos, base, n over reads aligned without indels (chrom, beg, seq)."""
    bases = reads.select("chrom", "beg", F.posexplode(F.split("seq", "")).alias("i", "base")).filter("base <> ''")
    return bases.groupBy("chrom", (F.col("beg") + F.col("i")).alias("pos"), "base").agg(F.count("*").alias("n"))


def _placed() -> Column:
    """Of a column ``_ops``: array<struct<op, len, q, r, indel>>: operations with their offsets and the indel that follows.

    One pass from the last operation to the first.  ``indel`` looks past the end
    of an operation: minus the length of a run of deletions (0 inside such a
    run), or the letters that insertions add, pads between them passed over.
    """
    start = "named_struct('q', 0L, 'r', 0L, 'dels', 0, 'ins', 0, 'pads', 0, 'after', '', 'done', cast(array() as array<struct<op: string, len: int, q: bigint, r: bigint, indel: int>>))"
    q, r = (f"IF(contains('{kinds}', x.op), x.len, 0)" for kinds in (cigar.QUERY, cigar.REFERENCE))
    indel = "CASE a.after WHEN 'D' THEN IF(x.op = 'D', 0, -a.dels) WHEN 'I' THEN a.ins WHEN 'P' THEN a.pads ELSE 0 END"
    step = f"""(a, x) -> named_struct('q', a.q + {q}, 'r', a.r + {r},
      'dels', IF(x.op = 'D', x.len + a.dels, 0), 'ins', CASE x.op WHEN 'I' THEN x.len + a.ins WHEN 'P' THEN a.ins ELSE 0 END,
      'pads', CASE WHEN x.op = 'I' THEN x.len + a.pads WHEN x.op IN ('P', 'S', 'H') THEN a.pads ELSE 0 END, 'after', x.op,
      'done', array_append(a.done, named_struct('op', x.op, 'len', x.len, 'q', a.q + {q}, 'r', a.r + {r}, 'indel', {indel})))"""
    return F.expr(f"aggregate(reverse(_ops), {start}, {step}, a -> transform(a.done, o -> named_struct('op', o.op, 'len', o.len, 'q', a.q - o.q, 'r', a.r - o.r, 'indel', o.indel)))")


def aligned_bases(reads: DataFrame) -> DataFrame:
    """A row for every position that a read (chrom, pos, cigar, seq, ...) spans.

    Columns of the read, then ref_pos, qpos (0-based place in seq; the next one
    in deletions), base (null in deletions), is_del, is_refskip, indel (letters
    that come in after this position, or minus those that go), inserted (their
    text, else null), is_head, is_tail.  Reads without chrom or CIGAR give none.
    """
    kept = reads.columns
    cut = reads.filter("chrom IS NOT NULL").withColumn("_ops", cigar.ops(F.col("cigar")))
    span = cigar.rlen(F.col("cigar"))
    ops = cut.select(*kept, span.alias("_span"), F.explode(_placed()).alias("_o")).filter(F.col("_o.len") > 0).filter(F.col("_o.op").isin(*cigar.REFERENCE))
    at = ops.select("*", F.explode(F.expr("sequence(0, _o.len - 1)")).alias("_i"))
    gone, last = F.col("_o.op").isin("D", "N"), F.col("_i") == F.col("_o.len") - 1
    ref, qpos = F.col("pos") + F.col("_o.r") + F.col("_i"), F.col("_o.q") + F.when(gone, F.lit(0)).otherwise(F.col("_i"))
    indel = F.when(last, F.col("_o.indel")).otherwise(F.lit(0))
    # Behind a deletion the next letter itself is inserted, else the one after.
    first = (qpos + F.when(gone, F.lit(1)).otherwise(F.lit(2))).cast("int")
    return at.select(
        *kept, ref.alias("ref_pos"), qpos.alias("qpos"), F.when(~gone, F.substring("seq", (qpos + 1).cast("int"), F.lit(1))).alias("base"), gone.alias("is_del"), (F.col("_o.op") == "N").alias("is_refskip"),
        indel.alias("indel"), F.when(indel > 0, F.substring(F.col("seq"), first, indel)).alias("inserted"), (ref == F.col("pos")).alias("is_head"), (ref == F.col("pos") + F.col("_span") - 1).alias("is_tail"),
    )


def pileup_counts(reads: DataFrame) -> DataFrame:
    """chrom, pos, depth, a, c, g, t, dels, inserts, deletes, heads, tails of the reads there."""
    base = F.col("base")
    letters = [F.count_if(base == b).alias(b.lower()) for b in "ACGT"]
    return aligned_bases(reads).groupBy("chrom", F.col("ref_pos").alias("pos")).agg(
        F.count("*").alias("depth"), *letters, F.count_if("is_del").alias("dels"), F.count_if(F.col("indel") > 0).alias("inserts"), F.count_if(F.col("indel") < 0).alias("deletes"), F.count_if("is_head").alias("heads"), F.count_if("is_tail").alias("tails")
    )


def insertions(reads: DataFrame) -> DataFrame:
    """chrom, pos, inserted, n: texts that reads insert after a position."""
    return aligned_bases(reads).filter("indel > 0").groupBy("chrom", F.col("ref_pos").alias("pos"), "inserted").agg(F.count("*").alias("n"))


def nway_pileup(inputs: DataFrame, which: str, count: int) -> DataFrame:
    """chrom, pos, n_0, n_1, ...: depth of each of ``count`` inputs (column ``which``) at positions that any covers; one shuffle."""
    depths = [F.count_if(F.col(which) == i).alias(f"n_{i}") for i in range(count)]
    return aligned_bases(inputs).groupBy("chrom", F.col("ref_pos").alias("pos")).agg(*depths)
