"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins, cigar, confidence, edits, sequence, variant
from ..functions.filters import compile_filter
from ..functions.basemods import base_mods
from ..functions.stats import fisher
from ..operators import aggregates, intervals, merge, pileup, qc, synced
from ..sources import bam, bcf, faidx, index, text
from ..sources.shared import shared_path
from ..streaming import windows
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``{reads}`` and the like in its SQL stand for the views."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            made = sql
            for view, text in (("reads", V.READS_SQL), ("alignments", V.ALIGNMENTS_SQL), ("regions", V.REGIONS_SQL), ("variants", V.VARIANTS_SQL)):
                made = made.replace("{" + view + "}", f"({text})")
            ORACLES[name] = made
        return f

    return keep


# Scans, projections, filters

query("scan_count", "SELECT count(*) AS n FROM {reads}")(lambda s, d: V.reads(s, d).agg(F.count("*").alias("n")))
query("column_subset", "SELECT qname, flag, rname, pos FROM {reads}")(lambda s, d: V.reads(s, d).select("qname", "flag", "rname", "pos"))
query("flag_filter", "SELECT doc_id, flag FROM {reads} WHERE flag & 4 = 0 AND flag & 2048 = 0")(lambda s, d: V.reads(s, d).filter("flag & 4 = 0 AND flag & 2048 = 0").select("doc_id", "flag"))
query("min_length_filter", "SELECT doc_id, CAST(length(seq) AS INT) AS n FROM {reads} WHERE length(seq) >= 32 AND regexp_matches(substr(seq, 1, 32), '^[ACGT]+$')")(
    lambda s, d: V.reads(s, d).filter(F.length("seq") >= 32).filter(F.substring("seq", 1, 32).rlike("^[ACGT]+$")).select("doc_id", F.length("seq").alias("n"))
)
query("flag_names", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN flag & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(sequence.FLAGS)) + ") AS names FROM {reads}")(
    lambda s, d: V.reads(s, d).select("doc_id", sequence.flag_names(F.col("flag")).alias("names"))
)
query("flag_parse", "SELECT doc_id, flag AS parsed FROM {reads}")(
    lambda s, d: V.reads(s, d).select("doc_id", sequence.flag_value(F.when(F.col("doc_id") % 2 == 0, sequence.flag_names(F.col("flag"))).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("0x"), F.hex("flag"))).otherwise(F.col("flag").cast("string"))).alias("parsed"))
)

# The filter language: each query has the condition in plain SQL beside it.
FILTERS = {
    "arith": ("pos % 23 == 11 || (mapq + 1) * 2 > 100", "(pos + 1) % 23 = 11 OR (mapq + 1) * 2 > 100"),
    "bit": ("flag & 0x10 && !(flag & 4) || flag ^ 3 == 14", "((flag & 16 <> 0) AND flag & 4 = 0) OR xor(flag, 3) = 14"),
    "cmp": ("mapq > 30 && rname == \"s3\"", "mapq > 30 AND rname = 's3'"),
    "regex": ('[MD] =~ "A.*[[:alpha:]]A" || qname =~ "7$"', "coalesce(regexp_matches(md, 'A.*[[:alpha:]]A'), false) OR regexp_matches(qname, '7$')"),
    "func": ("length(seq) != qlen && rlen > 40 || length(qname) > 3", "(length(seq) <> {qlen} AND {rlen} > 40) OR len(qname) > 3"),
    "fold": ("mapq < 5 || tlen > 0 && flag.reverse", "(mapq < 5 OR tlen > 0) AND flag & 16 <> 0"),
    "tag": ("[NM] && [NM] >= 3", "nm IS NOT NULL AND nm >= 3"),
    "presence": ("[NM] && !([MD] == \"x\")", "nm IS NOT NULL"),
    "mixed": ('[NM] != "5" && rname != "*"', "rname IS NOT NULL"),
    "library": ('library == "libA" && endpos - pos >= 99', "rg = 'x0' AND greatest(CASE WHEN flag & 4 <> 0 THEN 0 ELSE {rlen} END, 1) - 1 >= 99"),
}
RLEN_SQL = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '\\d+[MDN=X]'), lambda x: CAST(x[1 : len(x) - 1] AS BIGINT))), 0)"
QLEN_SQL = RLEN_SQL.replace("MDN=X", "MIS=X")
for _name, (_text, _sql) in FILTERS.items():
    query(f"filter_expr_{_name}", f"SELECT doc_id FROM {{reads}} WHERE {_sql.replace('{rlen}', RLEN_SQL).replace('{qlen}', QLEN_SQL)}")(lambda s, d, text=_text: V.reads(s, d).filter(compile_filter(text)).select("doc_id"))
query("filter_expr_qual", "SELECT doc_id FROM {reads} WHERE (53.0 * (length(seq) - length(replace(seq, 'A', ''))) + 58.0 * (length(seq) - length(replace(seq, 'C', ''))) + 63.0 * (length(seq) - length(replace(seq, 'G', ''))) + 68.0 * (length(seq) - length(replace(seq, 'T', '')))) / length(seq) >= 60 AND contains(seq, 'A')")(
    lambda s, d: V.reads(s, d).filter(compile_filter("avg(qual) >= 60 && min(qual) == 53")).select("doc_id")
)
query("tag_lookup", "SELECT doc_id, CAST(nm AS DOUBLE) AS nm, md FROM {reads}")(lambda s, d: V.reads(s, d).select("doc_id", F.col("tags")["NM"]["d"].alias("nm"), F.col("tags")["MD"]["s"].alias("md")))
query("tag_delete", "SELECT doc_id, CAST(CASE WHEN md IS NULL THEN 0 ELSE 1 END AS INT) AS n FROM {reads}")(lambda s, d: V.reads(s, d).select("doc_id", F.size(F.map_filter("tags", lambda k, _: k != "NM")).alias("n")))

# Sequence and CIGAR functions

query("revcomp", "SELECT doc_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM {reads}")(lambda s, d: V.reads(s, d).select("doc_id", sequence.reverse_complement(F.col("seq")).alias("rc")))
query("gc_content", "SELECT doc_id, CAST(floor(255.0 * (length(seq) - length(translate(seq, 'CG', ''))) / length(seq) + 0.5) AS INT) AS gc FROM {reads} WHERE length(seq) > 0")(
    lambda s, d: V.reads(s, d).filter(F.length("seq") > 0).select("doc_id", sequence.gc(F.col("seq")).alias("gc"))
)
query("cigar_qlen", f"SELECT doc_id, CAST({QLEN_SQL} AS BIGINT) AS qlen FROM {{reads}}")(lambda s, d: V.reads(s, d).select("doc_id", cigar.qlen(F.col("cigar")).alias("qlen")))
query("cigar_rlen", f"SELECT doc_id, CAST({RLEN_SQL} AS BIGINT) AS rlen FROM {{reads}}")(lambda s, d: V.reads(s, d).select("doc_id", cigar.rlen(F.col("cigar")).alias("rlen")))
query("endpos", f"SELECT doc_id, CAST(pos + greatest(CASE WHEN flag & 4 <> 0 THEN 0 ELSE {RLEN_SQL} END, 1) AS BIGINT) AS endpos FROM {{reads}}")(
    lambda s, d: V.reads(s, d).select("doc_id", cigar.endpos(F.col("flag"), F.col("pos"), F.col("cigar")).alias("endpos"))
)
query("cigar_ops", r"SELECT doc_id, x[len(x)] AS op, CAST(x[1 : len(x) - 1] AS INT) AS len FROM (SELECT doc_id, unnest(regexp_extract_all(cigar, '\d+[MIDNSHP=XB]')) AS x FROM {reads})")(
    lambda s, d: V.reads(s, d).select("doc_id", F.explode(cigar.ops(F.col("cigar"))).alias("o")).select("doc_id", "o.op", "o.len")
)

# Aggregations

query("idxstats", "SELECT rname, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 <> 0) AS unmapped FROM {reads} GROUP BY rname")(lambda s, d: aggregates.idxstats(V.reads(s, d)))
query("read_summary", "SELECT count(*) AS total, count(*) FILTER (flag & 4 = 0) AS aligned, CAST(min(length(seq)) AS INT) AS min_len, CAST(max(length(seq)) AS INT) AS max_len, CAST(sum(length(seq)) AS BIGINT) AS bases FROM {reads}")(lambda s, d: aggregates.read_summary(V.reads(s, d)))
query("len_hist", "SELECT CAST(length(seq) AS INT) AS len, count(*) AS n FROM {reads} GROUP BY 1")(lambda s, d: V.reads(s, d).groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n")))
query("base_by_pos", "SELECT CAST(i - 1 AS INT) AS place, seq[i] AS base, count(*) AS n FROM {reads}, unnest(range(1, length(seq) + 1)) AS u(i) GROUP BY 1, 2")(lambda s, d: aggregates.base_by_position(V.reads(s, d)))
query("kmer5_hist", "SELECT substr(seq, CAST(i AS INT), 5) AS kmer, count(*) AS n FROM {reads}, unnest(range(1, length(seq) - 3)) AS u(i) GROUP BY 1")(lambda s, d: aggregates.kmer_histogram(V.reads(s, d)))
_DUP = """WITH v AS (SELECT translate(substr(seq, 1, 12), 'TGAC', '0123') AS key, translate(substr(seq, 1, 32), 'TGAC', '0123') AS kmer, CAST(floor(255.0 * (length(seq) - length(translate(seq, 'CG', ''))) / length(seq) + 0.5) AS INT) AS gc
  FROM {reads} WHERE flag & 2048 = 0 AND length(seq) >= 32), g AS (SELECT key, kmer, count(*) AS n, avg(gc) AS gc FROM v GROUP BY 1, 2), t AS (SELECT key, min(kmer) AS kmer, arg_min(n, kmer) AS n, arg_min(gc, kmer) AS gc FROM g GROUP BY 1) """
query("dup_hist", _DUP + "SELECT least(n, 31) AS bucket, count(*) AS keys, round(avg(gc) / 255, 6) AS mean_gc FROM t GROUP BY 1")(lambda s, d: aggregates.duplicate_histogram(aggregates.duplicate_table(V.reads(s, d))))
query("dup_rate", _DUP + "SELECT coalesce(sum(n - 1) / CAST(sum(n) AS DOUBLE), 0.0) AS rate FROM t")(lambda s, d: aggregates.duplicate_rate(aggregates.duplicate_table(V.reads(s, d))))
query("overrep", "SELECT (max(c) - 1) / CAST(sum(c) AS DOUBLE) AS rate FROM (SELECT count(*) AS c FROM {reads} GROUP BY seq)")(lambda s, d: aggregates.overrepresented(V.reads(s, d)))
query("mapq_rollup", "SELECT rname, CAST(flag & 16 AS INT) AS strand, count(*) AS n FROM {reads} GROUP BY ROLLUP (rname, CAST(flag & 16 AS INT))")(lambda s, d: V.reads(s, d).rollup("rname", F.col("flag").bitwiseAND(F.lit(16)).alias("strand")).agg(F.count("*").alias("n")))

# Intervals

query("reg2bin", "SELECT beg, \"end\", " + "CASE " + " ".join(f'WHEN beg >> {s} = ("end" - 1) >> {s} THEN {f} + (beg >> {s})' for s, f in bins.LEVELS) + " ELSE 0 END AS bin FROM {regions}")(lambda s, d: V.regions(s, d).select("beg", "end", bins.reg2bin(F.col("beg"), F.col("end")).alias("bin")))
query("bins_overlapping", "SELECT beg, \"end\", unnest(flatten([[CAST(0 AS BIGINT)], " + ", ".join(f'range({f} + (beg >> {s}), {f} + (("end" - 1) >> {s}) + 1)' for s, f in reversed(bins.LEVELS)) + "])) AS bin FROM {regions}")(
    lambda s, d: V.regions(s, d).select("beg", "end", F.explode(bins.overlapping_bins(F.col("beg"), F.col("end"))).alias("bin"))
)
query("bin_index", 'SELECT chrom, CASE ' + " ".join(f'WHEN beg >> {s} = ("end" - 1) >> {s} THEN {f} + (beg >> {s})' for s, f in bins.LEVELS) + ' ELSE 0 END AS bin, min(beg) AS first, max("end") AS last, count(*) AS n FROM {alignments} GROUP BY 1, 2')(
    lambda s, d: V.alignments(s, d).groupBy("chrom", bins.reg2bin(F.col("beg"), F.col("end")).alias("bin")).agg(F.min("beg").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"))
)
_OVERLAP = 'a.chrom = r.chrom AND a.beg < r."end" AND r.beg < a."end"'
query("overlap_inner", f'SELECT a.*, r.chrom AS r_chrom, r.beg AS r_beg, r."end" AS r_end, r.payload AS r_payload FROM {{alignments}} a JOIN {{regions}} r ON {_OVERLAP}')(lambda s, d: intervals.overlap_join(V.alignments(s, d), V.regions(s, d)))
query("overlap_semi", f"SELECT a.* FROM {{alignments}} a WHERE EXISTS (SELECT 1 FROM {{regions}} r WHERE {_OVERLAP})")(lambda s, d: intervals.overlap_join(V.alignments(s, d), V.regions(s, d), "left_semi"))
query("overlap_anti", f"SELECT a.* FROM {{alignments}} a WHERE NOT EXISTS (SELECT 1 FROM {{regions}} r WHERE {_OVERLAP})")(lambda s, d: intervals.overlap_join(V.alignments(s, d), V.regions(s, d), "left_anti"))
query("region_compact", 'WITH m AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {regions}), i AS (SELECT *, sum(CASE WHEN seen IS NULL OR beg > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT chrom, min(beg) AS beg, max("end") AS "end" FROM i GROUP BY chrom, k')(
    lambda s, d: intervals.compact(V.regions(s, d))
)


@query("region_scan", "SELECT chrom, beg, \"end\", mapq FROM {alignments} WHERE chrom = 's2' AND \"end\" > 9999 AND beg < 60000 AND mapq > 30")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chrom, beg, end = intervals.parse_region("s2:10,000-60k")
    return V.alignments(spark, sf_dir).filter((F.col("chrom") == chrom) & (F.col("end") > beg) & (F.col("beg") < end) & (F.col("mapq") > 30)).select("chrom", "beg", "end", "mapq")


# Pileup, sorts, windows

query("depth_delta", 'WITH s AS (SELECT chrom, beg AS place, 1 AS d FROM {alignments} WHERE "end" > beg UNION ALL SELECT chrom, "end", -1 FROM {alignments} WHERE "end" > beg), g AS (SELECT chrom, place, sum(d) AS d FROM s GROUP BY 1, 2 HAVING sum(d) <> 0), r AS (SELECT chrom, place AS beg, lead(place) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM g WINDOW w AS (PARTITION BY chrom ORDER BY place)) SELECT * FROM r WHERE depth > 0')(
    lambda s, d: pileup.depth(V.alignments(s, d))
)
query("pileup_depth", 'SELECT chrom, pos, count(*) AS depth FROM {alignments}, unnest(range(beg, "end")) AS u(pos) GROUP BY 1, 2')(lambda s, d: pileup.position_depth(V.alignments(s, d)))
query("pileup_explode", "SELECT rname AS chrom, pos + i - 1 AS pos, seq[i] AS base, count(*) AS n FROM {reads}, unnest(range(1, length(seq) + 1)) AS u(i) WHERE flag & 4 = 0 AND rname IS NOT NULL GROUP BY 1, 2, 3")(
    lambda s, d: pileup.pileup(V.reads(s, d).filter("flag & 4 = 0 AND rname IS NOT NULL").select(F.col("rname").alias("chrom"), F.col("pos").alias("beg"), "seq"))
)
#: What the four kinds of CIGAR of the view say of position i of a read: place in the read (null in a deletion) and the indel after it.
_KIND = "CASE WHEN length(seq) < 20 THEN 0 ELSE doc_id % 4 END"
_SPAN = f"(CASE {_KIND} WHEN 1 THEN length(seq) - 5 WHEN 2 THEN length(seq) + 3 WHEN 3 THEN length(seq) - 2 ELSE length(seq) END)"
_PLACED = f"""(SELECT doc_id, rname AS chrom, pos + i AS pos, i = 0 AS head, i = span - 1 AS tail, tid, seq,
  CASE kind WHEN 1 THEN i + 5 WHEN 2 THEN CASE WHEN i < 10 THEN i WHEN i >= 13 THEN i - 3 END WHEN 3 THEN CASE WHEN i < 10 THEN i ELSE i + 2 END ELSE i END AS q,
  CASE WHEN kind = 2 AND i = 9 THEN -3 WHEN kind = 3 AND i = 9 THEN 2 ELSE 0 END AS indel
  FROM (SELECT *, {_KIND} AS kind, {_SPAN} AS span FROM {{reads}} WHERE flag & 4 = 0 AND rname IS NOT NULL), unnest(range(0, span)) AS u(i))"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reads(spark, sf_dir).filter("flag & 4 = 0 AND rname IS NOT NULL").select("tid", F.col("rname").alias("chrom"), "pos", "cigar", "seq")


query("pileup_cigar", "SELECT chrom, pos, count(*) AS depth, " + ", ".join(f"count(*) FILTER (q IS NOT NULL AND seq[q + 1] = '{b}') AS {b.lower()}" for b in "ACGT") + f", count(*) FILTER (q IS NULL) AS dels, count(*) FILTER (indel > 0) AS inserts, count(*) FILTER (indel < 0) AS deletes, count(*) FILTER (head) AS heads, count(*) FILTER (tail) AS tails FROM {_PLACED} GROUP BY 1, 2")(
    lambda s, d: pileup.pileup_counts(_mapped(s, d))
)
query("pileup_insertions", f"SELECT chrom, pos, seq[q + 2 : q + 1 + indel] AS inserted, count(*) AS n FROM {_PLACED} WHERE indel > 0 GROUP BY 1, 2, 3")(lambda s, d: pileup.insertions(_mapped(s, d)))
query("pileup_nway", "SELECT chrom, pos, " + ", ".join(f"count(*) FILTER (tid % 3 = {i}) AS n_{i}" for i in range(3)) + f" FROM {_PLACED} GROUP BY 1, 2")(lambda s, d: pileup.nway_pileup(_mapped(s, d).withColumn("input", F.col("tid") % 3), "input", 3))
query("top_depth", 'SELECT chrom, pos, count(*) AS depth FROM {alignments}, unnest(range(beg, "end")) AS u(pos) GROUP BY 1, 2 ORDER BY depth DESC, chrom, pos LIMIT 25')(lambda s, d: pileup.position_depth(V.alignments(s, d)).orderBy(F.desc("depth"), "chrom", "pos").limit(25))
query("coord_sort", "SELECT doc_id, rname, pos FROM {reads} ORDER BY rname NULLS LAST, pos")(lambda s, d: V.reads(s, d).select("doc_id", "rname", "pos").orderBy(F.asc_nulls_last("rname"), "pos"))
query("sorted_check_lag", "SELECT chrom, CAST(count(*) FILTER (beg < before) AS BIGINT) AS unsorted FROM (SELECT chrom, beg, lag(beg) OVER (PARTITION BY chrom ORDER BY mapq, beg) AS before FROM {alignments}) GROUP BY chrom")(
    lambda s, d: V.alignments(s, d).withColumn("before", F.lag("beg").over(Window.partitionBy("chrom").orderBy("mapq", "beg"))).groupBy("chrom").agg(F.count_if(F.col("beg") < F.col("before")).alias("unsorted"))
)

# Joins of records

#: Mates next to each other: each pair on one reference, its ends told apart by a flag.
_PAIRED = {"tid": "CAST(doc_id // 2 % 20 AS INT)", "mtid": "CAST(doc_id // 2 % 20 - doc_id // 2 % 7 // 6 AS INT)", "flag": "(flag & 3893) | CASE WHEN doc_id % 2 = 0 THEN 64 ELSE 128 END | CASE WHEN doc_id // 2 % 5 = 0 THEN 10 ELSE 2 END"}
_PAIRS_SQL = "(SELECT * REPLACE (" + ", ".join(f"{e} AS {n}" for n, e in _PAIRED.items()) + f"), pos + greatest(CASE WHEN flag & 4 <> 0 THEN 0 ELSE {RLEN_SQL} END, 1) AS endpos FROM {{reads}})"
_GATE = "{0}.flag & 2 <> 0 AND {0}.flag & 8 = 0 AND {0}.tid = {0}.mtid AND NOT (abs({0}.tlen) >= 2 * length({0}.seq) AND {0}.mpos >= {0}.endpos)"
query("mate_self_join", f"SELECT a.qname, a.pos AS first_pos, b.pos AS second_pos FROM {_PAIRS_SQL} a JOIN {_PAIRS_SQL} b ON a.qname = b.qname AND a.tid = b.tid WHERE a.flag & 64 <> 0 AND b.flag & 128 <> 0 AND {_GATE.format('a')} AND {_GATE.format('b')}")(
    lambda s, d: merge.mates(V.reads(s, d).withColumns({n: F.expr(e.replace("//", "div")) for n, e in _PAIRED.items()}))
)


@query("library_join", "SELECT r.doc_id, coalesce(g.lb, '') AS library FROM {reads} r LEFT JOIN (VALUES ('x0', 'libA'), ('x1', 'libB')) g(id, lb) ON r.rg = g.id")
def library_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("x0", "libA"), ("x1", "libB")], "id string, lb string")  # the header's read groups
    reads = V.reads(spark, sf_dir)
    return reads.join(F.broadcast(groups), reads.rg == groups.id, "left").select("doc_id", F.coalesce("lb", F.lit("")).alias("library"))


query("nway_full_merge", "SELECT chrom, pos, upper(concat_ws('>', ref, alt)) AS key, " + ", ".join(f"CAST(max(CASE WHEN sample % 3 = {i} THEN 1 ELSE 0 END) AS INT) AS in_{i}" for i in range(3)) + " FROM {variants} GROUP BY 1, 2, 3")(
    lambda s, d: merge.synced([V.variants(s, d).filter(F.col("sample") % 3 == i) for i in range(3)])
)

# Variants


_TYPED = """WITH v AS (SELECT ref, alt, length(ref) AS nr, length(alt) AS na, count(*) AS n FROM {variants} GROUP BY 1, 2),
p AS (SELECT *, len(list_filter(range(1, least(nr, na) + 1), lambda i: ref[1:i] = alt[1:i])) AS pre FROM v),
r AS (SELECT *, len(list_filter(range(1, least(nr, na) - pre), lambda i: ref[nr - i + 1:nr] = alt[na - i + 1:na])) AS suf FROM p),
e AS (SELECT *, nr - pre - 1 - suf AS re, na - pre - 1 - suf AS ae FROM r),
t AS (SELECT ref, alt, n, CASE WHEN nr = 1 AND na = 1 THEN CASE WHEN ref = alt THEN 0 ELSE 1 END WHEN pre = nr AND pre = na THEN 0 WHEN pre = nr OR pre = na THEN 4
  WHEN ae = 0 AND re = 0 THEN 1 WHEN ae = 0 OR re = 0 THEN CASE WHEN ref[pre + re + 1] = alt[pre + ae + 1] THEN 4 ELSE 8 END WHEN re = ae THEN 2 ELSE 8 END AS kind,
  CASE WHEN nr = 1 AND na = 1 THEN CASE WHEN ref = alt THEN 0 ELSE 1 END WHEN pre = nr OR pre = na THEN na - nr WHEN ae = 0 AND re = 0 THEN 1 WHEN ae = 0 THEN -re WHEN re = 0 THEN ae WHEN re > ae THEN -(re + 1) ELSE ae + 1 END AS size FROM e) """


@query("variant_type", _TYPED + "SELECT ref, alt, kind, CAST(size AS INT) AS size, n FROM t")
def variant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = V.variants(spark, sf_dir).groupBy("ref", "alt").agg(F.count("*").alias("n"))
    return groups.select("ref", "alt", "n", variant.variant_type(F.col("ref"), F.col("alt")).alias("kind"), variant.variant_length(F.col("ref"), F.col("alt")).cast("int").alias("size"))


query("record_types", _TYPED + "SELECT ref, CAST(bit_or(kind) AS INT) AS kinds FROM t GROUP BY ref")(lambda s, d: V.variants(s, d).groupBy("ref").agg(F.collect_set("alt").alias("alts")).select("ref", variant.record_types(F.col("ref"), F.col("alts")).alias("kinds")))
query("is_snp", "SELECT ref, alt, length(ref) = 1 AND length(alt) = 1 AS snp, count(*) AS n FROM {variants} GROUP BY 1, 2, 3")(lambda s, d: V.variants(s, d).groupBy("ref", "alt").agg(F.count("*").alias("n")).withColumn("snp", variant.is_snp(F.col("ref"), F.array("alt"))))
query("allele_count", "SELECT chrom, pos, CAST(a AS INT) AS allele, count(*) AS n FROM (SELECT chrom, pos, unnest(regexp_split_to_array(gt, '[/|]')) AS a FROM {variants}) WHERE a <> '.' GROUP BY 1, 2, 3")(
    lambda s, d: V.variants(s, d).select("chrom", "pos", F.explode(variant.alleles(F.col("gt"))).alias("allele")).filter("allele is not null").groupBy("chrom", "pos", "allele").agg(F.count("*").alias("n"))
)
query("gt_class", "SELECT gt, CASE WHEN contains(gt, '.') THEN 'UNKN' WHEN gt[1] = gt[3] THEN CASE WHEN gt[1] = '0' THEN 'HOM_RR' ELSE 'HOM_AA' END WHEN contains(gt, '0') THEN 'HET_RA' ELSE 'HET_AA' END AS class, count(*) AS n FROM {variants} GROUP BY 1, 2")(
    lambda s, d: V.variants(s, d).groupBy("gt").agg(F.count("*").alias("n")).withColumn("class", variant.genotype_class(F.col("gt")))
)
query("trim_alleles", "SELECT chrom, pos, CAST((max(CASE WHEN contains(gt, '1') THEN 1 ELSE 0 END)) + max(CASE WHEN contains(gt, '2') THEN 1 ELSE 0 END) AS INT) AS kept FROM {variants} GROUP BY 1, 2")(
    lambda s, d: V.variants(s, d).groupBy("chrom", "pos").agg(F.collect_set("gt").alias("gts")).select("chrom", "pos", F.size(variant.trim_alleles(F.array(F.lit("G"), F.lit("T")), F.col("gts"))).alias("kept"))
)
query("sample_subset", "SELECT chrom, pos, ref, alt, gt FROM {variants} WHERE sample IN (1, 3)")(lambda s, d: V.variants(s, d).filter(F.col("sample").isin(1, 3)).select("chrom", "pos", "ref", "alt", "gt"))
query("sample_exclude", "SELECT chrom, pos, ref, alt, gt FROM {variants} WHERE sample NOT IN (1, 3)")(lambda s, d: V.variants(s, d).filter(~F.col("sample").isin(1, 3)).select("chrom", "pos", "ref", "alt", "gt"))
query("filter_has", "SELECT chrom, pos, filters FROM {variants} WHERE list_has_any(string_split(filters, ';'), ['PASS', 's50'])")(lambda s, d: V.variants(s, d).filter(F.arrays_overlap(F.split("filters", ";"), F.array(F.lit("PASS"), F.lit("s50")))).select("chrom", "pos", "filters"))
query("header_union", "SELECT DISTINCT chrom FROM (SELECT chrom FROM {alignments} UNION SELECT chrom FROM {regions})")(lambda s, d: V.alignments(s, d).select("chrom").union(V.regions(s, d).select("chrom")).distinct())
query("contigs_common", "SELECT chrom FROM {alignments} INTERSECT SELECT chrom FROM {regions}")(lambda s, d: V.alignments(s, d).select("chrom").intersect(V.regions(s, d).select("chrom")))


_TABLES = """SELECT chrom, pos, count(*) FILTER (z AND e) AS a, count(*) FILTER (z AND NOT e) AS b, count(*) FILTER (NOT z AND e) AS c, count(*) FILTER (NOT z AND NOT e) AS d
  FROM (SELECT chrom, pos, gt[1] = '0' AS z, sample % 2 = 0 AS e FROM {variants}) GROUP BY 1, 2"""
_LOG = "CASE WHEN {0} <= 1 THEN 0 ELSE lgamma({0} + 1) END"
_CHANCE = "exp(" + " + ".join(_LOG.format(x) for x in ("(a + b)", "(c + d)", "(a + c)", "(b + d)")) + " - " + " - ".join(_LOG.format(x) for x in ("(a + b + c + d)", "x", "(a + b - x)", "(a + c - x)", "(d - a + x)")) + ")"


@query("fisher_exact", f"""WITH t AS ({_TABLES}), u AS (SELECT DISTINCT a, b, c, d FROM t), s AS (SELECT a, b, c, d, x, {_CHANCE} AS p FROM u, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS r(x)),
  o AS (SELECT *, max(p) FILTER (x = a) OVER (PARTITION BY a, b, c, d) AS own FROM s), f AS (SELECT a, b, c, d, sum(p) FILTER (x <= a) AS l, sum(p) FILTER (x >= a) AS r, sum(p) FILTER (p <= own * 1.0000001) AS w FROM o GROUP BY ALL)
  SELECT chrom, pos, t.a, t.b, t.c, t.d, round(least(l, 1.0), 9) AS left_p, round(least(r, 1.0), 9) AS right_p, round(least(w, 1.0), 9) AS p FROM t JOIN f ON t.a = f.a AND t.b = f.b AND t.c = f.c AND t.d = f.d""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strand bias: alleles against strands at every position."""
    zero, even = F.substring("gt", 1, 1) == "0", F.col("sample") % 2 == 0
    counts = V.variants(spark, sf_dir).groupBy("chrom", "pos").agg(*(F.count_if(x & y).alias(n) for n, x, y in (("a", zero, even), ("b", zero, ~even), ("c", ~zero, even), ("d", ~zero, ~even))))
    found = counts.withColumn("f", fisher(*map(F.col, "abcd")))
    return found.select("chrom", "pos", *"abcd", *(F.round(f"f.{x}", 9).alias(n) for x, n in (("left", "left_p"), ("right", "right_p"), ("two", "p"))))


# Records of several inputs


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variants(spark, sf_dir).withColumn("alts", F.array("alt"))


_PREFIX = "len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda i: ref[1:i] = alt[1:i]))"
_ISLANDS = ORACLES["region_compact"].replace("beg > seen", "beg >= seen")
for _mode, _first, _last in ((synced.POSITION, "pos", "pos"), (synced.RECORD, "pos", "pos + length(ref) - 1"), (synced.VARIANT, f"pos + {_PREFIX}", "pos + length(ref) - 1")):
    query(f"regions_overlap_{_mode}", f"WITH k AS ({_ISLANDS}) SELECT chrom, pos, ref, alt, gt FROM (SELECT *, {_first} AS f, {_last} AS l FROM {{variants}}) v WHERE EXISTS (SELECT 1 FROM k WHERE k.chrom = v.chrom AND k.beg <= v.l AND v.f < k.\"end\")")(
        lambda s, d, mode=_mode: synced.in_regions(_records(s, d), V.regions(s, d), mode).select("chrom", "pos", "ref", "alt", "gt")
    )
query("targets_exclude", f"WITH k AS ({_ISLANDS}) SELECT chrom, pos, ref, alt, gt FROM {{variants}} v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chrom = v.chrom AND k.beg < v.pos + length(v.ref) AND v.pos < k.\"end\")")(
    lambda s, d: synced.in_regions(_records(s, d), V.regions(s, d), exclude=True).select("chrom", "pos", "ref", "alt", "gt")
)
query("targets_alleles", "SELECT chrom, pos, ref, alt, gt FROM {variants} v WHERE sample > 1 AND EXISTS (SELECT 1 FROM {variants} t WHERE t.sample = 1 AND t.chrom = v.chrom AND t.pos = v.pos AND t.ref = v.ref AND t.alt = v.alt)")(
    lambda s, d: synced.at_targets(_records(s, d).filter("sample > 1"), _records(s, d).filter("sample = 1").select("chrom", "pos", "ref", "alts")).select("chrom", "pos", "ref", "alt", "gt")
)
query("pair_exact", "SELECT chrom, pos, allele, list_sort(list(which)) AS inputs FROM (SELECT chrom, pos, concat(ref, '>', alt) AS allele, sample % 3 AS which, row_number() OVER (PARTITION BY chrom, pos, ref, alt, sample % 3) AS k FROM {variants}) GROUP BY chrom, pos, allele, k")(
    lambda s, d: synced.paired(_records(s, d).withColumn("which", F.col("sample") % 3), "which").select("chrom", "pos", F.col("members")[0]["alleles"][0].alias("allele"), F.col("members.which").alias("inputs"))
)
query("pair_snps_indels")(lambda s, d: synced.paired(_records(s, d).withColumn("which", F.col("sample") % 3), "which", ["snps", "indels"]))


# Modified bases: calls at the 1st, 3rd and 6th C as sequenced, where a read has so many

_MARKS = "CASE WHEN flag & 16 <> 0 THEN list_reverse(list_filter(range(1, length(seq) + 1), lambda i: seq[i] = 'G')) ELSE list_filter(range(1, length(seq) + 1), lambda i: seq[i] = 'C') END"


@query("base_mods", f"SELECT doc_id, CAST(m[x] - 1 AS INT) AS place, 'm' AS code, CAST(x * 20 AS INT) AS likelihood FROM (SELECT doc_id, {_MARKS} AS m FROM {{reads}}), unnest([1, 3, 6]) AS u(x) WHERE len(m) >= 6")
def modified_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("flag")
    enough = F.when(flag.bitwiseAND(F.lit(16)) != 0, sequence.base_count(F.col("seq"), "G")).otherwise(sequence.base_count(F.col("seq"), "C")) >= 6
    calls = base_mods(F.col("seq"), flag, F.when(enough, F.lit("C+m?,0,1,2;")), F.when(enough, F.array(*map(F.lit, (20, 60, 120)))))
    return V.reads(spark, sf_dir).select("doc_id", F.explode(calls).alias("m")).select("doc_id", F.col("m.pos").alias("place"), "m.code", "m.likelihood")


# Events

query("event_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda s, d: V.events(s, d).groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))
)
query("event_sliding", "SELECT date_trunc('hour', ts) - i * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, unnest(range(0, 3)) AS u(i) GROUP BY 1")(
    lambda s, d: V.events(s, d).groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
)
query("event_session", "WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, s")(
    lambda s, d: V.events(s, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
)
query("json_props", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events")(lambda s, d: V.events(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))


# Quality metrics

_LETTERS = "(SELECT CAST(i - 1 AS INT) AS place, seq[i] AS base, CASE seq[i] WHEN 'A' THEN 20 WHEN 'C' THEN 25 WHEN 'G' THEN 30 ELSE 35 END AS q FROM {reads}, unnest(range(1, length(seq) + 1)) AS u(i))"
_SHARES = ", ".join(f"round(count(*) FILTER (base = '{b}') / CAST(count(*) AS DOUBLE), 6) AS {b.lower()}_share" for b in "ACGT")
query("quality_by_position", f"SELECT place, count(*) AS n, round(avg(q), 6) AS mean_quality FROM {_LETTERS} GROUP BY place")(lambda s, d: qc.quality_by_position(V.reads(s, d)))
query("quality_hist", f"SELECT CAST(q AS INT) AS q, count(*) AS n FROM {_LETTERS} GROUP BY q")(lambda s, d: qc.quality_histogram(V.reads(s, d)))
query("base_fractions", f"SELECT place, {_SHARES}, round(count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T')) / CAST(count(*) AS DOUBLE), 6) AS other_share FROM {_LETTERS} GROUP BY place")(lambda s, d: qc.base_fractions(V.reads(s, d)))
_COUNTED = "(SELECT length(seq) AS n, " + ", ".join(f"length(seq) - length(replace(seq, '{b}', '')) AS {b.lower()}" for b in "ACGT") + " FROM {reads} WHERE length(seq) > 0)"
query("mean_quality_hist", f"SELECT CAST(floor((20.0 * a + 25.0 * c + 30.0 * g + 35.0 * t) / n) AS INT) AS mean_quality, count(*) AS n FROM {_COUNTED} GROUP BY 1")(lambda s, d: qc.mean_quality_histogram(V.reads(s, d)))

# Files: a table goes out in the format and comes back

_REFERENCES = [(f"s{i + 1}", 1 << 29) for i in range(20)]
_ALIGNED = {"qname": "qname", "flag": "flag", "tid": "tid", "pos": "pos", "mapq": "mapq", "cigar": "CASE WHEN length(seq) > 0 THEN cigar END", "mtid": "mtid", "mpos": "mpos", "tlen": "tlen", "seq": "CASE WHEN length(seq) > 0 THEN seq END", "nm": "nm", "md": "md"}


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = V.reads(spark, sf_dir).withColumns({"cigar": F.expr(_ALIGNED["cigar"]), "seq": F.expr(_ALIGNED["seq"])})
    nm, md = F.col("tags")["NM"]["d"].cast("int").cast("string"), F.col("tags")["MD"]["s"]
    tags = F.array_compact(F.array(F.concat(F.lit("NM:i:"), nm), F.concat(F.lit("MD:Z:"), md)))
    return reads.withColumns({"tags": tags, "qual": F.when(F.col("seq").isNotNull(), F.col("qual"))})


def _bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "bam")
    bam.write_bam(_aligned(spark, sf_dir), path, _REFERENCES, "@HD\tVN:1.6\n")
    return bam.read_bam(spark.read.parquet(path))


def _tag(name: str) -> Column:
    return F.get(F.filter("tags", lambda t: t.startswith(name + ":")), F.lit(0))


query("bam_round_trip", "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ALIGNED.items()) + ", translate(CASE WHEN length(seq) > 0 THEN seq END, 'ACGT', '5:?D') AS qual FROM {reads}")(
    lambda s, d: _bam(s, d).select(*[n for n in _ALIGNED if n not in ("nm", "md")], F.substring(_tag("NM"), 6, 99).cast("bigint").alias("nm"), F.substring(_tag("MD"), 6, 9999).alias("md"), "qual")
)
query("round_trip_count", "SELECT count(*) AS n FROM {reads}")(lambda s, d: _bam(s, d).agg(F.count("*").alias("n")))


@query("bam_region", f"SELECT qname, flag, tid, pos, CASE WHEN length(seq) > 0 THEN seq END AS seq FROM {{reads}} WHERE tid = 3 AND pos < 70000 AND pos + greatest(CASE WHEN flag & 4 <> 0 OR length(seq) = 0 THEN 0 ELSE {RLEN_SQL} END, 1) > 20000")
def bam_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, indexed = shared_path(spark, "bam"), shared_path(spark, "bam-index")
    bam.write_bam(_aligned(spark, sf_dir).sortWithinPartitions("tid", "pos"), path, _REFERENCES, "@HD\tVN:1.6\tSO:coordinate\n")
    index.with_index(spark.read.parquet(path)).write.parquet(indexed)
    return index.read_region(spark.read.parquet(indexed), 3, 20000, 70000).select("qname", "flag", "tid", "pos", "seq")


@query("reference_fetch", "SELECT k AS doc_id, beg, \"end\", substr(seq, CAST(beg + 1 AS INT), CAST(\"end\" - beg AS INT)) AS seq FROM (SELECT doc_id AS k, seq, doc_id % 50 AS beg, doc_id % 50 + 20 + doc_id % 400 AS \"end\" FROM {reads}) WHERE beg < length(seq)")
def reference_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "fasta")
    rows = V.reads(spark, sf_dir).select("doc_id", F.concat(F.lit("r"), "doc_id").alias("name"), "seq")
    faidx.fasta_lines(rows, 60).write.text(path)
    wanted = rows.selectExpr("doc_id", "name AS chrom", "doc_id % 50 AS beg", "doc_id % 50 + 20 + doc_id % 400 AS end")
    return faidx.fetch(wanted, faidx.windows(text.read_fasta(spark, path), 128), 128).select("doc_id", "beg", "end", "seq")


@query("sam_round_trip", "SELECT qname, flag, rname, pos, mapq, CASE WHEN length(seq) > 0 THEN cigar END AS cigar, mrname, mpos, tlen, CASE WHEN length(seq) > 0 THEN seq END AS seq, CAST(nm AS VARCHAR) AS nm, md FROM {reads}")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sam")
    tag = lambda x: F.struct(F.substring(x, 4, 1).alias("kind"), F.substring(x, F.lit(6), F.length(x)).alias("value"))
    tags = F.map_from_entries(F.transform("tags", lambda x: F.struct(F.substring(x, 1, 2), tag(x))))
    text.sam_lines(_aligned(spark, sf_dir).withColumn("tags", tags)).write.text(path)
    kept = ["qname", "flag", "rname", "pos", "mapq", "cigar", "mrname", "mpos", "tlen", "seq"]
    return text.read_sam(spark, path).select(*kept, F.col("tags")["NM"]["value"].alias("nm"), F.col("tags")["MD"]["value"].alias("md"))


@query("fastq_round_trip", "SELECT concat('r', doc_id) AS name, concat('c', flag) AS comment, seq, translate(seq, 'ACGT', '@:?D') AS qual FROM {reads}")
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "fastq")
    rows = V.reads(spark, sf_dir).select(F.concat(F.lit("r"), "doc_id").alias("name"), F.concat(F.lit("c"), "flag").alias("comment"), "seq", F.translate("seq", "ACGT", "@:?D").alias("qual"))
    text.fastq_lines(rows).write.text(path)
    return text.read_fastq(spark, path)


@query("vcf_round_trip", "SELECT chrom, pos, ref, alt, CASE WHEN filters <> '.' THEN string_split(filters, ';')[1] END AS first_filter, gt FROM {variants}")
def vcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "vcf")
    rows = V.variants(spark, sf_dir).select("chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alts"), F.lit(50.0).alias("qual"), F.when(F.col("filters") != ".", F.split("filters", ";")).alias("filters"), F.create_map(F.lit("GT"), "gt", F.lit("DB"), F.lit(None).cast("string")).alias("info"))
    text.vcf_lines(rows).write.text(path)
    return text.read_vcf(spark, path).select("chrom", "pos", "ref", F.element_at("alts", 1).alias("alt"), F.get("filters", F.lit(0)).alias("first_filter"), F.col("info")["GT"].alias("gt"))


_VCF_HEADER = "\n".join(["##fileformat=VCFv4.2", "##FILTER=<ID=q10>", "##FILTER=<ID=s50>", *(f"##contig=<ID=s{i + 1}>" for i in range(10)), "##INFO=<ID=SN,Number=1,Type=Integer>", "##FORMAT=<ID=GT,Number=1,Type=String>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tone"])


@query("bcf_round_trip", "SELECT chrom, pos, ref, alt, CASE WHEN filters <> '.' THEN filters END AS filters, CAST(sample AS BIGINT) AS sample, gt FROM {variants}")
def bcf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "bcf")
    rows = V.variants(spark, sf_dir).select("chrom", "pos", F.lit(None).cast("string").alias("id"), "ref", F.array("alt").alias("alts"), F.lit(50.0).alias("qual"), F.when(F.col("filters") != ".", F.split("filters", ";")).alias("filters"), F.create_map(F.lit("SN"), F.col("sample").cast("string")).alias("info"), F.array(F.lit("GT")).alias("format"), F.array(F.array("gt")).alias("samples"))
    bcf.write_bcf(rows, path, _VCF_HEADER)
    return bcf.read_bcf(spark.read.parquet(path)).select("chrom", "pos", "ref", F.col("alts")[0].alias("alt"), F.array_join("filters", ";").alias("filters"), edits.info_values(F.col("info"), "SN")[0].alias("sample"), F.col("samples")[0][0].alias("gt"))


@query("bed_round_trip", 'SELECT chrom, beg, "end", payload FROM {regions}')
def bed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "bed")
    V.regions(spark, sf_dir).select(F.concat_ws("\t", "chrom", "beg", "end", "payload").alias("value")).write.text(path)
    return text.read_intervals(spark, path).select("chrom", "beg", "end", F.col("fields")[3].alias("payload"))


# Changes to records, typed values, qualities from alignments

query("tag_update", "SELECT doc_id, CAST(coalesce(nm + 1, 0) AS BIGINT) AS nm, CAST(1 + CASE WHEN md IS NULL THEN 0 ELSE 1 END + 1 AS INT) AS tags FROM {reads}")(
    lambda s, d: _aligned(s, d).select("doc_id", edits.append_tag(edits.update_tag(F.col("tags"), "NM", "i", F.coalesce(edits.tag_value(F.col("tags"), "NM").cast("bigint") + 1, F.lit(0))), "XA", "Z", F.lit("x")).alias("t")).select("doc_id", edits.tag_value(F.col("t"), "NM").cast("bigint").alias("nm"), F.size("t").alias("tags"))
)
query("set_qname", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '*' ELSE concat('n', doc_id) END AS qname FROM {reads}")(lambda s, d: V.reads(s, d).select("doc_id", edits.set_qname(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("n"), "doc_id")).otherwise(F.lit(""))).alias("qname")))
query("pack_bases", "SELECT doc_id, concat(translate(seq, 'ACGT', '1248'), CASE WHEN length(seq) % 2 = 1 THEN '0' ELSE '' END) AS packed, seq FROM {reads}")(
    lambda s, d: V.reads(s, d).select("doc_id", edits.pack_bases(F.col("seq")).alias("p"), F.length("seq").alias("n")).select("doc_id", F.hex("p").alias("packed"), edits.unpack_bases(F.col("p"), F.col("n")).alias("seq"))
)
_SPLIT = "CASE WHEN filters = '.' THEN [] ELSE string_split(filters, ';') END"
query("filter_tests", f"SELECT filters, filters IN ('.', 'PASS') AS passes, list_contains({_SPLIT}, 's50') AS s50, CASE filters WHEN 'PASS' THEN 'x' WHEN '.' THEN 'x' ELSE concat(filters, ';x') END AS added, CASE filters WHEN 'q10' THEN 'PASS' WHEN 'q10;s50' THEN 's50' WHEN '.' THEN '' ELSE filters END AS removed, count(*) AS n FROM {{variants}} GROUP BY ALL")(
    lambda s, d: V.variants(s, d).groupBy("filters").agg(F.count("*").alias("n")).withColumn("f", F.when(F.col("filters") != ".", F.split("filters", ";"))).select(
        "filters", edits.has_filter(F.col("f"), "PASS").alias("passes"), edits.has_filter(F.col("f"), "s50").alias("s50"), F.array_join(edits.add_filter(F.col("f"), "x"), ";").alias("added"), F.array_join(edits.remove_filter(F.col("f"), "q10", True), ";").alias("removed"), "n"
    )
)
query("info_values", "SELECT chrom, pos, CAST(len(gt) AS BIGINT) AS first_value, CAST(NULL AS BIGINT) AS second_value, sample = 1 AS db, CAST(sample AS BIGINT) AS depth FROM {variants}")(
    lambda s, d: V.variants(s, d).withColumn("info", F.str_to_map(F.concat(F.lit("AC="), F.length("gt"), F.lit(",."), F.when(F.col("sample") == 1, F.lit(";DB")).otherwise(F.lit(""))), F.lit(";"), F.lit("="))).select(
        "chrom", "pos", edits.info_values(F.col("info"), "AC")[0].alias("first_value"), edits.info_values(F.col("info"), "AC")[1].alias("second_value"), edits.info_flag(F.col("info"), "DB").alias("db"), edits.format_values(F.array(F.lit("GT"), F.lit("DP")), F.array(F.col("gt"), F.col("sample").cast("string")), "DP")[0].alias("depth")
    )
)
#: Reads of one operation against a reference whose first 12 letters have C for A.
_CAP = "SELECT doc_id, 20.0 * m - 4.343 * coalesce(list_sum(list_transform(range(0, m), lambda i: ln(2.0 * length(seq) / (i + 1)))), 0) AS t FROM (SELECT doc_id, seq, 12 - length(replace(left(seq, 12), 'A', '')) AS m FROM {reads} WHERE doc_id % 4 = 0 AND length(seq) >= 20)"
query("cap_mapq", f"SELECT doc_id, CAST(CASE WHEN t > 40 THEN -1 ELSE floor(sqrt((40 - greatest(t, 0)) / 40) * 40 + 0.499) END AS INT) AS cap FROM ({_CAP})")(
    lambda s, d: V.reads(s, d).filter("doc_id % 4 = 0 AND length(seq) >= 20").select("doc_id", confidence.cap_mapq(F.lit(0), F.col("cigar"), F.col("seq"), F.col("qual"), F.expr("concat(translate(left(seq, 12), 'A', 'C'), substr(seq, 13))")).alias("cap"))
)


@query("mate_qualities")
def mate_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates laid near each other, so that most of them overlap; the sums of their new qualities."""
    reads = V.reads(spark, sf_dir).withColumn("mate", F.struct((F.col("doc_id") % 2 * 30).alias("pos"), "cigar", "seq", "qual"))
    pairs = reads.groupBy("qname").agg(F.min_by("mate", "doc_id").alias("a"), F.max_by("mate", "doc_id").alias("b"), F.count("*").alias("n")).filter("n = 2")
    made = pairs.select("qname", confidence.mate_qualities(F.col("qname"), F.col("a"), F.col("b")).alias("q"))
    total = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda x, v: x + v)
    return made.select("qname", total("q.left").alias("left_sum"), total("q.right").alias("right_sum"))


# Streams over the events, run to the end of what is there


def _streamed(make: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, path, checkpoint = (shared_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
        # A row far ahead of all others closes their windows; a stream's own would stay open.
        events = V.events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
        last = events.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
        events.write.parquet(source)
        last.write.mode("append").parquet(source)
        made = make(spark.readStream.schema(events.schema).parquet(source))
        windows.run_to_table(made, path, checkpoint)
        return spark.read.schema(made.schema).parquet(path)

    return run


query("stream_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(_streamed(lambda e: windows.tumbling(e, "1 hour", "10 minutes", "event_type")))
query("stream_sliding", ORACLES["event_sliding"])(_streamed(lambda e: windows.sliding(e, "3 hours", "1 hour", "10 minutes")))
query("stream_sessions", ORACLES["event_session"])(_streamed(lambda e: windows.sessions(e, "30 minutes", "10 minutes", "user_id")))
query("stream_dedupe", "SELECT DISTINCT event_id FROM events")(lambda s, d: _streamed(lambda e: windows.deduplicated(e.filter("event_id >= 0"), "event_id", "10 minutes").select("event_id"))(s, d))
