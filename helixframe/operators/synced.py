"""Variant records against regions, targets and each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate, groupby, pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variant
from . import intervals

#: Ways in which a record may overlap a region: its position, its reference letters, the letters that change.
POSITION, RECORD, VARIANT = 0, 1, 2


def boundaries(mode: int) -> tuple[Column, Column]:
    """(first, last) place of a record (pos, ref, alts) that counts; last is before first for a pure insertion of mode 2."""
    if mode == POSITION:
        return F.col("pos"), F.col("pos")
    last = F.col("pos") + F.length("ref") - 1
    if mode == RECORD:
        return F.col("pos"), last
    shared = F.array_min(F.transform("alts", lambda a: variant.common_prefix(F.col("ref"), a)))
    return F.col("pos") + F.when(F.size("alts") > 0, shared).otherwise(F.length("ref")), last


def in_regions(records: DataFrame, regions: DataFrame, mode: int = RECORD, exclude: bool = False) -> DataFrame:
    """Records (chrom, pos, ref, alts, ...) that overlap a region (chrom, beg, end half-open), or those that don't.

    A record comes once, whatever it hits.  A pure insertion of mode 2 lies
    between two letters and needs one region that holds both.
    """
    first, last = boundaries(mode)
    # [first, last] meets [beg, end) where beg <= last and first < end; as half-open intervals in halves of a letter.
    spans = records.withColumns({"beg": first * 2, "end": last * 2 + 1})
    spans = spans.withColumns({"beg": F.least("beg", "end"), "end": F.greatest("beg", "end")}) if mode == VARIANT else spans
    doubled = intervals.compact(regions, touching=False).select("chrom", (F.col("beg") * 2).alias("beg"), (F.col("end") * 2 - 1).alias("end"))
    return intervals.overlap_join(spans, doubled, "left_anti" if exclude else "left_semi", repeated=True).select(*records.columns)


def at_targets(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Records (chrom, pos, ref, alts, ...) whose alleles a target (chrom, pos, ref, alts) names: one reference, a shared alternative.

    A record with several alternatives keeps all of them; it comes once.
    """
    wanted = targets.select("chrom", "pos", F.upper("ref").alias("_ref"), F.transform("alts", F.upper).alias("_alts"))
    on = (records.chrom == wanted.chrom) & (records.pos == wanted.pos) & (F.upper(records.ref) == F.col("_ref")) & F.arrays_overlap(F.transform(records.alts, F.upper), F.col("_alts"))
    return records.join(wanted, on, "left_semi")


#: Scores of two kinds of records that may share a row, for each pairing; the larger one is taken first.
_WORTH = {
    "snps": {("snp", "snp"): 3},
    "indels": {("indel", "indel"): 3},
    "snp+ref": {("ref", "snp"): 2},
    "indel+ref": {("indel", "ref"): 2},
    "any": {("snp", "snp"): 3, ("indel", "indel"): 3, ("ref", "snp"): 2, ("indel", "ref"): 2},
}


def _worth(pairings: Iterable[str]) -> Callable[[frozenset[str], frozenset[str]], int]:
    table: dict[tuple[str, str], int] = {}
    for name in pairings:
        table |= _WORTH[name]
    least = 1 if "any" in pairings else 0

    @cache
    def worth(a: frozenset[str], b: frozenset[str]) -> int:
        return max((table.get((min(x, y), max(x, y)), least) for x in a for y in b), default=least)

    return worth


class Like(NamedTuple):
    """``count`` records of a place, next to each other in its order, that nothing tells apart."""

    inputs: frozenset
    kinds: frozenset[str]
    alleles: frozenset[str | None]
    count: int = 1


def deal(place: list[Like], worth: Callable[[frozenset[str], frozenset[str]], int]) -> list[tuple[int, list[int]]]:
    """(number of rows, indices of ``place`` that each of them holds a record of), in the order of the rows' first records.

    The row of most inputs takes in the record that suits it best, as long as
    they have no input in common: one that shares an allele, else by the worst
    pair of kinds between both, then by the number of inputs.  A row that
    nothing suits is done.  Ties go to the earlier record.

    Only the row that grows is made of several records, so what it takes next
    depends on the kinds of records that are left.  Rows are therefore made as
    many at a time as all records of one sort allow: steps grow with the sorts,
    not with the records.  Records without inputs suit their own sort and must
    have a count of 1.
    """
    left, taken, made = [x.count for x in place], [0] * len(place), []
    starts = list(accumulate(left, initial=0))
    by_inputs: dict[frozenset, list[int]] = {}
    for k, x in enumerate(place):
        by_inputs.setdefault(x.inputs, []).append(k)
    for top in sorted(range(len(place)), key=lambda k: -len(place[k].inputs)):
        while left[top]:
            row, inputs = [top], place[top].inputs
            while True:
                best, found = (0, 0), -1
                for others, members in by_inputs.items():
                    if not inputs.isdisjoint(others):
                        continue
                    for k in members:
                        if left[k] and k not in row:
                            score = _score(place, row, k, worth)
                            if score > best or score == best and k < found:
                                best, found = score, k
                if best[0] == 0:
                    break
                row.append(found)
                inputs = inputs | place[found].inputs
            count = min(left[k] for k in row)
            made.append((min(starts[k] + taken[k] for k in row), count, sorted(row)))
            for k in row:
                left[k] -= count
                taken[k] += count
    return [(count, row) for _, count, row in sorted(made)]


def _score(place: list[Like], row: list[int], k: int, worth: Callable[[frozenset[str], frozenset[str]], int]) -> tuple[int, int]:
    b = place[k]
    if any(not place[i].kinds.isdisjoint(b.kinds) and not place[i].alleles.isdisjoint(b.alleles) for i in row):
        return 4, 0
    return min(worth(place[i].kinds, b.kinds) for i in row), len(b.inputs)


def share_rows(records: list[dict], pairings: list[str]) -> list[list[int]]:
    """Indices of the records of one place (``inputs``, ``kinds``, ``alleles``), dealt to rows, see ``deal``."""
    return [row for _, row in deal([Like(*(frozenset(x[n]) for n in ("inputs", "kinds", "alleles"))) for x in records], _worth(pairings))]


def likes(counts: Iterable[tuple[tuple, object, int | None, int]]) -> tuple[list[Like], list[list[int]]]:
    """The sorts of records of one place, and for each the indices of ``counts`` that it comes from.

    ``counts`` are (alleles, which, kinds, records), equal alleles next to each
    other.  The records of an input with the same alleles lie one above the
    other, by kinds; records of one level are one.
    """
    place, sources = [], []
    for alleles, group in groupby(enumerate(counts), key=lambda x: x[1][0]):
        stacks: dict[object, list[tuple[int, int | None, int]]] = {}
        for i, (_, which, kinds, n) in sorted(group, key=lambda x: (x[1][2] is not None, x[1][2])):
            stack = stacks.setdefault(which, [])
            stack.append(((stack[-1][0] if stack else 0) + n, kinds, i))
        low = 0
        for high in sorted({end for stack in stacks.values() for end, _, _ in stack}):
            level = [(which, next(x for x in stack if x[0] > low)) for which, stack in stacks.items() if stack[-1][0] > low]
            inputs = frozenset(which for which, _ in level if which is not None)
            kinds = max((x[1] for _, x in level if x[1] is not None), default=None)
            whole = [Like(inputs, _kinds(kinds), frozenset(alleles), high - low)] if inputs else [Like(inputs, _kinds(kinds), frozenset(alleles))] * (high - low)
            place += whole
            sources += [sorted(x[2] for which, x in level if which is not None)] * len(whole)
            low = high
    return place, sources


def paired(inputs: DataFrame, which: str, pairings: list[str] = ()) -> DataFrame:
    """chrom, pos, row, members: records of several inputs (column ``which``; chrom, pos, ref, alts) dealt to shared rows.

    Records of equal alleles, in any order and case, share a row; the second
    record of an input with the same alleles starts another one.  ``pairings``
    (snps, indels, snp+ref, indel+ref, any) let more share it, see ``deal``.
    members are (which, alleles), rows are numbered from 0 in the order of
    their first alleles.  With pairings, equal records of an input are counted
    before a place goes to Python, and rows come back with how often each is
    made: a place's size is that of its alleles, however many records it has.
    """
    none = F.array().cast("array<string>")
    alts = F.array_sort(F.coalesce(F.transform("alts", F.upper), none))
    alleles = F.when(F.size(alts) == 0, F.array(F.concat(F.upper("ref"), F.lit(">.")))).otherwise(F.transform(alts, lambda a: F.concat(F.upper("ref"), F.lit(">"), a)))
    kinds = variant.record_types(F.col("ref"), F.coalesce("alts", none))
    if pairings:
        equal = inputs.groupBy("chrom", "pos", "ref", "alts", F.col(which).alias("which")).agg(F.count("*").alias("n"))
        counts = equal.select("chrom", "pos", F.struct(alleles.alias("alleles"), "which", kinds.alias("kinds"), "n").alias("c"))
        return _dealt(counts.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list("c")).alias("counts")), list(pairings))
    cut = inputs.select("chrom", "pos", F.col(which).alias("which"), alleles.alias("alleles"), kinds.alias("kinds"))
    again = F.row_number().over(Window.partitionBy("chrom", "pos", "which", "alleles").orderBy("kinds")) - 1
    sets = cut.withColumn("again", again).groupBy("chrom", "pos", "alleles", "again").agg(F.max("kinds").alias("kinds"), F.array_sort(F.collect_set("which")).alias("inputs"))
    members = F.transform("inputs", lambda w: F.struct(w.alias("which"), F.col("alleles").alias("alleles")))
    row = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("alleles", "again")) - 1
    return sets.select("chrom", "pos", row.alias("row"), members.alias("members"))


def _dealt(places: DataFrame, pairings: list[str]) -> DataFrame:
    """chrom, pos, row, members of (chrom, pos, counts)."""

    @F.arrow_udf("array<struct<first: int, n: int, own: array<int>>>")
    def rows(found: pa.Array) -> pa.Array:
        out, worth = [], _worth(pairings)
        # Some places at a time: Python's lists are many times the size of a batch.
        for at in range(0, len(found), 100):
            out.append(pa.array([_rows(counts, worth) for counts in _counts(found.slice(at, 100))], kind))
        return pa.chunked_array(out, kind).combine_chunks()

    kind = pa.list_(pa.struct({"first": pa.int32(), "n": pa.int32(), "own": pa.list_(pa.int32())}))
    made = places.select("chrom", "pos", "counts", F.explode(rows("counts")).alias("r"))
    members = made.selectExpr("chrom", "pos", "r.first", "r.n", "transform(r.own, i -> named_struct('which', counts[i].which, 'alleles', counts[i].alleles)) AS members")
    return members.selectExpr("chrom", "pos", "explode(sequence(first, first + n - 1)) AS row", "members")


def _counts(found: pa.Array) -> Iterator[list[tuple[tuple, object, int | None, int]]]:
    """What ``likes`` takes, for each place."""
    flat = found.flatten()
    columns = [flat.field(n) for n in ("alleles", "which", "kinds", "n")]
    every = [(tuple(a), w, k, n) for a, w, k, n in zip(*(c.to_pylist() for c in columns), strict=True)]
    ends = list(accumulate(found.value_lengths().to_pylist(), initial=0))
    return (every[a:b] for a, b in pairwise(ends))


def _rows(counts: list[tuple[tuple, object, int | None, int]], worth: Callable[[frozenset[str], frozenset[str]], int]) -> list[dict]:
    place, sources = likes(counts)
    out, first = [], 0
    for n, own in deal(place, worth):
        out.append({"first": first, "n": n, "own": [i for k in own for i in sources[k]]})
        first += n
    return out


def _kinds(code: int | None) -> frozenset[str]:
    """Nothing suits records of unknown kind."""
    if code is None:
        return frozenset()
    bits = (("snp", variant.SNP | variant.MNP), ("indel", variant.INDEL), ("other", variant.OTHER))
    return frozenset(name for name, bit in bits if code & bit) or frozenset(["ref"] if code == 0 else [])
