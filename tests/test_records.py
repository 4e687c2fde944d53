"""Pileups, shared rows, regions, modifications and statistics against plain loops and hand-made cases."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import basemods, stats
from helixframe.operators import intervals, pileup, synced


def walk(pos, cigar, seq):
    """(ref_pos, qpos, is_del, indel) of a read, operation by operation."""
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    q, r, out = 0, pos, []
    for k, (n, op) in enumerate(ops):
        if op in "MDN=X":
            for i in range(n):
                out.append([r + i, q + (0 if op in "DN" else i), op in "DN", 0])
            rest = ops[k + 1 :]
            if n and rest and rest[0][1] == "D" and op != "D":
                for m, o in rest:
                    if o != "D":
                        break
                    out[-1][3] -= m
            elif n and rest and rest[0][1] in "IP":
                stop = "MDN=XSH" if rest[0][1] == "I" else "MDN=X"
                for m, o in rest:
                    if o in stop:
                        break
                    out[-1][3] += m if o == "I" else 0
            r += n
        if op in "MIS=X" and op not in "DN":
            q += n
    return [tuple(x) for x in out]


def test_aligned_bases_follow_any_cigar(spark):
    rng = random.Random(3)
    reads = []
    for i in range(60):
        ops = [(rng.randint(1, 4), rng.choice("MMMIDNSHP=X")) for _ in range(rng.randint(1, 7))]
        length = sum(n for n, op in ops if op in "MIS=X")
        reads.append((i, "c", rng.randint(0, 50), "".join(f"{n}{op}" for n, op in ops), "".join(rng.choice("ACGT") for _ in range(length))))
    reads += [(100, None, 1, "3M", "ACG"), (101, "c", 1, None, None), (102, "c", 1, "*", "A"), (103, "c", 5, "0M2M", "AC")]
    df = spark.createDataFrame(reads, "id int, chrom string, pos long, cigar string, seq string")
    got = {}
    for x in pileup.aligned_bases(df).collect():
        got.setdefault(x.id, []).append((x.ref_pos, x.qpos, x.is_del, x.indel))
        assert x.base == (None if x.is_del else x.seq[x.qpos])
        if x.indel > 0 and "P" not in x.cigar and "S" not in x.cigar:
            first = x.qpos + (0 if x.is_del else 1)
            assert x.inserted == x.seq[first : first + x.indel]
    for i, chrom, pos, cigar, seq in reads:
        assert sorted(got.get(i, [])) == (sorted(walk(pos, cigar, seq)) if chrom and cigar else []), cigar


def test_depth_and_islands_cross_blocks(spark):
    rng = random.Random(5)
    rows = [("a", b, b + rng.randint(0, 30)) for b in (rng.randint(0, 400) for _ in range(40))] + [(None, 1, 5), ("b", 0, 3_000_000), ("b", 3_000_000, 3_000_001)]
    df = spark.createDataFrame(rows, "chrom string, beg long, end long")
    covered = np.zeros(500, int)
    for c, b, e in rows:
        if c == "a":
            covered[b:e] += 1
    found = np.zeros(500, int)
    for x in pileup.running(pileup.steps(df.filter("chrom = 'a'")), shift=4).collect():
        if x.total:
            found[x.at : x.next] = x.total
    assert (found == covered).all()
    assert {tuple(x) for x in intervals.compact(df.filter("chrom = 'b'")).collect()} == {("b", 0, 3_000_001)}
    assert {tuple(x) for x in intervals.compact(df.filter("chrom = 'b'"), touching=False).collect()} == {("b", 0, 3_000_000), ("b", 3_000_000, 3_000_001)}


def test_depth_of_positions_in_one_shuffle(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), b, b + rng.randint(0, 40)) for b in (rng.randint(0, 200) for _ in range(60))] + [(None, 1, 5), ("c", 7, 8), ("d", None, 3)]
    want = {}
    for c, b, e in rows:
        for x in range(b, e) if c and b is not None else ():
            want[c, x] = want.get((c, x), 0) + 1
    df = spark.createDataFrame(rows, "chrom string, beg long, end long")
    for shift in (2, 3, pileup.DEPTH_SHIFT):
        found = pileup.position_depth(df, shift)
        assert sorted(map(tuple, found.collect())) == sorted((c, x, n) for (c, x), n in want.items())
    plan = pileup.position_depth(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_islands_of_equal_regions(spark):
    """Regions that come several times change nothing, whatever their order."""
    rng = random.Random(2)
    rows = [(rng.choice("ab"), b, b + rng.randint(1, 6)) for b in (rng.randint(0, 300) for _ in range(60))]
    want = []
    for c, b, e in sorted(rows):
        if want and want[-1][0] == c and b <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([c, b, e])
    df = spark.createDataFrame(rng.sample(rows * 5, 300), "chrom string, beg long, end long")
    assert sorted(map(list, intervals.compact(df).collect())) == want


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_semi_and_anti_overlaps(spark, how):
    rng = random.Random(7)
    left = [(rng.choice("ab"), b, b + rng.choice([0, 1, 5, 40])) for b in (rng.randint(0, 200) for _ in range(80))] + [(None, 1, 3), ("a", 5, 5)]
    right = [(rng.choice("ab"), b, b + rng.choice([0, 3, 9])) for b in (rng.randint(0, 200) for _ in range(12))]
    schema = "chrom string, beg long, end long"
    got = sorted(map(tuple, intervals.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), how, shift=3).collect()), key=str)
    hit = lambda x: any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2] for y in right)
    assert got == sorted((x for x in left if hit(x) == (how == "left_semi")), key=str)


def test_overlap_modes(spark):
    records = spark.createDataFrame([("c", 10, "A", ["AT"]), ("c", 10, "TA", ["T"]), ("c", 10, "ACG", ["A", "GCG"]), ("c", 10, "A", None)], "chrom string, pos long, ref string, alts array<string>")

    def found(mode, *spans, exclude=False):
        regions = spark.createDataFrame([("c", b, e) for b, e in spans], "chrom string, beg long, end long")
        return sorted(((x.ref, x.alts) for x in synced.in_regions(records, regions, mode, exclude).collect()), key=str)

    every = sorted([("A", None), ("A", ["AT"]), ("ACG", ["A", "GCG"]), ("TA", ["T"])], key=str)
    assert len(found(synced.POSITION, (10, 11))) == 4 and found(synced.POSITION, (11, 13)) == []
    assert [x[0] for x in found(synced.RECORD, (11, 12))] == ["ACG", "TA"]
    assert [x[0] for x in found(synced.VARIANT, (10, 11))] == ["ACG"]  # TA>T changes the second letter alone
    assert ("A", ["AT"]) in found(synced.VARIANT, (10, 12)) and ("A", ["AT"]) not in found(synced.VARIANT, (10, 11), (11, 12))
    assert found(synced.RECORD, (50, 60), exclude=True) == every


def test_records_of_few_bins_are_spread(spark):
    """A joined task holds a share of the records, though all lie within one bin."""
    records = spark.range(20_000).selectExpr("'c' AS chrom", "id % 1000 AS pos", "'A' AS ref", "array('C') AS alts")
    regions = spark.createDataFrame([("c", 0, 500)], "chrom string, beg long, end long")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for exclude in (False, True):
            sizes = [x["count"] for x in synced.in_regions(records, regions, exclude=exclude).groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 10_000 and max(sizes) < 5_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shared_rows():
    snp, indel, ref = ({"inputs": {i}, "kinds": frozenset([kind]), "alleles": {a}} for i, kind, a in ((0, "snp", "A>C"), (1, "indel", "A>AT"), (2, "ref", "A>.")))
    other = {"inputs": {1}, "kinds": frozenset(["snp"]), "alleles": {"A>G"}}
    assert sorted(map(sorted, synced.share_rows([snp, other], ["snps"]))) == [[0, 1]]
    assert sorted(map(sorted, synced.share_rows([snp, indel], ["snps", "indels"]))) == [[0], [1]]
    assert sorted(map(sorted, synced.share_rows([snp, indel], ["any"]))) == [[0, 1]]
    assert sorted(map(sorted, synced.share_rows([snp, ref], ["snps"]))) == [[0], [1]]
    assert sorted(map(sorted, synced.share_rows([snp, ref], ["snp+ref"]))) == [[0, 1]]
    # One input has a row once, and a shared allele goes before a kind in common.
    assert sorted(map(sorted, synced.share_rows([snp, {**other, "inputs": {0}}], ["any"]))) == [[0], [1]]
    both = {"inputs": {2}, "kinds": frozenset(["snp"]), "alleles": {"A>G", "A>T"}}
    assert [0, 2] in map(sorted, synced.share_rows([other, {**snp, "inputs": {2}}, both], ["snps"]))


def test_paired_keeps_every_record(spark):
    rows = [("c", 1, "A", ["C"], 0), ("c", 1, "A", ["c"], 1), ("c", 1, "A", ["G"], 2), ("c", 1, "A", ["C"], 0), ("c", 2, "A", None, 1), ("d", 1, "A", ["AT"], 0)]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, f int")
    for pairings in ([], ["snps", "indels"], ["any"]):
        out = synced.paired(df, "f", pairings).collect()
        assert sum(len(x.members) for x in out) == len(rows)
        assert all(len({m.which for m in x.members}) == len(x.members) for x in out)
        assert len([x for x in out if (x.chrom, x.pos) == ("c", 1)]) == (3 if not pairings else 2)


def one_by_one(records, worth):
    """Rows by taking in one record after the other."""
    def score(a, b):
        pairs = [(records[i], records[j]) for i in a for j in b]
        if any(x["kinds"] & y["kinds"] and x["alleles"] & y["alleles"] for x, y in pairs):
            return 4, 0
        return min(worth(x["kinds"], y["kinds"]) for x, y in pairs), sum(len(records[i]["inputs"]) for i in a + b)

    rows, done = [[i] for i in range(len(records))], []
    while rows:
        inputs = [set().union(*(records[i]["inputs"] for i in row)) for row in rows]
        top = max(range(len(rows)), key=lambda k: (len(inputs[k]), -k))
        (worst, _), place = max((score(rows[top], row) if k != top and not inputs[top] & inputs[k] else (0, 0), -k) for k, row in enumerate(rows))
        if worst == 0:
            done.append(rows.pop(top))
            continue
        low, high = sorted((top, -place))
        rows[low] = rows[low] + rows.pop(high)
    return sorted(map(sorted, done))


def test_rows_by_sorts_of_records():
    rng = random.Random(3)
    for _ in range(400):
        pairings, stacks = rng.sample(list(synced._WORTH), 2), {}
        for _ in range(rng.randint(1, 9)):
            stacks.setdefault(rng.choice("abcd"), {}).setdefault(rng.randint(0, 3), []).extend([rng.choice([0, 1, 4, 8, 9])] * rng.randint(1, 4))
        counts = [((a,), w, k, kinds.count(k)) for a in sorted(stacks) for w, kinds in sorted(stacks[a].items()) for k in sorted(set(kinds))]
        levels = []
        for a in sorted(stacks):
            for i in range(max(map(len, stacks[a].values()))):
                here = {w: sorted(kinds)[i] for w, kinds in stacks[a].items() if len(kinds) > i}
                levels.append({"inputs": set(here), "kinds": synced._kinds(max(here.values())), "alleles": {a}})
        worth, got = synced._worth(pairings), []
        for row in synced._rows(counts, worth):
            assert row["first"] == len(got)
            got += [sorted((counts[i][1], counts[i][0][0]) for i in row["own"])] * row["n"]
        assert got == [sorted((w, *levels[i]["alleles"]) for i in row for w in levels[i]["inputs"]) for row in one_by_one(levels, worth)]


def test_many_records_of_one_place(spark):
    """The work is that of the alleles; it grew with the square of the records."""
    n = 50_000
    rows = spark.range(2 * n).selectExpr("'c' AS chrom", "1L AS pos", "'A' AS ref", "array(IF(id % 2 = 0, 'C', 'G')) AS alts", "CAST(id % 2 AS INT) AS f")
    out = synced.paired(rows, "f", ["snps"])
    assert [tuple(x) for x in out.selectExpr("count(*)", "min(row)", "max(row)", "count(DISTINCT row)", "min(size(members))").collect()] == [(n, 0, n - 1, n, 2)]
    assert out.first().members == [(0, ["A>C"]), (1, ["A>G"])]


def test_base_modifications():
    assert basemods.decode_mods("ACGCC", False, "C+m,1,0;", [7, 9]) == [(3, "C", "+", "m", 7), (4, "C", "+", "m", 9)]
    assert basemods.decode_mods("GGAG", True, "C+mh?,0,1", [1, 2, 3, 4]) == [(0, "C", "+", "h", 4), (0, "C", "+", "m", 3), (3, "C", "+", "h", 2), (3, "C", "+", "m", 1)]
    assert basemods.decode_mods("ACA", False, "N+76792,2;A-a.,1;C+m;", None) == [(2, "A", "-", "a", -1), (2, "N", "+", "76792", -1)]
    assert basemods.decode_mods("A", False, None, None) is None and basemods.decode_mods(None, False, "", None) == []
    for seq, mm, ml in (("ACA", "C+m,1;", [1]), ("ACA", "C+m,0;", []), ("ACA", "C+m,0;", [1, 2]), ("ACA", "C*m,0;", [1])):
        with pytest.raises(ValueError):
            basemods.decode_mods(seq, False, mm, ml)


def test_fisher_against_exact_fractions():
    rng = random.Random(11)
    logs = stats._log_factorials(200)
    for _ in range(200):
        a, b, c, d = (rng.randint(0, 12) for _ in range(4))
        r, s, n = a + b, a + c, a + b + c + d
        chance = {x: Fraction(math.comb(r, x) * math.comb(n - r, s - x), math.comb(n, s)) for x in range(max(0, r + s - n), min(r, s) + 1)}
        want = [chance[a], sum(p for x, p in chance.items() if x <= a), sum(p for x, p in chance.items() if x >= a), sum(p for p in chance.values() if p <= chance[a])]
        assert np.allclose(stats.fisher_exact(a, b, c, d, logs), [float(x) for x in want], atol=1e-10)


def test_special_functions():
    for x in (0.1, 0.9, 1.0, 3.0, 25.0):
        assert math.isclose(stats.gamma_p(1, x), 1 - math.exp(-x), rel_tol=1e-12)
        assert math.isclose(stats.gamma_q(0.5, x), math.erfc(math.sqrt(x)), rel_tol=1e-9)
    for x in (0.05, 0.3, 0.5, 0.8, 0.99):
        for a, b in ((1, 1), (2, 5), (7, 3)):
            want = sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))
            assert math.isclose(stats.beta_i(a, b, x), want, rel_tol=1e-10)
    assert stats.gamma_p(2, 0) == 0 and stats.beta_i(2, 3, 0) == 0 and stats.beta_i(2, 3, 1) == 1
