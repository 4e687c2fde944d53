"""Edits of fields, typed values, and qualities from alignments on hand-made and random cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import confidence, edits


def test_field_edits(spark):
    one = spark.range(1)
    tags, none = F.array(F.lit("NM:i:1"), F.lit("MD:Z:a:b")), F.lit(None).cast("array<string>")
    filters = F.array(F.lit("q10"), F.lit("s50"))
    row = one.select(
        edits.update_tag(tags, "NM", "i", F.lit(7)), edits.update_tag(tags, "XX", "A", F.lit("c")), edits.update_tag(none, "XX", "i", F.lit(1)), edits.update_tag(tags, "NM", "i", F.lit(None)), edits.tag_value(tags, "MD"), edits.tag_value(tags, "ZZ"), edits.delete_tag(tags, "NM"),
        edits.add_filter(none, "PASS"), edits.add_filter(filters, "PASS"), edits.add_filter(filters, "s50"), edits.remove_filter(F.array(F.lit("x")), "x", True), edits.remove_filter(F.array(F.lit("x")), "x"), edits.has_filter(none, "."), edits.has_filter(none, "q10"), edits.has_filter(filters, "PASS"),
        edits.add_id(F.lit("rs12;rs3"), F.lit("rs1")), edits.add_id(F.lit("rs12;rs1"), F.lit("rs1")), edits.add_id(F.lit("."), F.lit("a")),
    ).first()
    assert tuple(row) == (
        ["NM:i:7", "MD:Z:a:b"], ["NM:i:1", "MD:Z:a:b", "XX:A:c"], ["XX:i:1"], ["NM:i:1", "MD:Z:a:b"], "a:b", None, ["MD:Z:a:b"],
        ["PASS"], ["PASS"], ["q10", "s50"], ["PASS"], [], True, False, False, "rs12;rs3;rs1", "rs12;rs1", "a",
    )
    for bad in (edits.append_tag(tags, "NM", "i", F.lit(1)), edits.set_qname(F.lit("x" * 255))):
        with pytest.raises(Exception, match="there already|254"):
            one.select(bad).collect()


def test_samples():
    names = ["a", "b", "c"]
    assert edits.samples(names, "c,a") == ["a", "c"] and edits.samples(names, "^b") == ["a", "c"] and edits.samples(names, "-") == names and edits.samples(names, "") == []
    with pytest.raises(ValueError):
        edits.samples(names, "a,x")


def test_numbers(spark):
    cases = [("12", 12, False), ("+7", 7, False), ("-129", -128, True), ("127", 127, False), ("0000000000000000000000000000000000000000128", 127, True), ("9" * 60, 127, True), ("-" + "9" * 60, -128, True), ("1x", None, None), ("", None, None), (None, None, None)]
    got = [x.v for x in spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string").orderBy("i").select(edits.parse_int(F.col("t"), 8).alias("v")).collect()]
    assert [(None, None) if v is None else (int(v.value), v.overflow) for v in got] == [c[1:] for c in cases]


def test_mapq_caps():
    ref = "ACGT" * 10
    assert confidence.capped_mapq(0, "40M", ref, "I" * 40, ref) == 40
    assert confidence.capped_mapq(0, "20M", "T" * 20, "I" * 20, ref) == -1
    assert confidence.capped_mapq(38, "4M", "GTAA", "IIII", ref) == 40  # what lies beyond the reference isn't looked at
    assert confidence.capped_mapq(0, "4M", "TTTT", "!!!!", ref) == 40  # no letter is sure
    assert confidence.capped_mapq(0, "4M4S", "ACGTAAAA", "I" * 8, ref) < 40


def test_mates_settle():
    rng = random.Random(8)
    for _ in range(100):
        mates = []
        for _ in range(2):
            ops = [(rng.randint(1, 5), rng.choice("MMMIDNSH=X")) for _ in range(4)]
            n = sum(k for k, op in ops if op in "MIS=X")
            mates.append((rng.randint(0, 6), "".join(f"{k}{op}" for k, op in ops), "".join(rng.choice("AC") for _ in range(n)), np.array([rng.randint(0, 150) for _ in range(n)], int)))
        a, b = sorted(mates, key=lambda m: m[0])
        name = f"q{rng.randint(0, 99)}"
        first, second = a[3].tolist(), b[3].tolist()
        at = dict(zip(*map(list, confidence.matched(b[0], b[1])), strict=True))
        for place, i in zip(*map(list, confidence.matched(a[0], a[1])), strict=True):
            if place not in at:
                continue
            j = at[place]
            if a[2][i] == b[2][j]:
                total = min(200, first[i] + second[j])
                first[i], second[j] = (total, 0) if confidence.keeps_first(name) else (0, total)
            elif first[i] > second[j] or (first[i] == second[j] and confidence.keeps_first(name)):
                first[i], second[j] = int(first[i] * 0.8), 0
            else:
                first[i], second[j] = 0, int(second[j] * 0.8)
        got = confidence.settled(name, a, b)
        assert (got[0].tolist(), got[1].tolist()) == (first, second)
    assert len({confidence.keeps_first(f"n{i}") for i in range(20)}) == 2
