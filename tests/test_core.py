"""The core library: filter language, intervals, and every catalogue query against its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.functions import variant
from helixframe.functions.filters import FilterError, Value, compile_filter, java_pattern
from helixframe.operators import intervals
from helixframe.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("null" if row[i] is None else str(row[i]) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, found.fetchall())
    else:
        assert got


TRUTH = [
    ("1", True), ("!7", False), ("!0", True), ("!!7", True), ("2+-3 == -1", True), ("(1+2)*3 == 9", True), ("16==0x10", True), ("4*(2<3)+4 == 8", True), ("(1<2) == (3>2)", True), ("2 && 0", False), ("2 || 0", True),
    ("1 || 0 && 0", False), ("6 & 3 == 2", True), ("5 | 2 ^ 2 == 5", True), ('"abc" =~ "^a.c$"', True), ('"abc" !~ "z"', True), ('"a" == 1', False), ('"a" != 1', True), ('""', True), ('!""', False), ("~0 == -1", True), ("7 % 4 == 3", True),
    ('length("abcd") == 4', True), ('max("AB") == 66', True), ('avg("AC") == 66', True), ("none", False), ('none =~ "x"', False), ('none !~ "x"', False), ('none != "x"', True), ("!none", True),
]


def test_filter_truth(spark):
    names = {"none": Value(text=F.lit(None).cast("string"))}
    row = spark.range(1).select(*(compile_filter(text, names).alias(f"c{i}") for i, (text, _) in enumerate(TRUTH))).first()
    wrong = [text for i, (text, truth) in enumerate(TRUTH) if row[i] != truth]
    assert not wrong


def test_bracket_expressions():
    assert java_pattern("A.*[[:alpha:]]A") == r"A.*[\p{Alpha}]A"
    assert java_pattern("[:alpha:]A") == "[:alpha:]A"
    assert java_pattern("[^]a[:digit:]&&]") == r"[^\]a\d\&\&]"


ALLELES = [("A", "G", 1, 1), ("A", "a", 1, 1), ("A", ".", 0, 0), ("A", "X", 0, 0), ("A", "*", 32, 0), ("A", "<X>", 0, 0), ("A", "<NON_REF>", 0, 0), ("A", "<DEL>", 8, None), ("A", "AT", 4, 1), ("ACT", "A", 4, -2), ("A", "GAT", 8, 2), ("AC", "GTA", 8, 3), ("AC", "GT", 2, 2), ("ACG", "ATG", 1, 1), ("AA", "A", 4, -1), ("CAT", "T", 4, -2), ("A", "A[2:7[", 16, None), ("ACGT", "TA", 8, -4)]


def test_variant_types(spark):
    rows = spark.createDataFrame([(r, a) for r, a, *_ in ALLELES], "ref string, alt string")
    got = rows.select("ref", "alt", variant.variant_type(F.col("ref"), F.col("alt")).alias("k"), variant.variant_length(F.col("ref"), F.col("alt")).alias("n")).collect()
    assert [tuple(r) for r in got] == ALLELES


def test_filter_errors(spark):
    for text in ("1 +", '"a" + 1', '1 =~ "x"', "nosuch", "(1"):
        with pytest.raises(FilterError):
            compile_filter(text, {})


def test_overlap_matches_brute_force(spark):
    rng = random.Random(7)

    def some(n, length):
        return [(f"c{rng.randint(1, 2)}", b, b + rng.randint(1, length)) for b in (rng.randint(0, 200_000) for _ in range(n))]

    left, right = some(150, 40_000), some(60, 30_000)
    a, b = spark.createDataFrame(left, "chrom string, beg long, end long"), spark.createDataFrame(right, "chrom string, beg long, end long")
    hit = [(x, y) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    got = [((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in intervals.overlap_join(a, b).collect()]
    assert sorted(got) == sorted(hit)
    semi = intervals.overlap_join(a, b, "left_semi").count()
    assert semi == len([x for x in left if any(x == h for h, _ in hit)])
    assert semi + intervals.overlap_join(a, b, "left_anti").count() == len(left)


def test_regions():
    assert intervals.parse_region("chr2:1,000-2k") == ("chr2", 999, 2000)
    assert intervals.parse_region("{a:b}:5-9") == ("a:b", 4, 9)
    assert intervals.parse_region("x:-10") == ("x", 0, 10)
    assert intervals.parse_region("HLA:A*01") == ("HLA:A*01", 0, 1 << 62)
    assert intervals.parse_region(".") is None
    assert intervals.parse_decimal("1.5e3") == 1500
