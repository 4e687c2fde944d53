"""BCF: round trips of made-up records, and files that break the rules."""

import random

import pytest

from helixframe.sources import bcf, bgzf

HEADER = "\n".join([
    "##fileformat=VCFv4.2", '##FILTER=<ID=q10,Description="a, b">', "##contig=<ID=c1>", "##contig=<ID=c2>", "##INFO=<ID=DP,Number=.,Type=Integer>", "##INFO=<ID=AF,Number=.,Type=Float>", "##INFO=<ID=DB,Number=0,Type=Flag>", "##INFO=<ID=TX,Number=1,Type=String>",
    "##FORMAT=<ID=GT,Number=1,Type=String>", "##FORMAT=<ID=AD,Number=.,Type=Integer>", "##FORMAT=<ID=DP,Number=1,Type=Integer>", "##FORMAT=<ID=GL,Number=.,Type=Float>", "##FORMAT=<ID=FT,Number=1,Type=String>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
])
PLAIN = dict(chrom="c1", pos=4, id=None, ref="A", alts=None, qual=None, filters=None, info=None, format=None, samples=[[], []])


def sample(rng):
    pick = lambda *x: rng.choice(x)
    info = {"DP": pick("1", "-119", "-120,.", "40000", "2147483647,-2147483640"), "AF": pick("0.5,.", "2", "."), "DB": None, "TX": pick("x", "y" * 300)}
    keys = rng.sample(["GT", "AD", "DP", "GL", "FT"], rng.randint(1, 5))
    values = {"GT": ["0/1", "./.", "1|0", "2", ".|70"], "AD": ["1,2", ".", "300,4,5", "7"], "DP": ["1", "."], "GL": ["-1.5", ".,0.25", "."], "FT": ["PASS", ".", "a;b"]}
    return dict(chrom=pick("c1", "c2"), pos=rng.randint(0, 1 << 30), id=pick(None, "rs1"), ref=pick("A", "ACGT" * 9), alts=pick(None, ["C"], ["C", "<DEL>"]), qual=pick(None, 7.5), filters=pick(None, ["PASS"], ["q10"]), info={k: v for k, v in info.items() if rng.random() < 0.6} or None, format=keys, samples=[[rng.choice(values[k]) for k in keys] for _ in range(2)])


def test_records_round_trip(spark, tmp_path):
    rng = random.Random(9)
    made = [sample(rng) for _ in range(300)] + [PLAIN]
    header = bcf.Header(HEADER)
    data = header.block() + b"".join(bcf.encode(r, header) for r in made)
    assert list(bcf.records(data)) == made
    df = spark.createDataFrame([tuple(r[c] for c in bcf.COLUMNS) for r in made], bcf.SCHEMA)
    bcf.write_bcf(df, str(tmp_path / "b"), HEADER)
    got = bcf.read_bcf(spark.read.parquet(str(tmp_path / "b")))
    assert got.schema == df.schema or got.columns == df.columns
    assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(map(str, (r.asDict() for r in df.collect())))


def test_equal_parts_are_made_once(monkeypatch):
    """Records that differ by their place alone are decoded once, and stay right."""
    header = bcf.Header(HEADER)
    made = [{**PLAIN, "pos": i, "chrom": f"c{1 + i % 2}", "format": ["GT"], "samples": [["0/1"], ["1|0"]]} for i in range(500)]
    data = header.block() + b"".join(bcf.encode(r, header) for r in made)
    seen, rest = [], bcf._made_rest
    monkeypatch.setattr(bcf, "_made_rest", lambda *x: seen.append(1) or rest(*x))
    assert list(bcf.records(data)) == made and len(seen) == 1


def test_broken_files_are_refused():
    header = bcf.Header(HEADER)
    good = header.block() + bcf.encode(sample(random.Random(1)), header)
    for bad in (b"VCF" + good, good[:-1], good + b"\1", good[: len(header.block()) + 8] + b"\x09" + good[len(header.block()) + 9 :]):
        with pytest.raises(bgzf.FormatError):
            list(bcf.records(bad))
    for wrong in ({"chrom": "c9"}, {"filters": ["z"]}, {"info": {"ZZ": "1"}}, {"format": ["GT"], "samples": [["0"]]}):
        with pytest.raises(bgzf.FormatError):
            bcf.encode({**PLAIN, **wrong}, header)
