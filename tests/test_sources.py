"""Formats, headers and their errors on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.headers import HeaderError, SamHeader, VcfHeader, merged
from helixframe.sources import bam, bgzf, text

RECORD = {"qname": "q1", "flag": 99, "tid": 0, "pos": 7, "mapq": 60, "cigar": "3M1I2M", "mtid": 0, "mpos": 30, "tlen": 40, "seq": "ACGTNA", "qual": "!!I#JK", "tags": ["NM:i:3", "XA:A:c", "XZ:Z:a b", "XB:B:s,-1,300", "XF:f:1.5"]}


def test_blocks():
    rng = random.Random(1)
    content = bytes(rng.choices(b"ACGT\n", k=200_000)) + rng.randbytes(70_000)
    made = bgzf.compress(content)
    assert bgzf.decompress(made) == content and bgzf.ends_well(made) and bgzf.decompress(bgzf.compress(b"")) == b""
    at = [a for a, _ in bgzf.members(made)]
    assert len(at) > 4 and bgzf.read_at(made, at[1] << 16 | 5, 100_000) == content[bgzf.BLOCK + 5 :][:100_000]
    broken = bytearray(made)
    broken[at[1] - 6] ^= 1
    for bad in (bytes(broken), made[:-40], b"plain text that is long enough"):
        with pytest.raises(bgzf.FormatError):
            bgzf.decompress(bad)


def test_records():
    empty = dict.fromkeys(RECORD) | {"flag": 4, "mapq": 0, "tlen": 0, "tags": []}
    long = RECORD | {"cigar": "1M1I" * 40_000, "seq": "A" * 80_000, "qual": None}
    for record in (RECORD, empty, long):
        assert bam.decode(bam.encode(record)[4:]) == record
    head = bam.header_block("@HD\tVN:1.6\n", [("s1", 100)])
    assert bam.read_header(head)[:2] == ("@HD\tVN:1.6\n", [("s1", 100)])
    assert list(bam.records(head + bam.encode(RECORD))) == [RECORD]
    for bad in (head + bam.encode(RECORD)[:-3], head + bam.encode(RECORD | {"tid": 5}), b"SAM?"):
        with pytest.raises(bgzf.FormatError):
            list(bam.records(bad))


def test_bam_is_inflated_and_compressed_by_blocks(monkeypatch):
    """Of a file of many blocks few are inflated before the first record comes, and a writer holds less than two uncompressed."""
    head = bam.header_block("@HD\tVN:1.6\n", [("s1", 100)])
    body, count = bam.encode(RECORD), 20_000
    packer, most = bgzf.Packer(), 0
    packer.add(head)
    for _ in range(count):
        packer.add(body)
        most = max(most, sum(map(len, packer._held)))
    raw = packer.finish()
    assert most < 2 * bgzf.BLOCK and bgzf.decompress(raw) == head + body * count == bgzf.decompress(bgzf.compress(head + body * count))
    seen, inflate = [], bgzf.inflate
    monkeypatch.setattr(bgzf, "inflate", lambda m: seen.append(1) or inflate(m))
    found = bam.records(bgzf.Content(raw))
    assert next(found) == RECORD and len(seen) == 1
    assert sum(r == RECORD for r in found) == count - 1 and len(seen) == len(list(bgzf.members(raw)))
    for bad in (head[:-6], head[:10], head + body[:2]):
        with pytest.raises(bgzf.FormatError):
            list(bam.records(bad))


def test_bam_files(spark, tmp_path):
    df = spark.createDataFrame([tuple(RECORD[c] for c in bam.COLUMNS)] * 5, bam.SCHEMA).repartition(2)
    bam.write_bam(df, f"{tmp_path}/b", [("s1", 100)])
    files = spark.read.parquet(f"{tmp_path}/b")
    assert [r.asDict() for r in bam.read_bam(files).collect()] == [RECORD] * 5
    assert bam.block_counts(files).agg(F.sum("blocks")).first()[0] >= 2
    assert files.agg(F.sum("records")).first()[0] == 5


def test_sam_header():
    header = SamHeader("@HD\tVN:1.6\tSO:unsorted\n@SQ\tSN:s1\tLN:10\tAN:one,uno\n@SQ\tSN:s2\tLN:20\n@RG\tID:x1\n@PG\tID:a\n@PG\tID:b\tPP:a\n@CO\tfree\ttext\n")
    assert SamHeader(str(header)).lines == header.lines
    assert header.count("SQ") == 2 and header.index("SQ", "s2") == 1 and header.name("SQ", 0) == "s1"
    assert header.find("SQ", "uno").tags["SN"] == "s1" and header.find("SQ", LN="20").tags["SN"] == "s2"
    assert header.chain_ends() == ["b"] and header.add_program("a", VN="2") == ["a.1"]
    assert header.find("PG", "a.1").tags == {"ID": "a.1", "PN": "a", "PP": "b", "VN": "2"}
    header.set_order("coordinate")
    assert str(header).startswith("@HD\tVN:1.6\tSO:coordinate\n")
    header.update("SQ", "s2", SN="s3", M5="x")
    assert header.remove_except("SQ", {"s3"}) == 1 and header.remove("RG", "x1") and not header.remove("RG", "x1")
    for bad in (lambda: header.add("@SQ\tSN:s3\tLN:1"), lambda: header.add("@SQ\tLN:1"), lambda: header.add("SQ"), lambda: header.update("RG", "no", LB="x")):
        with pytest.raises(HeaderError):
            bad()
    both, places = merged(SamHeader("@SQ\tSN:a\tLN:1\n@SQ\tSN:b\tLN:1\n"), SamHeader("@SQ\tSN:c\tLN:1\n@SQ\tSN:a\tLN:1\n"))
    assert both.count("SQ") == 3 and places == [2, 0]


def test_vcf_header():
    header = VcfHeader('##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="a, b">\n##contig=<ID=s1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n')
    assert header.version == "VCFv4.2" and header.samples == ["A", "B"] and header.find("INFO", "DP")["Description"] == '"a, b"'
    assert not header.add("contig", {"ID": "s1"}) and header.add("contig", {"ID": "s2"}) and header.remove("INFO", "DP")
    assert VcfHeader(str(header)).meta == header.meta


def test_text_formats(spark, tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content)
        return str(tmp_path / name)

    fastq = put("x.fq", "@r1 c d\nACG\n+\n@II\n@r2\n\n+\n\n@r3\nA\n+r3\n+\n")
    assert sorted(tuple(r) for r in text.read_fastq(spark, fastq).collect()) == [("r1", "c d", "ACG", "@II"), ("r2", None, "", ""), ("r3", None, "A", "+")]
    fasta = put("x.fa", ">s1 one\nACG\nTT\n\n>s2\nA\r\nC\n")
    assert sorted(tuple(r) for r in text.read_fasta(spark, fasta).collect()) == [("s1", "one", "ACGTT"), ("s2", None, "AC")]
    vcf = put("x.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\nc\t5\t.\tA\tG,T\t.\tPASS\tDP=3;DB\tGT:DP\t0/1:2\t.\n")
    row = text.read_vcf(spark, vcf).first()
    assert (row["pos"], row["id"], row["alts"], row["qual"], row["filters"], row["info"], row["samples"]) == (4, None, ["G", "T"], None, ["PASS"], {"DP": "3", "DB": None}, [["0/1", "2"], ["."]])
    gff = put("x.gff", "#c\nchr\tsrc\tgene\t10\t20\t.\n")
    assert tuple(text.read_intervals(spark, gff, "gff").first())[:3] == ("chr", 9, 20)
    sam = put("x.sam", "@HD\tVN:1.6\n@CO\tx\ty\nq\t0\ts1\t5\t9\t3M\t=\t8\t0\tACG\t*\tNM:i:1\tXZ:Z:a:b\nu\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    first, second = sorted(text.read_sam(spark, sam).collect(), key=lambda r: r["qname"])
    assert (first["pos"], first["mrname"], first["tags"]["XZ"]["value"], second["rname"], second["tags"]) == (4, "s1", "a:b", None, {})
    assert sorted((r["kind"], r["fields"]) for r in text.read_sam_header(spark, sam).collect()) == [("CO", {"CO": "x\ty"}), ("HD", {"VN": "1.6"})]
    heads = {"vcf": b"##fileformat=VCFv4.2\n", "sam": b"@HD\tVN:1.6\n", "fastq": b"@r1\nAC", "fasta": b">x\n", "bed": b"c\t1\t5\n", "bam": b"BAM\1", "gzip": b"\x1f\x8b\x08", "text": b"hello\n", "binary": b"\0\1"}
    assert {name: text.sniff(head) for name, head in heads.items()} == {name: name for name in heads}
