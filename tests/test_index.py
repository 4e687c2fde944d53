"""Position indexes and sequence fetches against scans of everything."""

import random

import pytest

from helixframe.sources import bam, bgzf, faidx, index


def bam_bytes(rows, references):
    # Small members, so that an index has something to skip.
    data = bam.header_block("", references) + b"".join(map(bam.encode, rows))
    return b"".join(bgzf.compress(data[i : i + 400], end=False) for i in range(0, len(data), 400)) + bgzf.EOF


def sample(rng, count):
    rows = []
    for _ in range(count):
        n = rng.choice([1, 20, 90])
        tid = rng.choice([0, 1, 1, 3, None])
        skip = rng.choice(["", "", f"{rng.randint(1, 90_000)}N"])
        cigar = f"{n}M" if not skip or n == 1 else f"1M{skip}{n - 1}M"
        rows.append(dict(qname=f"q{rng.randint(0, 9)}", flag=rng.choice([0, 16, 4]), tid=tid, pos=None if tid is None else rng.randint(0, 300_000), mapq=3, cigar=cigar, mtid=None, mpos=None, tlen=0, seq="A" * n, qual=None, tags=[]))
    return sorted(rows, key=lambda r: (r["tid"] is None, r["tid"] or 0, r["pos"] or 0))


@pytest.mark.parametrize("kind", ["bai", "csi", "tbi"])
def test_region_reads_match_scans(kind):
    rng = random.Random(2)
    content = bam_bytes(sample(rng, 500), [(f"s{i}", 1 << 20) for i in range(4)])
    made = index.bam_index(content)
    if kind == "tbi":
        made.aux = bytes(24) + b"\0\0\0\0"
    loaded = index.load(index.dump(made, kind))
    every = [bam.encode(r)[4:] for r in bam.records(bgzf.decompress(content))]
    assert loaded.unplaced == sum(bam.place(b)[0] < 0 for b in every)
    assert [(r.mapped, r.unmapped) for r in loaded.references] == [(sum(bam.place(b)[0] == i and not bam.place(b)[3] & 4 for b in every), sum(bam.place(b)[0] == i and bam.place(b)[3] & 4 > 0 for b in every)) for i in range(4)]
    for _ in range(60):
        number, beg = rng.randint(0, 3), rng.randint(0, 310_000)
        end = beg + rng.choice([1, 50, 20_000, 200_000])
        want = [b for b in every if bam.place(b)[0] == number and bam.place(b)[1] < end and bam.place(b)[2] > beg]
        assert list(index.region_records(content, loaded, number, beg, end)) == want
    narrow = index.chunks_for(loaded, 1, 200_000, 200_001)
    assert sum(stop - start >> 16 for start, stop in narrow) < len(content) / 2


def test_index_of_odd_files():
    assert index.bam_index(bam_bytes([], [("s", 9)])).references == [index.Reference()]
    rows = sample(random.Random(4), 30)
    with pytest.raises(ValueError):
        index.bam_index(bam_bytes(rows[::-1], [(f"s{i}", 9) for i in range(4)]))
    with pytest.raises(bgzf.FormatError):
        index.load(b"nothing")
    with pytest.raises(bgzf.FormatError):
        index.load(index.dump(index.bam_index(bam_bytes(rows, [(f"s{i}", 9) for i in range(4)])))[:40])


def test_bins():
    for number in (0, 1, 8, 9, 72, 73, 4681, 37448):
        beg, end = index.bin_span(number)
        assert index.smallest_bin(beg, end) == number
        if number:
            above = index.bin_span(index.parent(number))
            assert above[0] <= beg and end <= above[1] and index.level_of(index.parent(number)) == index.level_of(number) - 1
    assert index.parent(0) == -1 and index.summary_bin(5) == 37450


def test_fasta_index_and_windows(spark):
    rng = random.Random(6)
    seqs = {f"n{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 59, 60, 61, 500]))) for i in range(12)}
    content = "".join(f">{n} c\r\n" + "".join(s[i : i + 60] + "\r\n" for i in range(0, len(s), 60)) for n, s in seqs.items()).encode()
    entries = {e[0]: e for e in faidx.index_lines(content)}
    assert {n: e[1] for n, e in entries.items()} == {n: len(s) for n, s in seqs.items()}
    spans = [(n, b, b + rng.choice([1, 70, 600])) for n in seqs for b in (-3, 0, 58, 130)] + [("none", 0, 5), ("n0", 5, 5), (None, 0, 5)]
    for n, b, e in spans[:-3]:
        assert faidx.fetch_bytes(content, entries[n], b, e) == seqs[n][max(b, 0) : max(e, 0)]
    got = faidx.fetch(spark.createDataFrame(spans, "chrom string, beg long, end long"), faidx.windows(spark.createDataFrame(list(seqs.items()), "name string, seq string"), 64), 64)
    want = [(n, b, e, seqs[n][max(b, 0) : e]) for n, b, e in spans[:-3] if e > 0 and seqs[n][max(b, 0) : e]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        faidx.index_lines(b">a\nAC\nACG\n")
