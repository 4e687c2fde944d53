"""Alignment records in BAM: a sink that writes one file a partition, and a scan of such files.

Every part is a whole file with header and end block, so parts are read in
parallel and a lost task is written again.  Positions are 0-based; tags are
``XX:T:value`` texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bgzf
from .bgzf import FormatError

#: Fixed values of the format: letters of packed bases and of CIGAR operations, sizes of tag numbers, fixed fields.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
FIXED = struct.Struct("<iiBBHHHiiii")
SCHEMA = "qname string, flag int, tid int, pos long, mapq int, cigar string, mtid int, mpos long, tlen long, seq string, qual string, tags array<string>"
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
_CODE = {c: i for i, c in enumerate(BASES)}
#: A CIGAR of more operations doesn't fit the record's field and goes into a tag.
MOST_OPS = 65_535


def header_block(text: str, references: list[tuple[str, int]]) -> bytes:
    out = [b"BAM\1", struct.pack("<i", len(text.encode())), text.encode(), struct.pack("<i", len(references))]
    for name, length in references:
        raw = name.encode() + b"\0"
        out += [struct.pack("<i", len(raw)), raw, struct.pack("<i", length)]
    return b"".join(out)


def read_header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, references, place of the first record)."""
    if data[:4] != b"BAM\1":
        raise FormatError("not BAM")
    size = int.from_bytes(data[4:8], "little")
    text, at = data[8 : 8 + size].rstrip(b"\0").decode(), 8 + size
    count, at = int.from_bytes(data[at : at + 4], "little"), at + 4
    references = []
    for _ in range(count):
        n = int.from_bytes(data[at : at + 4], "little")
        references.append((data[at + 4 : at + 3 + n].decode(), int.from_bytes(data[at + 4 + n : at + 8 + n], "little")))
        at += 8 + n
    return text, references, at


def bin_of(beg: int, end: int) -> int:
    """Smallest index bin that holds [beg, end)."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == (end - 1) >> shift:
            return first + (beg >> shift)
    return 0


def pack_tag(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    if kind == "B":
        numbers = value.split(",")
        code = NUMBERS[numbers[0]]
        made = [float(x) if code == "f" else int(x) for x in numbers[1:]]
        return name.encode() + b"B" + numbers[0].encode() + struct.pack(f"<i{len(made)}{code}", len(made), *made)
    if kind in NUMBERS:
        return name.encode() + kind.encode() + struct.pack("<" + NUMBERS[kind], float(value) if kind == "f" else int(value))
    return name.encode() + kind.encode() + value.encode() + (b"" if kind == "A" else b"\0")


def unpack_tags(data: bytes) -> list[str]:
    """Integer tags of any width are shown as ``i``."""
    out, at = [], 0
    while at < len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in NUMBERS:
            size = struct.calcsize(NUMBERS[kind])
            out.append(f"{name}:{'f' if kind == 'f' else 'i'}:{_number(struct.unpack_from('<' + NUMBERS[kind], data, at)[0])}")
            at += size
        elif kind == "A":
            out.append(f"{name}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            stop = data.index(0, at)
            out.append(f"{name}:{kind}:{data[at:stop].decode()}")
            at = stop + 1
        elif kind == "B":
            own, count = chr(data[at]), int.from_bytes(data[at + 1 : at + 5], "little")
            made = struct.unpack_from(f"<{count}{NUMBERS[own]}", data, at + 5)
            out.append(f"{name}:B:{','.join([own, *map(_number, made)])}")
            at += 5 + count * struct.calcsize(NUMBERS[own])
        else:
            raise FormatError(f"tag of unknown kind {kind!r}")
    return out


def _number(x: float) -> str:
    return f"{x:g}" if isinstance(x, float) else str(x)


def encode(record: dict) -> bytes:
    """One record with its length before it; nulls stand for missing values."""
    name = (record["qname"] or "*").encode() + b"\0"
    if len(name) > 255:
        raise FormatError("query name over 254 bytes")
    cigar, seq, qual = record["cigar"] or "*", record["seq"] or "", record["qual"]
    ops = [(int(n), OPS.index(op)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)] if cigar != "*" else []
    span = sum(n for n, op in ops if op in (0, 2, 3, 7, 8))
    pos = -1 if record["pos"] is None else record["pos"]
    tags = [pack_tag(t) for t in record["tags"] or []]
    if len(ops) > MOST_OPS:
        tags.append(b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *(n << 4 | op for n, op in ops)))
        ops = [(len(seq), 4), (span, 3)]
    codes = [_CODE.get(c, 15) for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    quality = bytes(len(seq) * [255]) if qual is None else bytes(ord(c) - 33 for c in qual)
    if len(quality) != len(seq):
        raise FormatError("qualities and bases differ in number")
    none = lambda v: -1 if v is None else v
    fixed = FIXED.pack(none(record["tid"]), pos, len(name), record["mapq"] or 0, bin_of(max(pos, 0), max(pos, 0) + max(span, 1)), len(ops), record["flag"] or 0, len(seq), none(record["mtid"]), none(record["mpos"]), record["tlen"] or 0)
    body = b"".join([fixed, name, struct.pack(f"<{len(ops)}I", *(n << 4 | op for n, op in ops)), packed, quality, *tags])
    return struct.pack("<i", len(body)) + body


def place(body: bytes) -> tuple[int, int, int, int]:
    """(reference, begin, end, flag) of a record without its length; an unmapped one and one without operations span 1."""
    tid, pos, name_size, _, _, n_ops, flag, *_ = FIXED.unpack_from(body)
    span = 0
    if not flag & 4:
        at = FIXED.size + name_size
        ops = struct.unpack_from(f"<{n_ops}I", body, at)
        span = sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))
    return tid, pos, pos + max(span, 1), flag


def decode(body: bytes) -> dict:
    """Fields of one record without its length."""
    tid, pos, name_size, mapq, _, n_ops, flag, n, mtid, mpos, tlen = FIXED.unpack_from(body)
    at = FIXED.size + name_size
    if at + 4 * n_ops + (n + 1) // 2 + n > len(body) or not name_size:
        raise FormatError("record is shorter than its fields")
    name = body[FIXED.size : at].rstrip(b"\0").decode()
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    at += 4 * n_ops
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in body[at : at + (n + 1) // 2])[:n]
    at += (n + 1) // 2
    quality = body[at : at + n]
    tags = unpack_tags(body[at + n :])
    if n_ops == 2 and ops[0] == n << 4 | 4 and ops[1] & 15 == 3:  # the true CIGAR is in a tag
        long = [t for t in tags if t.startswith("CG:B:I,")]
        if long:
            ops = [int(x) for x in long[0].split(",")[1:]]
            tags.remove(long[0])
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or None
    none = lambda v: None if v < 0 else v
    return {"qname": None if name == "*" else name, "flag": flag, "tid": none(tid), "pos": none(pos), "mapq": mapq, "cigar": cigar, "mtid": none(mtid), "mpos": none(mpos), "tlen": tlen, "seq": seq or None, "qual": None if not n or quality[0] == 255 else "".join(chr(q + 33) for q in quality), "tags": tags}


def records(data: bytes | bgzf.Content) -> Iterator[dict]:
    """Records of a decompressed file: all of its bytes, or its blocks as they are asked for."""
    content = data if isinstance(data, bgzf.Content) else bgzf.Plain(data)

    def taken(size: int) -> bytes:
        found = content.take(size)
        if len(found) < size:
            raise FormatError("header is cut off")
        return found

    start = content.take(8)
    if start[:4] == b"BAM\1":
        start += taken(int.from_bytes(start[4:8], "little"))
        start += (count := taken(4))
        for _ in range(int.from_bytes(count, "little")):
            start += (name := taken(4))
            start += taken(int.from_bytes(name, "little") + 4)
    _, references, _ = read_header(start)
    while length := content.take(4):
        if len(length) < 4:
            raise FormatError("record length is cut off")
        size = int.from_bytes(length, "little")
        body = content.take(size) if size >= FIXED.size else b""
        if size < FIXED.size or len(body) < size:
            raise FormatError("record is cut off")
        made = decode(body)
        if max(made["tid"] or 0, made["mtid"] or 0) >= max(1, len(references)):
            raise FormatError("reference number beyond the header")
        yield made


def write_bam(df: DataFrame, path: str, references: list[tuple[str, int]], text: str = "", level: int = 6) -> None:
    """Write ``df`` (columns of SCHEMA) to rows of a Parquet folder: part, and the bytes of one BAM file each.

    A partition of many records makes several files, closed at 16 MB before
    compression.  A task holds one file, compressed, and a block.
    """
    most = 16 << 20

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = header_block(text, references)
        held, count = bgzf.Packer(level), 0
        held.add(head)

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"records": pa.array([count], pa.int64()), "content": pa.array([held.finish()], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for record in batch.slice(at, 500).to_pylist():
                    held.add(encode(record))
                    count += 1
                    if held.size > most:
                        yield closed()
                        held, count = bgzf.Packer(level), 0
                        held.add(head)
        yield closed()

    df.select(*COLUMNS).mapInArrow(run, "records long, content binary").write.mode("overwrite").parquet(path)


def _typed() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in SCHEMA.split(", "))])


def read_bam(files: DataFrame, check_end: bool = True) -> DataFrame:
    """Records of ``files`` (content): what ``write_bam`` wrote, or Spark's binaryFile source over ``*.bam``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _typed()
        for batch in batches:
            for value in batch.column("content"):
                raw = value.as_py()
                if check_end and not bgzf.ends_well(raw):
                    raise FormatError("the end block is missing")
                held: list[dict] = []
                for record in records(bgzf.Content(raw)):
                    held.append(record)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("content").mapInArrow(run, SCHEMA)


def bam_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("content")


def block_counts(files: DataFrame) -> DataFrame:
    """blocks, bytes (before compression) of each file's members; nothing is decoded to records."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [[len(bgzf.inflate(m)) for _, m in bgzf.members(value.as_py())] for value in batch.column("content")]
            yield pa.RecordBatch.from_pydict({"blocks": pa.array([len(x) for x in sizes], pa.int64()), "bytes": pa.array([sum(x) for x in sizes], pa.int64())})

    return files.select("content").mapInArrow(run, "blocks long, bytes long")
