"""Variant records in BCF: a sink that writes one whole file a partition, and a scan of such files.

Records are those of ``text.read_vcf``: chrom, pos (0-based), id, ref, alts,
qual, filters, info (map of texts, null for flags), format and samples (texts).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bgzf
from .bgzf import FormatError

SCHEMA = "chrom string, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string, string>, format array<string>, samples array<array<string>>"
COLUMNS = ["chrom", "pos", "id", "ref", "alts", "qual", "filters", "info", "format", "samples"]
#: Fixed values of the format: types of numbers with what stands for missing and for the end of a vector.
INTS = {1: ("b", -128, -127), 2: ("h", -(1 << 15), -(1 << 15) + 1), 3: ("i", -(1 << 31), -(1 << 31) + 1)}
FLOAT, CHAR = 5, 7
NO_FLOAT, END_FLOAT = 0x7F800001, 0x7F800002
SIZES = {0: 0, 1: 1, 2: 2, 3: 4, FLOAT: 4, CHAR: 1}
_LINE = re.compile(r"##(FILTER|INFO|FORMAT|contig)=<(.*)>\s*$")


class Header:
    """Dictionaries of a VCF header's lines: contigs, and names with the kind of their values."""

    def __init__(self, text: str):
        self.text = text if text.endswith("\n") else text + "\n"
        self.names, self.contigs, self.kinds = ["PASS"], [], {}
        for line in self.text.splitlines():
            m = _LINE.match(line)
            if not m:
                continue
            fields = dict(re.findall(r'(\w+)=("[^"]*"|[^,]*)', m[2]))
            if m[1] == "contig":
                self.contigs.append(fields["ID"])
                continue
            if fields["ID"] not in self.names:
                self.names.append(fields["ID"])
            self.kinds[m[1], fields["ID"]] = fields.get("Type", "String")
        self.place = {n: i for i, n in enumerate(self.names)}
        self.contig_place = {n: i for i, n in enumerate(self.contigs)}
        columns = next((x for x in self.text.splitlines() if x.startswith("#CHROM")), "").split("\t")
        self.samples = columns[9:]
        self.kept: dict[tuple[bytes, bytes], dict] = {}

    def kind(self, line: str, name: str) -> str:
        try:
            return self.kinds[line, name]
        except KeyError:
            raise FormatError(f"{line} {name} is not in the header") from None

    def block(self) -> bytes:
        raw = self.text.encode() + b"\0"
        return b"BCF\2\2" + struct.pack("<I", len(raw)) + raw


def _size(kind: int, count: int) -> bytes:
    return bytes([count << 4 | kind]) if count < 15 else bytes([15 << 4 | kind]) + _ints([count])


def _width(values: Iterable[int | None]) -> int:
    given = [v for v in values if v is not None]
    low, high = min(given, default=0), max(given, default=0)
    for kind, (code, missing, _) in INTS.items():
        # The eight lowest numbers of a type are set aside.
        if low >= missing + 8 and high <= -(missing + 1):
            return kind
    raise FormatError("a number beyond 32 bits")


def _fill(values: list[int | None], kind: int, length: int) -> bytes:
    code, missing, end = INTS[kind]
    return struct.pack(f"<{length}{code}", *(missing if v is None else v for v in values), *[end] * (length - len(values)))


def _ints(values: list[int | None]) -> bytes:
    return _few_ints(tuple(values)) if len(values) < 5 else _made_ints(values)


def _made_ints(values: list[int | None]) -> bytes:
    kind = _width(values)
    return _size(kind, len(values)) + _fill(values, kind, len(values))


#: Short values come again and again; what they become is kept.
_few_ints = lru_cache(1 << 13)(_made_ints)


def _chars(text: str | None) -> bytes:
    return _few_chars(text) if text is None or len(text) < 64 else _made_chars(text)


def _made_chars(text: str | None) -> bytes:
    raw = (text or "").encode()
    return _size(CHAR, len(raw)) + raw


_few_chars = lru_cache(1 << 13)(_made_chars)


def _float_bytes(values: list[float | None], length: int) -> bytes:
    return b"".join(struct.pack("<I", NO_FLOAT) if v is None else struct.pack("<f", v) for v in values) + struct.pack("<I", END_FLOAT) * (length - len(values))


def _numbers(text: str, whole: bool) -> list[int | float | None]:
    return [None if x == "." else int(x) if whole else float(x) for x in text.split(",")]


@lru_cache(1 << 13)
def _genotype(text: str) -> list[int]:
    out, phased = [], 0
    for mark, allele in re.findall(r"([/|]?)(\.|\d+)", text):
        phased = int(mark == "|")
        out.append((0 if allele == "." else int(allele) + 1) << 1 | phased)
    return out


def encode(record: dict, header: Header) -> bytes:
    """One record with its lengths before it; FormatError for names that the header lacks."""
    alleles = [record["ref"], *(record["alts"] or [])]
    info, keys = record["info"] or {}, record["format"] or []
    try:
        contig = header.contig_place[record["chrom"]]
        filters = [header.place[f] for f in record["filters"] or []]
    except KeyError as e:
        raise FormatError(f"{e} is not in the header") from None
    stop = info.get("END")
    span = int(stop) - record["pos"] if stop and stop.lstrip("-").isdigit() else len(record["ref"])
    quality = struct.pack("<I", NO_FLOAT) if record["qual"] is None else struct.pack("<f", record["qual"])
    out = [struct.pack("<iii", contig, record["pos"], span), quality, struct.pack("<II", len(alleles) << 16 | len(info), len(keys) << 24 | len(header.samples)), _chars(record["id"]), *map(_chars, alleles)]
    out.append(_ints(filters) if filters else b"\0")
    for name, value in info.items():
        kind = header.kind("INFO", name)
        out.append(_ints([header.place[name]]))
        if value is None or kind == "Flag":
            out.append(b"\0")
        elif kind == "Integer":
            out.append(_ints(_numbers(value, True)))
        elif kind == "Float":
            made = _numbers(value, False)
            out.append(_size(FLOAT, len(made)) + _float_bytes(made, len(made)))
        else:
            out.append(_chars(value))
    shared, out = b"".join(out), []
    for i, name in enumerate(keys):
        kind = "GT" if name == "GT" else header.kind("FORMAT", name)
        texts = [s[i] if s is not None and i < len(s) else "." for s in record["samples"]]
        if len(texts) != len(header.samples):
            raise FormatError("samples of record and header differ in number")
        out.append(_ints([header.place[name]]))
        if kind in ("GT", "Integer"):
            rows = [_genotype(t) if kind == "GT" else _numbers(t, True) for t in texts]
            width, length = _width(v for row in rows for v in row), max(map(len, rows), default=0)
            out.append(_size(width, length) + b"".join(_fill(row, width, length) for row in rows))
        elif kind == "Float":
            rows = [_numbers(t, False) for t in texts]
            length = max(map(len, rows), default=0)
            out.append(_size(FLOAT, length) + b"".join(_float_bytes(row, length) for row in rows))
        else:
            raws = [t.encode() for t in texts]
            length = max(map(len, raws), default=0)
            out.append(_size(CHAR, length) + b"".join(r.ljust(length, b"\0") for r in raws))
    own = b"".join(out)
    return struct.pack("<II", len(shared), len(own)) + shared + own


class _Reader:
    """Typed values one after another; FormatError where they end too early or have no such type."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise FormatError("record is cut off")
        self.at += size
        return self.data[self.at - size : self.at]

    def size(self) -> tuple[int, int]:
        mark = self.take(1)[0]
        kind, count = mark & 15, mark >> 4
        if kind not in SIZES:
            raise FormatError(f"value of unknown type {kind}")
        if count == 15:
            count = self.values(*self.size())[0]
            if count is None or count < 0:
                raise FormatError("vector of a negative length")
        return kind, count

    def values(self, kind: int, count: int) -> list | str | None:
        raw = self.take(SIZES[kind] * count)
        if kind == CHAR:
            return raw.rstrip(b"\0").decode()
        if kind == FLOAT:
            bits = struct.unpack(f"<{count}I", raw)
            floats = struct.unpack(f"<{count}f", raw)
            return [None if b == NO_FLOAT else f for b, f in zip(bits, floats, strict=True) if b != END_FLOAT]
        if kind == 0:
            return None
        code, missing, end = INTS[kind]
        return [None if v == missing else v for v in struct.unpack(f"<{count}{code}", raw) if v != end]

    def value(self) -> list | str | None:
        return self.values(*self.size())


def _text(values: list | str | None) -> str:
    if isinstance(values, str):
        return values or "."
    return ",".join("." if v is None else np.format_float_positional(np.float32(v), trim="-") if isinstance(v, float) else str(v) for v in values or [None])


def _genotype_text(codes: list[int]) -> str:
    return "".join(("" if i == 0 else "|" if c & 1 else "/") + ("." if c >> 1 == 0 else str((c >> 1) - 1)) for i, c in enumerate(codes)) or "."


def _name(names: list[str], number: int | None) -> str:
    if number is None or not 0 <= number < len(names):
        raise FormatError("a number beyond the header's names")
    return names[number]


def decode(shared: bytes, own: bytes, header: Header) -> dict:
    """Fields of one record."""
    if len(shared) < 8:
        raise FormatError("record is cut off")
    contig, pos = struct.unpack_from("<ii", shared)
    fields = _rest(shared[8:], own, header)
    return {"chrom": _name(header.contigs, contig), "pos": pos, **fields}


def _rest(shared: bytes, own: bytes, header: Header) -> dict:
    """All fields but the place; those of short records, which come again, are kept with the header and not to be changed."""
    if len(shared) + len(own) > 200:
        return _made_rest(shared, own, header)
    found = header.kept.get((shared, own))
    if found is None:
        if len(header.kept) >= 1 << 13:
            header.kept.clear()
        found = header.kept[shared, own] = _made_rest(shared, own, header)
    return found


def _made_rest(shared: bytes, own: bytes, header: Header) -> dict:
    r = _Reader(shared)
    r.take(4)
    raw = r.take(4)
    counts, more = struct.unpack("<II", r.take(8))
    name, alleles = r.value(), []
    for _ in range(counts >> 16):
        alleles.append(r.value())
    if not alleles or not all(isinstance(a, str) for a in alleles):
        raise FormatError("record without alleles")
    filters = r.value()
    info = {}
    for _ in range(counts & 0xFFFF):
        key = _name(header.names, (r.value() or [None])[0])
        kind, count = r.size()
        value = r.values(kind, count)
        info[key] = None if header.kind("INFO", key) == "Flag" else _text(value)
    r, keys, columns = _Reader(own), [], []
    count = more & 0xFFFFFF
    if count != len(header.samples):
        raise FormatError("samples of record and header differ in number")
    for _ in range(more >> 24):
        keys.append(_name(header.names, (r.value() or [None])[0]))
        kind, length = r.size()
        rows = [r.values(kind, length) for _ in range(count)]
        columns.append([_genotype_text(row) if keys[-1] == "GT" and isinstance(row, list) else _text(row) for row in rows])
    quality = None if struct.unpack("<I", raw)[0] == NO_FLOAT else struct.unpack("<f", raw)[0]
    return {
        "id": name or None, "ref": alleles[0], "alts": alleles[1:] or None, "qual": quality, "filters": [_name(header.names, f) for f in filters] if filters else None,
        "info": info or None, "format": keys or None, "samples": [list(x) for x in zip(*columns, strict=True)] if columns else [[] for _ in range(count)],
    }


def records(data: bytes) -> Iterator[dict]:
    """Records of a whole decompressed file."""
    if data[:4] != b"BCF\2" or len(data) < 9:
        raise FormatError("not BCF")
    at = 9 + int.from_bytes(data[5:9], "little")
    header = Header(data[9:at].rstrip(b"\0").decode())
    while at < len(data):
        if at + 8 > len(data):
            raise FormatError("record lengths are cut off")
        shared, own = struct.unpack_from("<II", data, at)
        if at + 8 + shared + own > len(data):
            raise FormatError("record is cut off")
        yield decode(data[at + 8 : at + 8 + shared], data[at + 8 + shared : at + 8 + shared + own], header)
        at += 8 + shared + own


def _lists(column: pa.Array) -> list[list | None]:
    """``to_pylist`` of lists: values of the innermost lists at once, not one scalar each."""
    if not pa.types.is_list(column.type):
        plain = pa.types.is_string(column.type) or column.null_count == 0 and pa.types.is_primitive(column.type)
        return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()
    every, sizes = _lists(column.flatten()), column.value_lengths().to_pylist()
    out, at = [], 0
    for n in sizes:
        out.append(None if n is None else every[at : at + n])
        at += n or 0
    return out


def _pylist(batch: pa.RecordBatch) -> Iterator[dict]:
    """Records of a batch (columns of SCHEMA), info as a dict."""
    for at in range(0, batch.num_rows, 2000):
        part = batch.slice(at, 2000)
        columns = [_lists(part.column(n)) for n in COLUMNS if n != "info"]
        infos = part.column("info").to_pylist()
        for info, *values in zip(infos, *columns, strict=True):
            yield dict(zip((n for n in COLUMNS if n != "info"), values, strict=True), info=dict(info or []))


def write_bcf(df: DataFrame, path: str, text: str, level: int = 6) -> None:
    """Write ``df`` (columns of SCHEMA) to rows of a Parquet folder: the bytes of one BCF file each, closed at 64 MB before compression."""
    most = 64 << 20

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header = Header(text)
        held, size, count = [header.block()], 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"records": pa.array([count], pa.int64()), "content": pa.array([bgzf.compress(b"".join(held), level)], pa.binary())})

        for batch in batches:
            for record in _pylist(batch):
                held.append(encode(record, header))
                size, count = size + len(held[-1]), count + 1
                if size > most:
                    yield closed()
                    held, size, count = [header.block()], 0, 0
        yield closed()

    df.select(*COLUMNS).mapInArrow(run, "records long, content binary").write.mode("overwrite").parquet(path)


def _typed() -> pa.Schema:
    texts = pa.list_(pa.string())
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), texts, pa.float64(), texts, pa.map_(pa.string(), pa.string()), texts, pa.list_(texts)]
    return pa.schema(list(zip(COLUMNS, kinds, strict=True)))


def read_bcf(files: DataFrame) -> DataFrame:
    """Records of ``files`` (content): what ``write_bcf`` wrote, or Spark's binaryFile source over ``*.bcf``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _typed()
        for batch in batches:
            for value in batch.column("content"):
                raw = value.as_py()
                if not bgzf.ends_well(raw):
                    raise FormatError("the end block is missing")
                held: list[dict] = []
                for record in records(bgzf.decompress(raw)):
                    held.append({**record, "info": None if record["info"] is None else list(record["info"].items())})
                    if len(held) == 2000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("content").mapInArrow(run, SCHEMA)
