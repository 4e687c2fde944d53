"""Token-ID output in grammar-compressed shards (operator 4).

Documents are encoded, dealt by ranges of doc_id and written as shards in
ascending order.  A shard is compressed by Re-Pair: rounds replace the pairs
of ids that are frequent in it by nonterminals until none is left, and the shard stores the rules
with the length each nonterminal expands to.  No pair crosses the end of a
document, so each document is a slice of the compressed sequence and can be
decoded by itself.

Shard layout, little-endian: ``b"RPGS"``, u32 version, u32 documents, u32
rules, u64 compressed ids, u32 first nonterminal, u32 leading documents without
a doc_id; i64 doc_id of each document;
u32 ids of each document; u32 compressed ids of each document; the rules as
pairs of u32; u32 expansion length of each rule; the compressed ids as u32
in byte planes; all after the first nonterminal compressed by Zstandard.

A doc_id may be null or repeated: nulls come first, equal ones stand in the
order of their ids.  A null text is an empty document: the end id alone.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import layout, steps
from .pieces import PieceTable
from .scratch import Scratch, shuffle_width
from .shingles import LOWER, SEPARATOR
from .worker import released

#: A shard is closed when it holds so many ids (or one document, if longer).
SHARD_IDS = 1 << 18
#: Pairs are replaced from this count in a shard on, so many of them in a round.
LEAST_COUNT, RULES_A_ROUND = 16, 4096
HEAD = struct.Struct("<4sIIIQII")
NULL_ID = -(1 << 63)


class WordTokenizer:
    """A tokenizers-library model with a table of words.

    A tokenizer that lower-cases, drops white space and splits between letters
    and other characters gives a word the same ids in any text and case, and
    nothing changes between a letter and a mark after it.  Where the model has
    another shape, and for texts with an added token or a sigma (whose lower
    case hangs on its neighbours), texts go whole.
    """

    #: The model's own definition of such a tokenizer.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
    LETTER[97:123] = True
    JOINED = 64
    MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as text:
            made = text.read()
        self.model = Tokenizer.from_str(made)
        shape = json.loads(made)
        cut = (shape["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.by_word = shape["normalizer"] == self.NORMALIZER and cut.get("pattern") == {"Regex": self.SPLIT} and cut.get("invert") is True
        ending = shape["model"].get("end_of_word_suffix")
        #: Whether a word ends with an id, where the model marks that.
        self.suffix = np.zeros(max(self.model.get_vocab().values()) + 1, bool) if self.by_word and ending else None
        if self.suffix is not None:
            self.suffix[[i for token, i in self.model.get_vocab().items() if token.endswith(ending)]] = True
        self.odd = [t.content.encode().lower() for t in self.model.get_added_tokens_decoder().values()] + ["Σ".encode()]
        self.table = PieceTable(self.learn, doublings=1)

    def plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of them) of each text, by the library alone."""
        made = [x.ids for x in self.model.encode_batch_fast([text.decode() for text in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``plain``; words of letters alone go JOINED at a time, and the ids that end a word part them again."""
        if self.suffix is None:
            return self.plain(words)
        letters = np.fromiter(map(bytes.isalpha, words), bool, len(words))
        easy, hard = np.flatnonzero(letters), np.flatnonzero(~letters)
        runs = [b" ".join([words[i] for i in easy[at : at + self.JOINED]]) for at in range(0, len(easy), self.JOINED)]
        (ids, _), (more, counts) = self.plain(runs), self.plain([words[i] for i in hard])
        stops = np.flatnonzero(self.suffix[ids]) + 1
        sizes, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[easy], first[easy] = np.diff(stops, prepend=0), np.concatenate(([0], stops))[: len(easy)]
        sizes[hard], first[hard] = counts, len(ids) + np.cumsum(counts) - counts
        total = np.cumsum(sizes)
        index = np.repeat(first - (total - sizes), sizes) + np.arange(int(sizes.sum()))
        return np.concatenate([ids, more])[index], sizes

    def encode(self, raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; texts lie end to end at ``ends`` in ``raw``."""
        edges, own = ends - ends[0], raw[ends[0] : ends[-1]]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (len(edges) - 1)
        if not len(own):
            return out
        data, buf = own.tobytes(), LOWER[own]
        whole, lower = np.full(len(out), not self.by_word), buf.tobytes()
        for odd in self.odd:
            at = lower.find(odd)
            while at >= 0:
                whole[int(np.searchsorted(edges, at, side="right")) - 1] = True
                at = lower.find(odd, at + 1)
        inside = ~SEPARATOR[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[edges] = True
        start, stop = inside.copy(), inside.copy()
        cut = ~inside[:-1] | edge[1 : len(buf)] | (self.LETTER[buf[:-1]] & self.MARK[buf[1:]])
        start[1:] &= cut
        stop[:-1] &= ~inside[1:] | cut
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if whole.any():
            kept = ~whole[np.searchsorted(edges, starts, side="right") - 1]
            starts, stops = starts[kept], stops[kept]
            places = np.flatnonzero(whole & (np.diff(edges) > 0))
            ids, counts = self.plain([data[edges[i] : edges[i + 1]] for i in places])
            for i, made in zip(places.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] = made
        ids, counts = self.table.encode(buf, starts, stops)
        cuts = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, edges)].tolist()
        return [ids[a:b] if b > a else empty for a, b, empty in zip(cuts, cuts[1:], out, strict=False)]


_models: dict[str, WordTokenizer] = {}


def model(path: str) -> WordTokenizer:
    if path not in _models:
        _models.clear()
        _models[path] = WordTokenizer(path)
    return _models[path]


def encoded(docs: DataFrame, path: str, end_id: int, cuts: list[int]) -> DataFrame:
    """part, key, ids of every row of ``docs``: ids as packed binary, part the range between ``cuts`` that the key is in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            raw, ends = layout(batch.column("text"))
            keys = batch.column("key").to_numpy()
            parts = np.searchsorted(np.array(cuts, np.int64), keys, side="left").astype(np.int32)
            for at, to in steps(ends):
                blobs = [pack_ids(ids, end_id) for ids in own.encode(raw, ends[at : to + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(parts[at:to]), batch.column("key").slice(at, to - at), batch.column("no_id").slice(at, to - at), pa.array(blobs, pa.binary())], ["part", "key", "no_id", "ids"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.col("doc_id").isNull().alias("no_id"), "text")
    return keyed.mapInArrow(released(released(run)), "part int, key long, no_id boolean, ids binary")


def pack_ids(ids: np.ndarray, end_id: int) -> bytes:
    """The ids with the end id after them."""
    last = np.uint32(end_id)
    if max(end_id, int(ids.max()) if ids.size else 0) < 1 << 16:
        return b"".join((b"\2", ids.astype("<u2").tobytes(), last.astype("<u2").tobytes()))
    return b"".join((b"\4", ids.astype("<u4").tobytes(), last.astype("<u4").tobytes()))


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[:1] == b"\2" else "<u4", offset=1).astype(np.uint32)


def repair(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Re-Pair over documents laid end to end.

    Rounds go on until no pair inside documents has LEAST_COUNT places.  Returns
    compressed ids, compressed length of each document, rules (pairs), their
    expansion lengths and the first nonterminal.
    """
    first = int(ids.max()) + 1 if ids.size else 0
    sequence = ids.astype(np.uint64)
    last = np.zeros(len(ids), bool)
    ends = np.cumsum(lengths)
    last[ends[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    expansion = [np.ones(first, np.int64)]
    total = first
    while len(sequence) > 1:  # every round replaces a pair at least
        pairs = sequence[:-1] << np.uint64(32) | sequence[1:]
        inside = ~last[:-1]
        # Most pairs are too rare: counts of their hashes, never below their own, spare the sort of those.
        mixed = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        load = np.bincount(mixed[inside], minlength=1 << 18)
        ordered = np.sort(pairs[inside & (load[mixed] >= LEAST_COUNT)])
        if not ordered.size:
            break
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if not often.size:
            break
        if often.size > RULES_A_ROUND:
            often = often[np.argpartition(-counts[often], RULES_A_ROUND)[:RULES_A_ROUND]]
        chosen = np.sort(ordered[starts[often]])
        # A pair is first looked up in a table of its low hash bits, then exactly.
        table = np.zeros(1 << 18, bool)
        table[((chosen * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[mixed] & inside)
        place = np.searchsorted(chosen, pairs[maybe])
        place[place == len(chosen)] = 0
        hit = chosen[place] == pairs[maybe]
        at, place = maybe[hit], place[hit]
        # Of pairs that overlap in a row, every other one from the left is replaced.
        fresh = np.concatenate(([True], np.diff(at) != 1)) if at.size else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        offset = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        taken = offset % 2 == 0
        at, place = at[taken], place[taken]
        used, renamed = np.unique(place, return_inverse=True)
        pick = chosen[used]
        sequence = sequence.copy()
        sequence[at] = (total + renamed).astype(np.uint64)
        last[at] = last[at + 1]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence, last = sequence[keep], last[keep]
        left, right = (pick >> np.uint64(32)).astype(np.int64), (pick & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rules.append(np.stack([left, right], axis=1))
        lengths_so_far = np.concatenate(expansion)
        expansion.append(lengths_so_far[left] + lengths_so_far[right])
        total += len(pick)
    made = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    marks = np.flatnonzero(last)
    own = np.zeros(len(lengths), np.int64)
    own[lengths > 0] = np.diff(np.concatenate(([-1], marks)))
    return sequence.astype(np.uint32), own, made, np.concatenate(expansion)[first:], first


def write_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, no_ids: int = 0) -> bytes:
    sequence, own, rules, expansion, first = repair(ids, lengths)
    head = HEAD.pack(b"RPGS", 2, len(doc_ids), len(rules), len(sequence), first, no_ids)
    narrow = [x.astype("<u4").tobytes() for x in (lengths, own, rules, expansion)]
    planes = sequence.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if len(sequence) else b""
    body = b"".join([doc_ids.astype("<i8").tobytes(), *narrow, planes])
    return head + zstandard.ZstdCompressor(level=1).compress(body)


class Shard:
    """Reader of one shard; documents decode one by one or all at once."""

    def __init__(self, blob: bytes):
        magic, version, docs, rules, size, self.first, self.no_ids = HEAD.unpack_from(blob)
        if magic != b"RPGS" or version != 2:
            raise ValueError("not a token shard")
        body = zstandard.ZstdDecompressor().decompress(blob[HEAD.size :])
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        at = 8 * docs
        self.lengths = np.frombuffer(body, "<u4", docs, at).astype(np.int64)
        own = np.frombuffer(body, "<u4", docs, at + 4 * docs).astype(np.int64)
        at += 8 * docs
        self.rules = np.frombuffer(body, "<u4", 2 * rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * rules
        self.expansion = np.frombuffer(body, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.sequence = np.frombuffer(body, np.uint8, 4 * size, at).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(own)))
        # Expansions of the nonterminals end to end; those of plain ids are the ids.
        self.offsets = np.concatenate(([0], np.cumsum(self.expansion)))
        self.flat = np.zeros(self.offsets[-1], np.int64)
        for k, (left, right) in enumerate(self.rules.tolist()):
            to = self.offsets[k]
            for part in (left, right):
                if part < self.first:
                    self.flat[to] = part
                    to += 1
                else:
                    a, b = self.offsets[part - self.first], self.offsets[part - self.first + 1]
                    self.flat[to : to + b - a] = self.flat[a:b]
                    to += b - a

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        rule = sequence - self.first
        plain = rule < 0
        sizes = np.ones(len(sequence), np.int64)
        sizes[~plain] = self.expansion[rule[~plain]]
        starts = np.cumsum(sizes) - sizes
        table = np.concatenate([self.flat, sequence[plain]])
        source = np.empty(len(sequence), np.int64)
        source[~plain] = self.offsets[rule[~plain]]
        source[plain] = len(self.flat) + np.arange(int(plain.sum()))
        return table[np.repeat(source - starts, sizes) + np.arange(int(sizes.sum()))].astype(np.uint32)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its slice alone."""
        return self.expand(self.sequence[self.bounds[k] : self.bounds[k + 1]])

    def all(self) -> np.ndarray:
        return self.expand(self.sequence)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write shards to the Parquet folder ``path``.

    Each row is a shard: (part, seq, first_doc, docs, ids, shard).  Shards
    ordered by (part, seq) hold the documents in ascending order of doc_id.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_width(spark)
    # Cuts come from the doc_ids alone, so texts are encoded once.
    shares = F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), 100 * parts) if parts > 1 else F.lit(None)
    cuts = sorted(set(docs.agg(shares).first()[0] or []))
    dealt = encoded(docs, tokenizer, end_id, cuts).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "key", F.desc("no_id"), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        held: list[np.ndarray] = []
        size = seq = part = no_ids = 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in held], np.int64)
            blob = write_shard(np.array(keys, np.int64), lengths, np.concatenate(held), no_ids)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_doc": pa.array([keys[0]], pa.int64()), "docs": pa.array([len(keys)], pa.int64()), "ids": pa.array([int(lengths.sum())], pa.int64()), "shard": pa.array([blob], pa.binary())}
            )

        for batch in batches:
            for key, blob, number, no_id in zip(batch.column("key").to_pylist(), batch.column("ids"), batch.column("part").to_pylist(), batch.column("no_id").to_pylist(), strict=True):
                ids = unpack_ids(blob.as_py())
                if held and (size + len(ids) > SHARD_IDS or number != part):
                    yield closed()
                    keys, held, size, seq, no_ids = [], [], 0, seq + 1, 0
                part = number
                no_ids += no_id
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if held:
            yield closed()

    dealt.mapInArrow(released(released(run)), "part int, seq int, first_doc long, docs long, ids long, shard binary").write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Shard rows of a folder with ``base``: ids in all shards before this one."""
    shards = spark.read.schema("part int, seq int, first_doc long, docs long, ids long, shard binary").parquet(path)
    # Ids before each part: one row for a part.  Within a part, shards are summed in order.
    starts, before = [], 0
    for row in shards.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect():
        starts.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "part int, before long")
    earlier = F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    bases = shards.select("part", "seq", F.coalesce(earlier, F.lit(0)).alias("own")).join(F.broadcast(offsets), "part")
    return shards.drop("ids").join(bases.select("part", "seq", (F.col("own") + F.col("before")).alias("base")), ["part", "seq"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, base in zip(batch.column("shard"), batch.column("base").to_pylist(), strict=True):
                shard = Shard(blob.as_py())
                ids = memoryview(shard.all().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                sums = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), shard.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=np.arange(len(ends)) < shard.no_ids), pa.array(base + ends - shard.lengths, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read_token_files(spark, path).select("shard", "base").mapInArrow(released(released(run)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and report from the files."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_token_files(docs, scratch.at("files"), tokenizer, end_id)
    return token_digests(docs.sparkSession, scratch.at("files"))
