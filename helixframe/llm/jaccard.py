"""N-gram Jaccard join by partition of the universe (operator 1).

Sets are grouped by size bands.  A band fixes a number of segments; a hash
deals every fingerprint of the universe to one of them.  Two sets that reach
the similarity differ in at most D elements, so if D + 1 units are spread over
the segments, in one of them they differ in fewer elements than it has units:
one unit asks for equal segments, two also for segments that differ by one
element, found through one-deletion neighbourhoods.  The cheapest units are
taken: a corpus-wide sketch of fingerprint counts tells segments made of common
passages, which then get none.  Candidates are verified on the whole sets.

The result asks for components.  A bucket of few entries gives its candidate
pairs; a larger one only says that its entries belong to one cluster, first
within a map step, then over the corpus, so no bucket makes a square of rows.
A cluster's members are verified against its head, the member of most large
buckets.  Those that are apart from it then meet all members of the cluster,
in blocks of bounded size that are compared whole and give a forest of links.
Every candidate pair is in one bucket with its partner, so none is lost,
however the rows are dealt.  Counts of fingerprints in ranges bound an
intersection from above; only pairs that pass this bound carry their whole
sets.

Sets hold 64-bit fingerprints of shingles: two different shingles of one pair
of texts fall together with a probability of about 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import layout, steps
from .components import components
from .idbits import IdBits
from .scratch import Scratch, shuffle_width
from .shingles import U, digests, mixed, shingle_sets
from .worker import released

#: Cells of the sketch of fingerprint counts, as a power of two, and cells in a row of it.
SKETCH_BITS, SKETCH_ROW = 20, 1 << 14
#: Buckets of up to so many entries give all their pairs, larger ones join a cluster.
SMALL = 12
#: Sets in a block of a cluster, bytes of their fingerprints (or one set, if larger), and sets that a comparison takes of a block at once.
BLOCK_SETS, BLOCK_BYTES, PIECE_SETS = 1024, 1 << 21, 256
#: Fingerprints that a comparison of two blocks lays out at once.
COLUMNS = 4096
#: From this many segments on, only one in so many has deletion neighbourhoods.
ALL_DELETIONS, SOME_DELETIONS = 48, 8
#: Ids up to this number are broadcast as a filter of the texts; of more a table of bits is.
BROADCAST_IDS = 400_000
#: Cost of a segment without elements, which any set may share.
EMPTY = 1e18
DELETION, PROBE, HEAD, SALTS = 1, 2, 4, 64
#: Kinds of pairs: a candidate to verify; two entries of one cluster.
CANDIDATE, CLUSTER = 0, 1
#: Two entries of a key that make a pair.
USABLE = f"(x.flag | y.flag) & {PROBE} <> 0 AND x.flag & y.flag & {DELETION} = 0"


def most_different(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of sets of these sizes that reach the similarity."""
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Band b holds sizes from 2^b to 2^(b+1) - 1."""

    def __init__(self, percent: int):
        self.percent = percent
        self.high = (1 << np.arange(1, 41, dtype=np.int64)) - 1
        worst = most_different(self.high * 100 // percent, self.high, percent) + 1
        self.segments = worst + worst // 8

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)


def signature(bands: Bands, sizes: np.ndarray, sets: np.ndarray, band: np.ndarray, own: bool, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, flags, row) of the index entries of non-empty sets in the key space of ``band``.

    With ``own``, all segments are indexed and the chosen ones marked as
    probes; without, only what the set asks of a lower band.
    """
    segments = bands.segments[band]
    need = most_different(sizes, np.minimum(sizes, bands.high[band]), bands.percent) + 1
    base = np.concatenate(([0], np.cumsum(segments)))
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    # The order of fingerprints is the order of their segments.
    cell = base[row_of] + (((sets >> U(32)) * segments[row_of].astype(U)) >> U(32)).astype(np.int64)
    total = int(base[-1])
    count = np.bincount(cell, minlength=total)
    stop = np.cumsum(count)
    start = stop - count
    value = mixed(sets ^ U(0x5851F42D4C957F2D))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(value)))
    summed = sums[stop] - sums[start]
    cell_row = np.repeat(np.arange(len(sizes)), segments)
    number = np.arange(total) - base[cell_row]
    # The key space of a segment: its band and number.
    space = mixed(band[cell_row].astype(U) << U(40) | number.astype(U))

    def key(space: np.ndarray, summed: np.ndarray, count: np.ndarray) -> np.ndarray:
        return mixed(summed + space + count.astype(U) * U(0xA24BAED4963EE407))

    excess = sketch[(sets & U((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    filled = np.flatnonzero(count)
    cost = np.full(total, EMPTY)
    cost[filled] = np.minimum.reduceat(excess, start[filled]) if len(filled) else 0
    marked = (segments[cell_row] < ALL_DELETIONS) | (number % SOME_DELETIONS == 0)
    double = np.flatnonzero(marked & (count > 0))
    # One deletion may take the rarest element: the second rarest counts.
    second = np.full(total, EMPTY / 2)
    lowest = excess == cost[cell]
    ties = np.bincount(cell[lowest], minlength=total)
    rest = np.where(lowest, np.inf, excess)
    if len(filled):
        second[filled] = np.minimum(np.minimum.reduceat(rest, start[filled]), EMPTY / 2)
    second = np.where(ties > 1, cost, second)
    unit_cell = np.concatenate([np.arange(total), double])
    unit_cost = np.concatenate([cost, second[double] + 0.5])
    order = np.lexsort((unit_cost, cell_row[unit_cell]))
    ranked = cell_row[unit_cell[order]]
    heads = np.searchsorted(ranked, np.arange(len(sizes)))
    chosen = np.zeros(len(unit_cell), bool)
    chosen[order] = np.arange(len(order)) - heads[ranked] < need[ranked]
    one, two = chosen[:total], np.zeros(total, bool)
    two[double] = chosen[total:]
    one = one | two

    keys, flags, rows = [], [], []
    whole = np.arange(total) if own else np.flatnonzero(one)
    keys.append(key(space[whole], summed[whole], count[whole]))
    flags.append(np.where(one[whole], PROBE, 0))
    rows.append(cell_row[whole])
    # Indexed empty segments are spread over salts; the few probes of them go to all.
    empty = count[whole] == 0
    asks = np.flatnonzero(empty & one[whole])
    salt = mixed(sums[np.cumsum(sizes)][cell_row[whole]]) % U(SALTS)
    keys[0] = np.where(empty, mixed(keys[0] + salt), keys[0])
    if len(asks):
        each = np.arange(SALTS, dtype=U)
        plain = key(space[whole[asks]], summed[whole[asks]], count[whole[asks]])
        keys.append(mixed(plain[:, None] + each[None, :]).ravel())
        flags.append(np.full(len(asks) * SALTS, PROBE))
        rows.append(np.repeat(cell_row[whole[asks]], SALTS))
    deleting = marked if own else two
    at = np.flatnonzero(deleting[cell])
    cells = cell[at]
    keys.append(key(space[cells], summed[cells] - value[at], count[cells] - 1))
    flags.append(np.where(two[cells], DELETION | PROBE, DELETION))
    rows.append(cell_row[cells])
    if len(at):  # a segment of one element without it is an empty one: those keys are salted
        lone = np.flatnonzero(count[cells] == 1)
        if len(lone):
            plain, spread = keys[-1][lone], mixed(sums[np.cumsum(sizes)][cell_row[cells[lone]]]) % U(SALTS)
            keys[-1][lone] = mixed(plain + spread)
            asking = lone[two[cells[lone]]]
            each = np.arange(SALTS, dtype=U)
            keys.append(mixed(key(space[cells[asking]], summed[cells[asking]] - value[at[asking]], count[cells[asking]] - 1)[:, None] + each[None, :]).ravel())
            flags.append(np.full(len(asking) * SALTS, DELETION | PROBE))
            rows.append(np.repeat(cell_row[cells[asking]], SALTS))
    return np.concatenate(keys), np.concatenate(flags), np.concatenate(rows)


def signatures(bands: Bands, sizes: np.ndarray, sets: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets in their own band and in the lower one that they may have links into."""
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, band = sizes[full], bands.of(sizes[full])
    keys, flags, rows = signature(bands, size, sets, band, True, sketch)
    down = (band > 0) & (bands.percent * size <= 100 * bands.high[np.maximum(band - 1, 0)])
    out = [(keys, flags, full[rows])]
    if down.any():
        low = np.flatnonzero(down)
        keys, flags, rows = signature(bands, size[low], sets[np.repeat(down, size)], band[low] - 1, False, sketch)
        out.append((keys, flags, full[low][rows]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def counted(pairs: np.ndarray) -> np.ndarray:
    """Distinct rows (a < b, kind, n) of pairs (a, b, kind), without loops; n is how often each came."""
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs = np.column_stack([pairs[:, :2].min(1), pairs[:, :2].max(1), pairs[:, 2]])
    found, n = np.unique(pairs, axis=0, return_counts=True)
    return np.column_stack([found, n])


def stars(keys: np.ndarray, flags: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster edges of buckets; entries are sorted by (key, deletion, id), ``large`` marks the buckets in order.

    A bucket needs a probe and an entry without a deletion, or it has no
    candidate pair.  Returns (edges, place of the head of each bucket that has
    them, mark of their entries).
    """
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(heads, len(keys)))
    joined = large & (flags[heads] & DELETION == 0) & (np.bitwise_or.reduceat(flags, heads) & PROBE != 0)
    member = np.repeat(joined, size)
    top = np.repeat(heads, size)[member]
    return np.stack([ids[top], ids[member], np.full(len(top), CLUSTER)], axis=1), heads[joined], member


def bucket_pairs(keys: np.ndarray, flags: np.ndarray, ids: np.ndarray, small: int = SMALL) -> np.ndarray:
    """Rows (a < b, kind, n) of the entries that share a key.

    A bucket of up to ``small`` entries gives all pairs with a probe, but for two
    deletions; a larger one, or one with an entry that stands for others, the
    edges of a cluster.
    """
    order = np.lexsort((ids, flags & DELETION, keys))
    keys, flags, ids = keys[order], flags[order], ids[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(heads, len(keys)))
    every = np.bitwise_or.reduceat(flags, heads)
    large = (size > small) | (every & HEAD != 0)
    out = [stars(keys, flags, ids, large)[0]]
    bucket = np.repeat(np.arange(len(heads)), size)
    plain = np.flatnonzero((~large & (size > 1) & (every & PROBE != 0))[bucket])
    for step in range(1, small):
        x, y = plain[:-step], plain[step:]
        met = (bucket[x] == bucket[y]) & ((flags[x] | flags[y]) & PROBE != 0) & (flags[x] & flags[y] & DELETION == 0)
        if not met.any():
            break
        out.append(np.stack([ids[x[met]], ids[y[met]], np.full(int(met.sum()), CANDIDATE)], axis=1))
    return counted(np.concatenate(out))


def candidate_pairs(docs: DataFrame, percent: int, k: int, sketch: np.ndarray) -> DataFrame:
    """a, b, kind, n: candidates and cluster edges of all buckets; a pair may come from several."""
    parts = shuffle_width(docs.sparkSession)
    bands = Bands(percent)
    kind = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("flags", pa.binary()), ("place", pa.binary()), ("ids", pa.binary())])

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = layout(batch.column("text"))
            doc_ids = batch.column("doc_id").to_numpy()
            for at, to in steps(ends):
                sizes, sets = shingle_sets(raw, ends[at : to + 1], k)
                keys, flags, rows = signatures(bands, sizes, sets, sketch)
                ids = doc_ids[at:to]
                # A bucket that is large in this step and has candidates is a cluster here and goes on as its head alone.
                pairs = np.zeros((0, 4), np.int64)
                ordered = np.sort(keys)
                if (ordered[SMALL:] == ordered[:-SMALL]).any():
                    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
                    large = np.flatnonzero((count > SMALL)[place])
                    large = large[np.lexsort((ids[rows[large]], flags[large] & DELETION, keys[large]))]
                    edges, heads, member = stars(keys[large], flags[large], ids[rows[large]], np.True_)
                    pairs = counted(edges)
                    flags[large[heads]] |= HEAD | PROBE
                    member[heads] = False
                    keep = np.ones(len(keys), bool)
                    keep[large[member]] = False
                    keys, flags, rows = keys[keep], flags[keep], rows[keep]
                flags = flags.astype(np.uint8)
                part = (keys % U(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                keys, flags, rows = keys[by], flags[by], rows[by].astype(np.uint32)
                cuts = np.searchsorted(part[by], np.arange(parts + 1)).tolist()
                columns: list[list] = [[], [], [], [], []]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if y > x:
                        used, place = np.unique(rows[x:y], return_inverse=True)
                        narrow = place.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                        for column, value in zip(columns, (p, keys[x:y].tobytes(), flags[x:y].tobytes(), narrow.tobytes(), ids[used].tobytes()), strict=True):
                            column.append(value)
                if len(pairs):
                    for column, value in zip(columns, (at % parts, b"", b"", b"", pairs.tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types, strict=True)], kind.names)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        current = None

        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(pairs[:, c].copy()) for c in (0, 1)), pa.array(pairs[:, 2].astype(np.int32)), pa.array(pairs[:, 3].copy())], ["a", "b", "kind", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, flags, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                # Most keys stand alone: they go before the full sort.
                ordered = np.sort(keys)
                again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
                place = np.searchsorted(again, keys) if len(again) else np.zeros(0, int)
                if len(again):
                    place[place == len(again)] = 0
                    kept = again[place] == keys
                    yield out(bucket_pairs(keys[kept], flags[kept].astype(np.int64), ids[kept]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != current:
                    yield from flush()
                    current = row["part"]
                ids = np.frombuffer(row["ids"], np.int64)
                if not row["keys"]:
                    yield out(ids.reshape(-1, 4))
                    continue
                keys = np.frombuffer(row["keys"], U)
                narrow = np.uint16 if len(row["place"]) == 2 * len(keys) else np.uint32
                held.append((keys, np.frombuffer(row["flags"], np.uint8), ids[np.frombuffer(row["place"], narrow)]))
        yield from flush()

    dealt = docs.mapInArrow(released(released(index)), "part int, keys binary, flags binary, place binary, ids binary")
    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(released(released(match)), "a long, b long, kind int, n long")


def chosen_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (id); a short list is broadcast."""
    keys = ids.select(F.col("id").alias("doc_id"))
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, "doc_id", "left_semi")


def counts_of(fingerprints: np.ndarray) -> bytes:
    """How many elements fall in each of 2^k equal ranges of fingerprints, 1 to 2 on average; empty if one has over 255."""
    cells = 1 << max(3, int(len(fingerprints) - 1).bit_length() - 1)
    counts = np.bincount((fingerprints >> U(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_link(n: int, m: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether sizes and range counts leave the similarity possible: no intersection is over the sum of minima."""
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        few = min(len(a), len(b))
        a, b = (c.reshape(few, -1).sum(1, dtype=np.int64) for c in (a, b))
    bound = int(np.minimum(a, b).sum(dtype=np.int64))
    return 100 * bound >= percent * (n + m - bound)


def likely(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, ...) with a column ``may``: whether outlines (id, n, counts) leave a link possible."""
    kept = pairs.columns
    schema = pairs.schema.add("may", "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True)
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([may_link(*row, percent) for row in rows], pa.bool_())], [*kept, "may"])

    first = outlines.select(F.col("id").alias("a"), "n", F.col("counts").alias("x"))
    second = outlines.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("counts").alias("y"))
    return pairs.join(first, "a").join(second, "b").select(*kept, "n", "m", "x", "y").mapInArrow(released(released(run)), schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked for ``pairs`` (a, b), by the whole sets (id, set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                merged = np.concatenate([x, y])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                linked.append(100 * common >= percent * (len(merged) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    own = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    other = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(own, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(released(released(run)), "a long, b long, linked boolean")


def _with_sets(k: int, outline: bool, bits: IdBits | None = None):
    """(id, set) or (id, n, counts) of each text, with ``bits`` only of those it may list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(bits.may(batch.column("doc_id"))))
            raw, ends = layout(batch.column("text"))
            for at, to in steps(ends):
                sizes, sets = shingle_sets(raw, ends[at : to + 1], k)
                cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
                own = [sets[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
                ids = batch.column("doc_id").slice(at, to - at)
                if outline:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([counts_of(x) for x in own], pa.binary())], ["id", "n", "counts"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in own], pa.binary())], ["id", "set"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, outline: bool) -> DataFrame:
    """(id, set) or (id, n, counts) of the texts whose doc_id is in ``ids`` (id); of a long list, of a few more.

    No text passes a shuffle: either the ids go to the texts, or a table of bits.
    """
    n = ids.count()
    near = docs.join(F.broadcast(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi") if n <= BROADCAST_IDS else docs
    run = _with_sets(k, outline, None if n <= BROADCAST_IDS else IdBits(ids, n))
    return near.mapInArrow(released(run), "id long, n long, counts binary" if outline else "id long, set binary")


def _distinct_sets(docs: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(sizes and digests of all rows; doc_id, n_shingles, rep, n_copies of those with a set and an id; sketch of fingerprint counts)."""

    def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n_shingles", "d1", "d2", "block", "counts"]
        for batch in batches:
            raw, ends = layout(batch.column("text"))
            for at, to in steps(ends):
                sizes, sets = shingle_sets(raw, ends[at : to + 1], k)
                cells += np.bincount((sets & U(len(cells) - 1)).astype(np.int64), minlength=len(cells))
                d1, d2 = digests(sizes, sets)
                none = pa.nulls(to - at, pa.int32()), pa.nulls(to - at, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), *none], names)
        blocks = np.flatnonzero(cells.reshape(-1, SKETCH_ROW).any(1))
        if len(blocks):
            blobs = [cells.reshape(-1, SKETCH_ROW)[b].tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(blocks), pa.int64()) for _ in range(4)), pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], names)

    first = scratch.table(docs.mapInArrow(released(released(sized)), "doc_id long, n_shingles long, d1 long, d2 long, block int, counts binary"), "sized")

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROW, np.int64)
        for blob in table.column("counts"):
            total += np.frombuffer(blob.as_py(), np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    # 64 rows of a fixed sketch: 8 MB at any size of the corpus.
    cells = np.zeros(1 << SKETCH_BITS)
    for row in first.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(summed, "block int, counts binary").collect():
        cells[row["block"] * SKETCH_ROW : (row["block"] + 1) * SKETCH_ROW] = np.frombuffer(row["counts"], np.int64)
    usual = float(np.median(cells))
    sketch = np.maximum(0.0, cells - usual - 4 * np.sqrt(usual + 1)).astype(np.float32)

    meta = first.filter("block is null")
    real = meta.filter("n_shingles > 0 and doc_id is not null")
    alike = real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    reps = scratch.table(real.join(alike, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "rep", "n_copies"), "reps")
    return meta, reps, sketch


def join_components(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets
    of k-word shingles; a component is what links reach, named by its smallest
    doc_id.  n_copies is the number of rows with the same set.  A text without
    words (or null) links with nothing.  Rows with one doc_id count as one
    document with regard to links; a null doc_id has no links and a null
    component.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    meta, reps, sketch = _distinct_sets(docs, k, scratch)
    rep_of = reps.filter("doc_id <> rep").select(F.col("doc_id").alias("id"), "rep").distinct()

    def of_reps(pairs: DataFrame) -> DataFrame:
        """Pairs between representatives of equal sets, each once."""
        for side in ("a", "b"):
            pairs = pairs.join(rep_of.select(F.col("id").alias(side), F.col("rep").alias("_rep")), side, "left").withColumn(side, F.coalesce("_rep", side)).drop("_rep")
        least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        return pairs.filter("a <> b").select(least, most, "kind", "n").groupBy("a", "b", "kind").agg(F.sum("n").alias("n"))

    # Rows that repeat a doc_id, with one text or several, are one document: it has the links of each text.
    repeated = not meta.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()

    def once(rows: DataFrame) -> DataFrame:
        return rows.distinct() if repeated else rows

    texts = docs.filter("doc_id is not null")
    raw = scratch.table(candidate_pairs(texts, percent, k, sketch).groupBy("a", "b", "kind").agg(F.sum("n").alias("n")), "raw")
    scratch.release()  # the index's shuffle files, the largest of all
    pairs = scratch.table(of_reps(raw), "pairs")
    edges = pairs.filter(F.col("kind") == CLUSTER)
    clusters = scratch.table(clustered(edges, scratch), "clusters")
    heads = scratch.table(clusters.groupBy("cluster").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("head")), "heads")
    leads = clusters.join(heads, "cluster").filter("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    # Two members of one cluster are left to it.
    plain = _apart(pairs.filter(F.col("kind") == CANDIDATE), clusters.select(F.col("id").alias("node"), F.col("cluster").alias("component")))
    asked = scratch.table(plain.unionByName(leads).distinct(), "asked")
    nodes = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    outlines = scratch.table(_sets_of(texts, scratch.table(nodes, "nodes-1"), k, True), "outlines")
    may = scratch.table(once(likely(asked, once(outlines), percent).filter("may").select("a", "b")), "likely")
    nodes = may.select(F.explode(F.array("a", "b")).alias("id")).unionByName(clusters.select("id")).distinct()
    sets = scratch.table(_sets_of(texts, scratch.table(nodes, "nodes-2"), k, False), "sets")
    sets = once(sets)
    links = scratch.table(verified(may, sets, percent).filter("linked").select("a", "b"), "links-1")
    scratch.release()
    if not clusters.isEmpty():
        links = links.unionByName(scratch.table(_cluster_links(clusters.join(heads, "cluster"), links, sets, percent, scratch), "links-2"))
    found = scratch.table(components(links, scratch, "last"), "parts")
    named = reps.join(found, reps.rep == found.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "n_copies")
    # Rows that share a doc_id share its component.
    named = named.withColumn("component_id", F.min("component_id").over(Window.partitionBy("doc_id")))
    lone = meta.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    scratch.drop("raw", "pairs", "clusters", "asked", "nodes-1", "nodes-2", "outlines", "likely", "sets", "blocks", "heads", "links-1", "links-2")
    return named.unionByName(lone)


def clustered(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, cluster, n (large buckets that the set is a member of) of the ends of ``edges`` (a, b, n)."""
    ends = edges.select("a", "b", "n")
    weight = ends.select(F.col("b").alias("id"), "n").unionByName(ends.select(F.col("a").alias("id"), F.lit(0).cast("long").alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
    found = components(ends.select("a", "b"), scratch, "cluster").withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    return found.join(weight, "id")


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component of ``parts`` (node, component)."""
    for side in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    return pairs.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


class Block:
    """Sets of a cluster: ids, sizes, the sets end to end, and the component of each so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sets: np.ndarray, parts: np.ndarray):
        self.ids, self.sizes, self.sets, self.parts = ids, sizes, sets, parts
        self.owner = np.repeat(np.arange(len(ids)), sizes)

    def pieces(self) -> list[Block]:
        """The same sets, PIECE_SETS at a time."""
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        cuts = [slice(a, a + PIECE_SETS) for a in range(0, len(self.ids), PIECE_SETS)]
        return [Block(self.ids[c], self.sizes[c], self.sets[ends[c.start] : ends[min(c.stop, len(self.ids))]], self.parts[c]) for c in cuts]


def common(x: Block, y: Block) -> np.ndarray:
    """Intersection sizes of each set of ``x`` with each of ``y``: a product of 0/1 matrices over the shared fingerprints."""
    shared = np.intersect1d(x.sets, y.sets)
    out = np.zeros((len(x.ids), len(y.ids)), np.float32)  # exact below 2^24, and there are COLUMNS at most in a step
    total = np.zeros(out.shape, np.int64)
    if not len(shared):
        return total
    sides = []
    for own in (x, y):
        place = np.minimum(np.searchsorted(shared, own.sets), len(shared) - 1)
        hit = shared[place] == own.sets
        order = np.argsort(place[hit], kind="stable")
        sides.append((place[hit][order], own.owner[hit][order], len(own.ids)))
    for start in range(0, len(shared), COLUMNS):
        made = []
        for place, owner, n in sides:
            a, b = np.searchsorted(place, (start, start + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(shared) - start)), np.float32)
            m[owner[a:b], place[a:b] - start] = 1
            made.append(m)
        total += (made[0] @ made[1].T).astype(np.int64)
    return total


def forest(x: Block, y: Block, percent: int) -> list[tuple[int, int]]:
    """Links of two blocks that join components: no more than there are components to join."""
    both = common(x, y)
    linked = 100 * both >= percent * (x.sizes[:, None] + y.sizes[None, :] - both)
    linked &= x.parts[:, None] != y.parts[None, :]
    root: dict[int, int] = {}

    def find(p: int) -> int:
        while (up := root.get(p, p)) != p:
            p = up
        return p

    out = []
    for i, j in zip(*(at.tolist() for at in np.nonzero(linked)), strict=True):
        p, q = find(int(x.parts[i])), find(int(y.parts[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(x.ids[i]), int(y.ids[j])))
    return out


def _cluster_links(members: DataFrame, links: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: links between ``members`` (id, cluster, head) of one cluster beyond ``links`` (a, b) that join its components.

    Members that link to the head need no comparison with their like; all
    others meet every member of near size, block by block.
    """
    spark = members.sparkSession
    lead = members.withColumns({"a": F.least("id", "head"), "b": F.greatest("id", "head")})
    led = lead.join(links.withColumn("led", F.lit(True)).distinct(), ["a", "b"], "left")
    told = led.select("id", "cluster", F.when(F.col("led") | (F.col("id") == F.col("head")), F.col("head")).otherwise(F.col("id")).alias("part"), "head")
    told = scratch.table(told.withColumn("outlier", F.col("part") != F.col("head")).drop("head"), "told")
    some = scratch.table(told.filter("outlier").select("cluster").distinct(), "some")
    rows = told.join(some, "cluster", "left_semi").join(sets, "id").select("cluster", "outlier", (F.octet_length("set") / 8).cast("long").alias("n"), "id", "part", "set")
    rows = scratch.table(rows, "members")
    # A block is a share of the members of about one size: how many there are tells the number of shares.
    grade = F.floor(2 * F.log2("n")).cast("int").alias("grade")
    shares = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, 8 * F.sum("n") / BLOCK_BYTES)).alias("shares")
    counts = scratch.table(rows.groupBy("cluster", "outlier", grade).agg(shares), "shares")
    kinds = ["cluster", "outlier", "grade"]
    rows = rows.withColumn("grade", grade).join(counts, kinds).withColumn("share", F.pmod(F.xxhash64("id"), "shares"))
    by = [*kinds, "share"]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = number = 0

        def closed() -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, sizes, own = (np.array([r[c] for r in held], np.int64) for c in ("id", "n", "part"))
            ends = {"cluster": held[0]["cluster"], "outlier": held[0]["outlier"], "least": int(sizes.min()), "most": int(sizes.max()), "no": TaskContext.get().partitionId() << 32 | number}
            return pa.RecordBatch.from_pylist([{**ends, "ids": ids.tobytes(), "sizes": sizes.tobytes(), "sets": b"".join(r["set"] for r in held), "parts": own.tobytes()}], kind)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (size + len(row["set"]) > 2 * BLOCK_BYTES or any(row[c] != held[0][c] for c in by)):
                    yield closed()
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row["set"])
        if held:
            yield closed()

    kind = pa.schema([("cluster", pa.int64()), ("outlier", pa.bool_()), ("least", pa.int64()), ("most", pa.int64()), ("no", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "sets", "parts"))])
    dealt = rows.repartition(shuffle_width(spark), *by).sortWithinPartitions(*by, "id").select(*by, "n", "id", "part", "set")
    blocks = scratch.table(dealt.mapInArrow(released(released(packed)), "cluster long, outlier boolean, least long, most long, no long, ids binary, sizes binary, sets binary, parts binary"), "blocks")
    scratch.drop("members", "told", "some", "shares")
    spans = blocks.select("cluster", "outlier", "least", "most", "no")
    x, y = spans.filter("outlier").alias("x"), spans.alias("y")
    near = (F.col("x.least") * percent <= F.col("y.most") * 100) & (F.col("y.least") * percent <= F.col("x.most") * 100)
    met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & near & (~F.col("y.outlier") | (F.col("x.no") <= F.col("y.no"))))
    met = met.select(F.col("x.no").alias("x"), F.col("y.no").alias("y"))
    names = ("ids", "sizes", "sets", "parts")
    for side in ("y", "x"):
        met = met.join(blocks.select(F.col("no").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in names)), side)

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, other = (Block(*(np.frombuffer(batch.column(f"{side}_{c}")[i].as_buffer(), U if c == "sets" else np.int64) for c in names)).pieces() for side in ("x", "y"))
                same = batch.column("x")[i].as_py() == batch.column("y")[i].as_py()
                found = [link for j, piece in enumerate(one) for mate in (other[j:] if same else other) for link in forest(piece, mate, percent)]
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return met.mapInArrow(released(released(compared)), "a long, b long")


def _entries(texts: DataFrame, percent: int, k: int, sketch: np.ndarray) -> DataFrame:
    """id, key, flag: the index entries of all texts."""
    bands = Bands(percent)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = layout(batch.column("text"))
            for at, to in steps(ends):
                sizes, sets = shingle_sets(raw, ends[at : to + 1], k)
                keys, flags, rows = signatures(bands, sizes, sets, sketch)
                ids = batch.column("doc_id").to_numpy()[at:to][rows]
                for start in range(0, len(keys), 1 << 16):
                    cut = slice(start, start + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), pa.array(keys[cut].view(np.int64)), pa.array(flags[cut].astype(np.int32))], ["id", "key", "flag"])

    return texts.mapInArrow(released(released(keyed)), "id long, key long, flag int")


def join_links(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """a, b (a < b): every link between ``docs`` (doc_id, text) that stand for the rows with their set.

    Rows with equal sets are all linked, and stand here as the smallest doc_id
    among them.  All pairs of a bucket are verified, so the rows grow with the
    square of a group of near copies, as the links do.
    """
    scratch = Scratch(docs.sparkSession, "links")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, reps, sketch = _distinct_sets(docs, k, scratch)
    texts = chosen_texts(docs, reps.select(F.col("rep").alias("id")).distinct())
    entries = scratch.table(_entries(texts, percent, k, sketch), "entries")
    x, y = entries.alias("x"), entries.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & F.expr(USABLE))
    pairs = scratch.table(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "pairs")
    outlines = scratch.table(texts.mapInArrow(released(_with_sets(k, True)), "id long, n long, counts binary"), "outlines")
    may = scratch.table(likely(pairs, outlines, percent), "likely").filter("may").select("a", "b").distinct()
    sets = scratch.table(texts.mapInArrow(released(_with_sets(k, False)), "id long, set binary"), "sets")
    links = scratch.table(verified(may, sets, percent).filter("linked").select("a", "b").distinct(), "links")
    scratch.drop("sized", "reps", "entries", "pairs", "outlines", "likely", "sets")
    return links
