"""Approximate nearest neighbours over a hierarchical k-means tree (operator 9).

The tree is fitted on a bounded sample and sent to all tasks; every vector is
indexed under its leaf.  A query walks the tree best bin first: a priority
queue holds the branches not yet taken, nearest first, and gives leaves in the
order in which they are visited.  How many leaves a query visits is
calibrated: the number is widened until a sample of queries, searched by brute
force over all rows, reaches the recall asked for.

A leaf's vectors stream past the queries that visit it; a task keeps the best
of each query over all its leaves and sends no others.  A leaf of many rows is
dealt to several tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .scratch import shuffle_width
from .vectors import BLOCK, asked_once, best, matrix, ranked, usable
from .worker import released

#: Vectors the tree is fitted on at most, branches of a node, and the fewest vectors of the sample that are split.
SAMPLE, BRANCHES, LEAST = 65_536, 8, 64
#: Rows for a vector of the sample (but for the first 8,192), rows of a leaf to aim for, and levels at least and at most.
SAMPLED, LEAF_ROWS, DEPTHS = 64, 512, (3, 5)
#: Rows of a leaf that one task takes, and queries whose best a task holds before it sends them.
SALT_ROWS, HELD = 100_000, 50_000
#: Queries of the calibration, and the recall they must reach.
CALIBRATION, RECALL = 96, 0.97


class Tree:
    """Nodes as arrays: children of node i are ``children[i]``; a leaf has a number in ``leaf``."""

    def __init__(self, sample: np.ndarray, depth: int = DEPTHS[0], seed: int = 5):
        self.centres: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self._split(0, sample, depth, np.random.default_rng(seed))
        self.matrix = np.stack(self.centres)

    def _split(self, node: int, points: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        groups = self._kmeans(points, rng) if depth and len(points) >= LEAST else []
        if len(groups) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return
        for centre, own in groups:
            child = len(self.centres)
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(child)
            self._split(child, own, depth - 1, rng)

    @staticmethod
    def _kmeans(points: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = points[rng.choice(len(points), BRANCHES, replace=False)]
        for _ in range(8):
            near = nearest(points, centres)
            centres = np.stack([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        near = nearest(points, centres)
        return [(centres[c], points[near == c]) for c in range(len(centres)) if (near == c).any()]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child, level by level."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = nearest(points[rows], np.stack([self.centres[c] for c in self.children[node]]))
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def walk(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that best-bin-first traversal visits."""
        far = ((self.matrix - query) ** 2).sum(1)
        heap, out = [(far[0], 0)], []
        while heap and len(out) < leaves:
            _, node = heapq.heappop(heap)
            while self.children[node]:  # down to a leaf, the branches passed by into the queue
                first, *rest = sorted(self.children[node], key=far.__getitem__)
                for child in rest:
                    heapq.heappush(heap, (far[child], child))
                node = first
            out.append(self.leaf[node])
        return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


def top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, ids, scores) of the k best of each query in a batch, never its own id.

    A matrix product finds the candidates; scores are then summed in one order
    whatever the shapes, so equal vectors tie.
    """
    rough = q @ own.T
    slack = 1e-12 * (1 + np.sqrt((q**2).sum(1)) * np.sqrt((own**2).sum(1).max(initial=0)))
    for i, scores in enumerate(rough):
        scores[ids == q_ids[i]] = -np.inf
        near = np.flatnonzero(scores > -np.inf)
        if len(near) > k:
            places = best(scores[near], ids[near], k)
            near = near[scores[near] >= scores[near[places[-1]]] - slack[i]]
        exact = np.einsum("ij,j->i", own[near], q[i], optimize=False)
        places = best(exact, ids[near], k)
        yield i, ids[near[places]], exact[places]


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: up to k candidates of largest inner product for each query.

    Queries are the rows for which ``is_query`` (over a column ``id``) holds;
    candidates are all rows but those with the query's own id.  Null vectors,
    zero vectors and those with null or non-finite components take no part;
    shorter ones are continued by zeros.  Scores are inner products of the
    original vectors in double precision; ties go to the smaller id.  Where
    the leaves visited hold fewer than k candidates, the query visits all.
    Rows that repeat an id are one candidate, whose best vector counts; a
    repeated query id asks with the smallest of its vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.table(usable(vectors, id_col, vector_col, nonzero=True), "rows")
    width = int(rows.agg(F.max(F.size("vec"))).first()[0] or 0)

    def bounded(df: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the smallest hashes, ``count`` at most."""
        found = df.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(count).toPandas()
        out = np.zeros((len(found), width))
        for i, vec in enumerate(found["vec"]):
            out[i, : len(vec)] = vec
        return found["id"].to_numpy(np.int64), out

    total = rows.count()
    sample = min(SAMPLE, max(8192, total // SAMPLED))
    depth = min(DEPTHS[1], max(DEPTHS[0], int(np.ceil(np.log(max(1, total / LEAF_ROWS)) / np.log(BRANCHES)))))
    tree = Tree(bounded(rows, sample)[1], depth)

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                leaf = tree.assign(matrix(part.column("vec"), width))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), part.column("id"), part.column("vec")], ["leaf", "id", "vec"])

    index = scratch.table(rows.mapInArrow(released(released(indexed)), "leaf int, id long, vec array<double>"), "index")
    # One row for a leaf.
    salts = {r["leaf"]: -(-r["n"] // SALT_ROWS) for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    queries = scratch.table(asked_once(rows.filter(is_query)), "queries")

    # Calibration: true neighbours of some queries among all rows, and the leaves they are in.
    some_ids, some = bounded(queries, CALIBRATION)
    found_type = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    found = "query_id long, vec_id long, score double"

    class Best:
        """The k best of each query that a task has met."""

        def __init__(self) -> None:
            self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def meet(self, q_ids: np.ndarray, q: np.ndarray, batch: pa.RecordBatch) -> None:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids, own = part.column("id").to_numpy(), matrix(part.column("vec"), width)
                for first in range(0, len(q), 256):
                    for i, new, scores in top(q_ids[first : first + 256], q[first : first + 256], ids, own, k):
                        q_id = int(q_ids[first + i])
                        if (had := self.held.get(q_id)) is not None:
                            new, scores = np.concatenate([had[0], new]), np.concatenate([had[1], scores])
                            places = best(scores, new, k)
                            new, scores = new[places], scores[places]
                        self.held[q_id] = new, scores

        def sent(self) -> Iterator[pa.RecordBatch]:
            if self.held:
                sizes = [len(x) for x, _ in self.held.values()]
                columns = np.repeat([*self.held], sizes), *(np.concatenate(x) for x in zip(*self.held.values(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, found_type.types, strict=True)], schema=found_type)
                self.held.clear()

    def brute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best()
        for batch in batches:
            kept.meet(some_ids, some, batch)
        yield from kept.sent()

    # k rows for each of the sample.
    truth = ranked(index.select("id", "vec").mapInArrow(released(released(brute)), found), k).join(index.select(F.col("id").alias("vec_id"), "leaf"), "vec_id")
    leaves_of: dict[int, list[int]] = {}
    for row in truth.groupBy("query_id", "vec_id").agg(F.min("leaf").alias("leaf")).collect():
        leaves_of.setdefault(row["query_id"], []).append(row["leaf"])
    reached = np.zeros(tree.leaves + 1)
    for q_id, vec in zip(some_ids.tolist(), some, strict=True):
        place_of = {leaf: i + 1 for i, leaf in enumerate(tree.walk(vec, tree.leaves))}
        own = leaves_of.get(q_id, [])
        for leaf in own:
            reached[place_of[leaf] :] += 1 / len(own)
        if not own:
            reached += 1
    wanted = recall * max(1, len(some_ids))
    visits = int(np.argmax(reached >= wanted - 1e-9)) if len(some_ids) and reached[-1] >= wanted - 1e-9 else tree.leaves
    visits = max(1, visits)

    def visiting(count: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    part = batch.slice(start, 64)
                    taken = [(i, leaf, salt) for i, vec in enumerate(matrix(part.column("vec"), width)) for leaf in tree.walk(vec, count) for salt in range(salts.get(leaf, 0))]
                    if taken:
                        row, leaf, salt = (np.array(c, np.int32) for c in zip(*taken, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(salt), part.column("id").take(pa.array(row)), part.column("vec").take(pa.array(row))], ["leaf", "salt", "id", "vec"])

        return run

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (leaf, salt), queries first."""
        kept, current = Best(), None
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            leaf, salt, candidate = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "salt", "candidate"))
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1]) | (candidate[1:] != candidate[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (place := (int(leaf[a]), int(salt[a]))) != current:
                    current, asked = place, []
                    if len(kept.held) > HELD:
                        yield from kept.sent()
                if not candidate[a]:
                    asked.append((part.column("id").to_numpy(), matrix(part.column("vec"), width)))
                elif asked:
                    if len(asked) > 1:
                        asked = [tuple(np.concatenate(x) for x in zip(*asked, strict=True))]
                    kept.meet(*asked[0], part)
        yield from kept.sent()

    several = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for leaf, n in salts.items() if n > 1 for x in (leaf, n)) or (F.lit(-1), F.lit(1))), "leaf"), F.lit(1)) if any(n > 1 for n in salts.values()) else F.lit(1)
    given = index.select("leaf", F.pmod(F.xxhash64("id", F.lit(3)), several).cast("int").alias("salt"), F.lit(True).alias("candidate"), "id", "vec")

    def visited(queries: DataFrame, count: int) -> DataFrame:
        asked = queries.mapInArrow(released(visiting(count)), "leaf int, salt int, id long, vec array<double>").withColumn("candidate", F.lit(False))
        both = given.unionByName(asked).repartition(shuffle_width(spark), "leaf", "salt").sortWithinPartitions("leaf", "salt", "candidate")
        return ranked(both.mapInArrow(released(released(meet)), found), k)

    first = scratch.table(visited(queries, visits), "first")
    if visits >= tree.leaves:
        return first
    # Only these have less than they could: all rows are searched for them.
    short = queries.join(first.filter(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    short = scratch.table(short, "short")
    if total <= k or short.isEmpty():
        return first if total > k else visited(queries, tree.leaves)
    full = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*first.columns)
    return full.unionByName(visited(short, tree.leaves))
