"""Exact top-k search by inner product over a pivot-distance index (operator 3).

Inner products become distances: with a component sqrt(M^2 - |x|^2) added to
every vector and 0 added to every query, |q - x|^2 = |q|^2 + M^2 - 2 q.x, so
the highest products are the nearest vectors.  A vector's key is its nearest
pivot and the distance to it.  A query first searches the cell of its own
nearest pivot, which gives a radius, then the other cells that the triangle
inequality leaves.  Within a cell, vectors are sorted by their distance to the
pivot and searched in annuli outward from the query's own distance; the search
stops when the gap to the next annulus is over the radius.

Pivots are a bounded sample; every vector is indexed.  Scores are exact
integers: components are rounded down to integers first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .vectors import BLOCK, asked_once, best, blob, each_row, gathered, matrix, ranked, sent, usable
from .worker import released

#: Pivots, at least and at most, and rows for one of them in between.
PIVOTS, CELL_ROWS = (32, 1024), 32_768
#: Vectors from which the pivots are taken, and those in an annulus.
SAMPLE, ANNULUS = 4096, 512
#: Sums of integers up to this size are exact in float64.
EXACT = 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer-valued matrices, exactly (in 64-bit integers where float64 would round)."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squared, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far points: each next pivot is the sample's farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def search_block(block_ids, block, radii, q_ids, q, q_dist, limit, k, base):
    """Best of one cell's block for queries, annulus by annulus.

    block: vectors sorted by ``radii``, their distances to the cell's pivot.
    q_dist: each query's distance to that pivot; limit: its radius so far.
    base: |q|^2 + M^2, for distances from products.  Yields (row, ids, scores).
    """
    edges = np.arange(0, len(block), ANNULUS)
    inner, outer = radii[edges], radii[np.minimum(edges + ANNULUS, len(block)) - 1]
    gaps = np.maximum(0, np.maximum(inner[None, :] - q_dist[:, None], q_dist[:, None] - outer[None, :]))
    order = np.argsort(gaps, axis=1, kind="stable")
    slack = 1e-6 * (1 + np.sqrt(base))
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    limit = limit.copy()
    for step in range(len(edges)):
        ring = order[:, step]
        live = np.flatnonzero(gaps[np.arange(len(q)), ring] <= limit + slack)
        if not live.size:
            break
        for number in np.unique(ring[live]):
            rows = live[ring[live] == number]
            part = slice(edges[number], edges[number] + ANNULUS)
            scores = products(q[rows], block[part])
            for row, own in zip(rows.tolist(), scores, strict=True):
                ids, other = kept[row]
                others = block_ids[part] != q_ids[row]
                ids, own = np.concatenate([ids, block_ids[part][others]]), np.concatenate([other, own[others]])
                top = best(own, ids, k)
                kept[row] = ids[top], own[top]
                if len(top) == k:
                    limit[row] = min(limit[row], np.sqrt(max(0.0, base[row] - 2.0 * float(own[top[-1]]))))
    for row, (ids, scores) in enumerate(kept):
        yield row, ids, scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries are the rows of ``vectors`` for which ``is_query`` (over a column
    ``id``) holds; candidates are all rows but those with the query's own id.
    Vectors with a null or non-finite component, and null ids, take no part;
    shorter vectors are continued by zeros.  Ties go to the smaller id.  Rows
    that repeat an id are one candidate, whose best vector counts; a repeated
    query id asks with the smallest of its vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = usable(vectors, id_col, vector_col).withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    rows = scratch.table(rows, "rows")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.max(F.size("vec")), F.max(norm), F.count("*")).first()
    width, largest = int(stats[0] or 0), float(stats[1] or 0.0)
    # The sample is the rows with the smallest hashes: the same in every run.
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
    points = np.zeros((len(sample), width + 1))
    for i, vec in enumerate(sample):
        points[i, : len(vec)] = vec
    points[:, width] = np.sqrt(np.maximum(0, largest - (points**2).sum(1)))
    centres = choose_pivots(points, pivots or min(PIVOTS[1], max(PIVOTS[0], stats[2] // CELL_ROWS)))
    queries = scratch.table(asked_once(rows.filter(is_query)), "asked")

    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("radii", pa.binary()), ("least", pa.float64()), ("most", pa.float64())])

    def keyed(query: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from sent(cut(batches), schema)

        def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
            for ids, own in gathered(batches, width):
                lift = np.zeros(len(own)) if query else np.sqrt(np.maximum(0, largest - (own**2).sum(1)))
                far = distances(np.column_stack([own, lift]), centres)
                cell = far.argmin(1)
                for c in np.unique(cell):
                    members = np.flatnonzero(cell == c)
                    members = members[np.argsort(far[members, c], kind="stable")]
                    for start in range(0, len(members), BLOCK):
                        rows = members[start : start + BLOCK]
                        own_far = far[rows, c]
                        yield int(c), len(rows), blob(ids[rows]), blob(own[rows]), blob(far[rows] if query else own_far), float(own_far.min()), float(own_far.max())

        return run

    kind = "cell int, n long, ids binary, vecs binary, radii binary, least double, most double"
    blocks = scratch.table(rows.mapInArrow(released(keyed(False)), kind), "blocks")
    asked = scratch.table(queries.mapInArrow(released(keyed(True)), kind), "queries")
    # One row for a pivot.
    spans = {r["cell"]: (r["least"], r["most"]) for r in blocks.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()}

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_row(batches):
            c = row["cell"]
            q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vecs"]).reshape(-1, width)
            far, limit = np.frombuffer(row["q_far"]).reshape(len(q_ids), -1), np.frombuffer(row["q_limit"])
            ids, vecs = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"]).reshape(-1, width)
            base = (q**2).sum(1) + largest
            made = [(q_ids[i], x, s) for i, x, s in search_block(ids, vecs, np.frombuffer(row["radii"]), q_ids, q, far[:, c], limit, k, base) if len(x)]
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([m[0] for m in made], [len(m[1]) for m in made])), pa.array(np.concatenate([m[1] for m in made])), pa.array(np.concatenate([m[2] for m in made]))], ["query_id", "vec_id", "score"]
                )

    found = "query_id long, vec_id long, score long"

    def visit(questions: DataFrame) -> DataFrame:
        return blocks.select("cell", "ids", "vecs", "radii").join(questions, "cell").mapInArrow(released(released(search)), found)

    def everything(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = [blob(np.full(n, np.inf)) for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("ids"), batch.column("vecs"), batch.column("radii"), pa.array(limit, pa.binary())], ["cell", "q_ids", "q_vecs", "q_far", "q_limit"])

    question = "cell int, q_ids binary, q_vecs binary, q_far binary, q_limit binary"
    near = scratch.table(visit(asked.mapInArrow(released(released(everything)), question)), "near")
    # A query's radius: from its k-th best so far.
    worst = ranked(near, k).groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("have"))
    worst = scratch.table(worst.filter(F.col("have") == k).select(F.col("query_id").alias("id"), "worst"), "worst")
    limited = queries.join(worst, "id", "left")

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids, own = part.column("id").to_numpy(), matrix(part.column("vec"), width)
                far = distances(np.column_stack([own, np.zeros(len(own))]), centres)
                base = (own**2).sum(1) + largest
                worst = part.column("worst").to_numpy(zero_copy_only=False).astype(float)
                limit = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(0, base - 2 * np.nan_to_num(worst))))
                slack, home = 1e-6 * (1 + np.sqrt(base)), far.argmin(1)
                for c, (least, most) in spans.items():
                    bound = np.maximum(np.maximum(least - far[:, c], far[:, c] - most), (far[:, c] - far.min(1)) / 2)
                    rows = np.flatnonzero((home != c) & (bound <= limit + slack))
                    if rows.size:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([c], pa.int32()), *(pa.array([blob(x[rows])], pa.binary()) for x in (ids, own, far, limit))], ["cell", "q_ids", "q_vecs", "q_far", "q_limit"]
                        )

    rest = visit(scratch.table(limited.mapInArrow(released(released(others)), question), "others"))
    return ranked(near.unionByName(rest), k)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 20
"""
