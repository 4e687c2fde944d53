"""Vectors in Arrow batches and packed blocks; shared by the two searches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in one packed block at most.
BLOCK = 4096
#: Bytes of vectors that an index task holds before it cuts them into blocks, and of rows that it sends on at once.
GATHER_BYTES, SEND_BYTES = 32 << 20, 8 << 20
#: Cells of scores that one step of a search holds.
SCORE_CELLS = 4 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """id, vec of the rows that take part: id and vector not null, all components finite.

    Empty vectors take part as zero vectors unless ``nonzero`` asks for a
    component other than 0.
    """
    vec = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & vec.isNotNull()
    good &= F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        good &= F.exists(vec, lambda x: x != 0)
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64; shorter vectors are continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def gathered(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of many Arrow batches (id, vec) together, so that blocks of a cell are few and full."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            held.append((part.column("id").to_numpy(), matrix(part.column("vec"), width)))
            size += held[-1][1].nbytes
            if size >= GATHER_BYTES:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def sent(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= SEND_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def each_row(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches; binary values stay buffers of the batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: value.as_buffer() if isinstance(value := batch.column(name)[i], pa.BinaryScalar) else value.as_py() for name in batch.schema.names}


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of different ids, ties to smaller ids, best first."""
    wanted = k
    while True:
        if len(scores) > wanted:
            least = np.partition(scores, len(scores) - wanted)[len(scores) - wanted]
            places = np.flatnonzero(scores >= least)
        else:
            places = np.arange(len(scores))
        places = places[np.lexsort((ids[places], -scores[places]))]
        _, first = np.unique(ids[places], return_index=True)
        if len(first) >= k or len(places) == len(scores):
            return places[np.sort(first)[:k]]
        wanted = 2 * len(places)  # an id that comes often took the places


def asked_once(rows: DataFrame) -> DataFrame:
    """Queries (id, vec), one for an id: a repeated id asks with the smallest of its vectors."""
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the candidates found for each query, each id once."""
    from pyspark.sql import Window

    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # A query has k rows at most from each task that it visits.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
