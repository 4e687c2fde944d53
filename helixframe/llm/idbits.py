"""Bit tables of ids: a fixed number of bits an id tells rows that are certainly not listed from the few that may be.

A table moves to the rows, so that no text passes a shuffle for its id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import U, mixed
from .worker import released

#: Bits an id (up to twice as many, by the next power of two) and bits at most: 32 MB. Beyond that more rows pass, and none less.
BITS_AN_ID, MOST_BITS = 12, 1 << 28
#: Bits that an id sets, and bits in a row of the table.
SALTS, ROW = (U(0x8CB92BA72F3D8DD7), U(0x3C79AC492BA7B653)), 1 << 16


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    """The bits of ids in a table of ``size`` bits, those of each salt one after another."""
    return np.concatenate([mixed(ids.view(U) ^ salt) & U(size - 1) for salt in SALTS]).astype(np.int64)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


class IdBits:
    """The ids of a column ``id`` of ``ids``, of which there are ``n``."""

    def __init__(self, ids: DataFrame, n: int):
        self.size = size = min(MOST_BITS, max(ROW, 1 << (BITS_AN_ID * n).bit_length()))

        def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = np.unique(_places(_numbers(batch.column("id")), size))
                rows, first = np.unique(places // ROW, return_index=True)
                parts = np.split((places % ROW).astype(np.uint16), first[1:])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["row", "places"])

        def joined(key: tuple, table: pa.Table) -> pa.Table:
            bits = np.zeros(ROW, np.uint8)
            for blob in table.column("places"):
                bits[np.frombuffer(blob.as_py(), np.uint16)] = 1
            return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        self.bits = np.zeros(size // 8, np.uint8)
        listed = ids.select(F.col("id").cast("long").alias("id")).filter("id is not null")
        for row in listed.mapInArrow(released(placed), "row int, places binary").groupBy("row").applyInArrow(joined, "row int, bits binary").collect():
            self.bits[row["row"] * ROW // 8 : (row["row"] + 1) * ROW // 8] = np.frombuffer(row["bits"], np.uint8)

    def may(self, column: pa.Array) -> np.ndarray:
        """Whether each id may be listed; False is certain, but for nulls."""
        ids = _numbers(column)
        places = _places(ids, self.size).reshape(len(SALTS), len(ids))
        return ((self.bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(0)


def without(docs: DataFrame, ids: DataFrame, broadcast: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids`` (id, distinct); only rows that may be listed meet the list."""
    n = ids.count()
    listed = ids.select(F.col("id").alias("doc_id"))
    if n <= broadcast:
        return docs.join(F.broadcast(listed), "doc_id", "left_anti").select(*docs.columns)
    table = IdBits(ids, n)

    @F.arrow_udf("boolean")
    def may(column: pa.Array) -> pa.Array:
        return pa.array(table.may(column))

    def told(doc_id: Column) -> Column:
        return F.coalesce(may(doc_id.cast("long")), F.lit(True))

    met = docs.filter(told(F.col("doc_id"))).join(listed, "doc_id", "left_anti").select(*docs.columns)
    return docs.filter(~told(F.col("doc_id"))).unionByName(met)
