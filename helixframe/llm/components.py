"""Connected components: in one task for a bounded number of links, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .worker import released


#: Links that one task takes, of 16 bytes each.
TASK_LINKS = 1_000_000


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) for every node of links ``a`` - ``b``."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        u, v = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in connected(*(np.concatenate(x) for x in zip(*held, strict=True)))], ["node", "component"])


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (smallest node reached) for every node of ``links`` (a, b).

    Every step aggregates minima, so no task gathers a node's neighbours; a
    node with many links is a skewed join that Spark splits.  Steps are written
    out, and end when a step leaves the edges unchanged.  Up to TASK_LINKS
    links, which fit in any task, need no steps.
    """
    links = links.select("a", "b")
    if links.count() <= TASK_LINKS:
        return links.coalesce(1).mapInArrow(released(released(_in_one_task)), "node long, component long")
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = scratch.table(links.filter("a <> b").select(least, most).distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        # Large star: a node's larger neighbours go to its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small star: a node's smaller neighbours, and itself, go to the smallest.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        step += 1
        edges = scratch.table(small, f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.drop(f"{name}-{step - 1}")
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = now
