"""Connected components of a graph given by its edges, without bringing it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import release, store

#: Edges that a task contracts at a time.
CHUNK = 1 << 18


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node that is not that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while not np.array_equal(ru := root[u], rv := root[v]):
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Every chunk of a task's edges as a star forest: no more edges, the same components."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            a, b = _roots(*(t.column(c).to_numpy() for c in ("a", "b")))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts.append(batch)
            if sum(map(len, parts)) >= CHUNK:
                yield flush(parts)
                parts = []
        if parts:
            yield flush(parts)

    return edges.mapInArrow(apply, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("of"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("of")).where("b > a") \
        .select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
    moved = down.join(least, F.col("a") == F.col("of")).where("b <> m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one root at most, and no root has one."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return node.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long); root is the smallest node reachable.

    Alternating large and small stars (Kiveris et al. 2014): a logarithmic number of rounds, each
    a sum per node and a join that Spark may split where a node has many edges.  Before a round
    every task contracts its own edges, a bounded chunk at a time.  The edges never grow in
    number, each round is written to the shared folder, and the driver sees one answer a round.
    Loops and repeated edges do no harm; no edges, no rows; edges without one end are left out.
    """
    now = store(_contracted(edges.select("a", "b").where("a <> b")).distinct(), "edges")
    while not _is_star_forest(now):
        last, now = now, store(_small_star(_large_star(_contracted(now))).distinct(), "edges")
        release(last)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
