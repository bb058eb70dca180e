"""Work on all pairs of rows, as bounded blocks.

Some statistics are defined on all pairs (the Euclidean silhouette, the nearest cluster in
Ward's method).  Rows are hashed into blocks of bounded size, every pair of blocks is one
group, and a group sends on per-row summaries, never pairs.  A row is copied once per block:
there are ``BLOCKS`` of them for the tasks to share until a block has ``BLOCK_BYTES``, so what is
shuffled grows with the rows.  The arithmetic stays quadratic by definition; groups work tile by
tile (``tiles``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile, and of a block of a table with fewer than ``BLOCKS`` times as many rows.
BLOCK_ROWS = 2_048
#: Blocks of a larger table, until one has ``BLOCK_BYTES``: their pairs are the groups to share.
BLOCKS = 16
BLOCK_BYTES = 1 << 26


def count_blocks(n: int, block_rows: int, row_bytes: int) -> int:
    """How many blocks ``n`` rows are cut into."""
    few = min(BLOCKS, math.ceil(n / block_rows))
    return max(1, few, math.ceil(n * row_bytes / BLOCK_BYTES))


def tiles(n: int, rows: int = BLOCK_ROWS) -> Iterator[slice]:
    """Ranges of at most ``rows`` of ``n`` rows."""
    return (slice(i, min(i + rows, n)) for i in range(0, n, rows))


def over_block_pairs(
    df: DataFrame,
    key: str,
    n: int,
    work: Callable[[pa.Table, pa.Table | None], pa.Table],
    schema: str,
    block_rows: int = BLOCK_ROWS,
    row_bytes: int = 8,
) -> DataFrame:
    """Apply ``work(left, right)`` to every unordered pair of blocks; right is None for a block
    with itself.  ``key`` must be unique, so that blocks are even; a row takes ``row_bytes``."""
    blocks = count_blocks(n, block_rows, row_bytes)
    placed = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn(
        "__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    placed = placed.withColumn("__p", F.least("__b", "__o")).withColumn(
        "__q", F.greatest("__b", "__o")
    ).drop("__o")

    def one(table: pa.Table) -> pa.Table:
        block = table.column("__b").to_numpy()
        p, q = table.column("__p")[0].as_py(), table.column("__q")[0].as_py()
        if p == q:
            return work(table, None)
        left = table.take(pa.array(np.flatnonzero(block == p)))
        right = table.take(pa.array(np.flatnonzero(block == q)))
        return work(left, right)

    # One group per task: a pair of blocks is the unit of work.
    pairs = blocks * (blocks + 1) // 2
    tasks = min(pairs, 20_000)
    return placed.repartition(tasks, "__p", "__q").groupBy("__p", "__q").applyInArrow(one, schema)
