"""Feature rows packed as matrices, and sums over all of them in one job.

Iterative fits read the same rows many times.  They are packed once: a row of the packed table is
a block of up to ``BLOCK_ROWS`` feature rows as the bytes of a matrix, which a task maps without
decoding a list.  A pass sends one short vector per task; where these are over a few bytes for
the driver, which gets them in every pass, they are added up in Spark first, ``FAN`` to a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from trialframe.plans.arrays import to_matrix

BLOCK_ROWS = 1 << 13
#: Smaller tasks than this are put together: a pass over them costs more than their work.
TASK_BYTES = 1 << 22
#: Numbers that a task makes from its rows in a pass; tasks with more are cut, up to one for each core.
TASK_CELLS = 1 << 23
#: Bytes of task results that may come to the driver in one pass (one vector may be longer), and in
#: one cell: hundreds of passes follow each other, so what reaches the driver must not grow by tasks.
DRIVER_BYTES = 1 << 20
CELL_BYTES = 1 << 24
#: Vectors that one task adds up.
FAN = 64

#: What a task does: blocks of (hashes, rows) in, a vector out.
Work = Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], np.ndarray]
Merge = Callable[[list[np.ndarray]], np.ndarray]


def added(parts: list[np.ndarray]) -> np.ndarray:
    return np.sum(parts, axis=0)


@dataclass
class Blocks:
    frame: DataFrame  # h binary (64-bit hashes), x binary (float64 rows)
    width: int
    tasks: int

    def reduce(self, work: Work, merge: Merge = added, size: int = 1) -> np.ndarray:
        """``merge`` of the vectors that ``work`` gives per task; about ``size`` numbers each.

        Merging must not depend on grouping.  Vectors are cut into cells, so they may be long;
        only vectors that fit a cell may change their length by merging.
        """
        width, cell_bytes = self.width, CELL_BYTES

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for h, x in zip(batch.column(0), batch.column(1)):
                    yield (np.frombuffer(h.as_buffer(), "int64"),
                           np.frombuffer(x.as_buffer(), "float64").reshape(-1, width))

        def cells(task: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
            data = np.ascontiguousarray(v, "float64").tobytes()
            cut = [data[i:i + cell_bytes] for i in range(0, max(len(data), 1), cell_bytes)]
            for i, c in enumerate(cut):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task], pa.int64()), pa.array([i], pa.int64()), pa.array([c], pa.binary())],
                    names=["task", "cell", "s"])

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            yield from cells(TaskContext.get().partitionId(), work(rows(batches)))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for cell, s in zip(batch.column(1).to_pylist(), batch.column(2)):
                    have.setdefault(cell, []).append(np.frombuffer(s.as_buffer(), "float64"))
                    if len(have[cell]) > 8:
                        have[cell] = [merge(have[cell])]
            for cell, parts in have.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int64()), pa.array([cell], pa.int64()),
                     pa.array([merge(parts).tobytes()], pa.binary())], names=["task", "cell", "s"])

        ddl = "task long, cell long, s binary"
        found, many = self.frame.mapInArrow(first, ddl), self.tasks
        while many > 1 and many * size * 8 > DRIVER_BYTES:
            many = 1 if many <= FAN else max(math.isqrt(many - 1) + 1, many // FAN)
            found = (found.repartition(many, "task").sortWithinPartitions("task", "cell").mapInArrow(again, ddl)
                     .withColumn("task", F.spark_partition_id().cast("long")))
        parts: dict[int, list[np.ndarray]] = {}
        for r in sorted(found.collect(), key=lambda r: (r["task"], r["cell"])):
            parts.setdefault(r["cell"], []).append(np.frombuffer(r["s"], "float64"))
        return np.concatenate([merge(v) for _, v in sorted(parts.items())]) if parts else np.zeros(0)

    def release(self) -> None:
        self.frame.unpersist()


def pack(frame: DataFrame, n: int, width: int, cells: int = 0) -> Blocks:
    """Blocks of a frame of (h long, x array<double>) with about ``n`` rows, kept in memory or on disk.

    ``cells``: numbers that a pass makes of a row.  The rows of several tasks are dealt out by
    their values, however the source is split.  Lost blocks are made again from the source.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            x = to_matrix(batch.column(1), width)
            for i in range(0, len(h), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[i:i + BLOCK_ROWS].tobytes()], pa.binary()),
                     pa.array([x[i:i + BLOCK_ROWS].tobytes()], pa.binary())], names=["h", "x"])

    cores = frame.sparkSession.sparkContext.defaultParallelism
    useful = max(1, n * max(width, 1) * 8 // TASK_BYTES, min(cores, n * cells // TASK_CELLS))
    if cells and useful > 1:
        packed = frame.repartition(useful, *frame.columns).mapInArrow(blocks, "h binary, x binary")
    else:
        packed = frame.mapInArrow(blocks, "h binary, x binary").coalesce(useful)
    packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
    packed.count()
    return Blocks(packed, width, packed.rdd.getNumPartitions())
