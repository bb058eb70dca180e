"""Cutting the lineage of iterative work, so that a lost executor costs one round only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    ``spark.checkpoint.dir`` is the cluster's setting.  Only where nothing is set (tests on
    one machine) a temporary folder is used; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trialframe-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A table of the shared folder in place of ``df``: computed once, its size known to Spark."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete those that ``written`` made; no later step may read them."""
    for t in tables:
        if t is not None and hasattr(t, "_written_to"):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
