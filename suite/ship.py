"""Send the library to the workers, which may not have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: zip the package on the driver and let Spark deal it out."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    folder = tempfile.mkdtemp(prefix="trialframe-")
    path = os.path.join(folder, "trialframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "trialframe").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
