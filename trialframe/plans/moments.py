"""Correlation and covariance of many columns.

One Arrow pass for any number of columns: each task multiplies its batches, shifted by the
means (counts, sums and cross products of all pairs at once), and sends one p × p summary on;
Spark adds the summaries.  Pairwise complete; what moves is a summary per task, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.columns import num
from trialframe.plans.onepass import fitted, per_variable


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, var1, var2, n, r) for all i < j in column order; r is null when undefined."""
    p = len(cols)
    if p < 2:
        raise ValueError("correlation needs two columns")
    means = fitted(per_variable(df, cols, {"m": F.avg}))
    shift = np.array([means[c]["m"] or 0.0 for c in cols])
    schema = "i int, j int, n double, si double, sj double, qi double, qj double, x double"
    upper = np.triu_indices(p, 1)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((p, p))
        s, sq, cross = n.copy(), n.copy(), n.copy()
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan) - shift
            present = ~np.isnan(x)
            x = np.where(present, x, 0.0)
            m = present.astype("float64")
            n += m.T @ m
            s += x.T @ m
            sq += (x * x).T @ m
            cross += x.T @ x
        i, j = upper
        yield pd.DataFrame(
            {
                "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j],
                "si": s[i, j], "sj": s[j, i], "qi": sq[i, j], "qj": sq[j, i], "x": cross[i, j],
            }
        )

    partial = df.select(*[num(c).alias(f"c{k}") for k, c in enumerate(cols)]).mapInPandas(
        summarise, schema
    )
    total = partial.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "x")]
    )
    vi = F.col("n") * F.col("qi") - F.col("si") * F.col("si")
    vj = F.col("n") * F.col("qj") - F.col("sj") * F.col("sj")
    cov = F.col("n") * F.col("x") - F.col("si") * F.col("sj")
    floor = 1e-12 * F.col("n")
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(
        "i",
        "j",
        names[F.col("i")].alias("var1"),
        names[F.col("j")].alias("var2"),
        F.col("n").cast("long").alias("n"),
        F.when(
            (vi > floor * F.col("qi")) & (vj > floor * F.col("qj")), cov / F.sqrt(vi * vj)
        ).alias("r"),
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Square numpy matrix (p × p, bounded by the schema); undefined entries are NaN."""
    p = len(cols)
    r = np.eye(p)
    if p > 1:
        for row in correlations(df, cols).select("i", "j", "r").collect():
            r[row["i"], row["j"]] = r[row["j"], row["i"]] = (
                np.nan if row["r"] is None else row["r"]
            )
    return r
