"""The numeric matrix that clustering works on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from trialframe.columns import col, num, resolve_columns
from trialframe.plans.onepass import fitted, per_variable

# Baseline characteristics that clustering uses unless told otherwise.
DEFAULT_CLUSTERING_COLUMNS = [
    "History.Age", "BMI", "History.Gender", "History.Race", "Education",
    "Marital.status", "Index.knee", "Klscore.total", "OAmonth",
    "NRS.Average.Daily.0", "WOMAC.Pain.0", "WOMAC.Stiffness.0",
    "WOMAC.Functional.0", "HPTH.Knee.0", "HPTO.Knee.0", "HPTH.Arm.0",
    "HPTO.Arm.0", "PPT.Knee.Medial.0", "PPT.Trapezius.0",
    "Punctate.10Series.patella.0", "PMS.TS.Patella.0",
    "Punctate.10Series.hand.0", "PMS.TS.hand.0", "CPM.30sec.0",
    "CPM.60sec.0", "ColdPain.0",
]


@dataclass
class Features:
    """``frame``: id, the imputed columns and ``x`` (z-scored array<double>)."""

    frame: DataFrame
    names: list[str]
    id_col: str
    n: int
    low: float = 0.0  # smallest and largest scaled value: the box of the gap statistic
    high: float = 0.0
    box: list[tuple[float, float]] = field(default_factory=list)
    cached: bool = False

    @property
    def width(self) -> int:
        return len(self.names)

    def release(self) -> None:
        if self.cached:
            self.frame.unpersist()


def clustering_columns(df: DataFrame, id_col=None) -> list[str]:
    """The default columns that the table has, else all numeric ones."""
    have = [c for c in DEFAULT_CLUSTERING_COLUMNS if c in df.columns]
    return have or resolve_columns(df, None, id_col)


def prepare_features(
    df: DataFrame, id_col: str, cols: Sequence[str] | None = None, cache: bool = True
) -> Features:
    """Numeric columns → drop all-null → mean-impute → drop constant → z-score (σ population).

    One aggregation decides everything: imputing the mean leaves the mean, and the variance
    after imputation is the sum of squares over all rows.
    """
    chosen = resolve_columns(df, cols, id_col)
    fit, n = {}, 0
    if chosen:
        stats = fitted(
            per_variable(
                df,
                chosen,
                {
                    "rows": lambda c: F.count(F.lit(1)),
                    "n": F.count,
                    "m": F.avg,
                    "v": F.var_pop,
                    "lo": F.min,
                    "hi": F.max,
                },
            )
        )
        n = stats[chosen[0]]["rows"]
        for c in chosen:
            r = stats[c]
            if r["n"] and r["lo"] < r["hi"]:
                fit[c] = (r["m"], (r["v"] * r["n"] / r["rows"]) ** 0.5, r["lo"], r["hi"])
    names = [c for c in chosen if c in fit]
    filled = df.select(
        col(id_col), *[F.coalesce(num(c), F.lit(fit[c][0])).alias(c) for c in names]
    )
    x = F.array(*[(col(c) - fit[c][0]) / fit[c][1] for c in names]) if names else (
        F.array().cast("array<double>")
    )
    frame = filled.withColumn("x", x)
    box = [((fit[c][2] - fit[c][0]) / fit[c][1], (fit[c][3] - fit[c][0]) / fit[c][1])
           for c in names]
    out = Features(
        frame, names, id_col, n,
        min((b[0] for b in box), default=0.0), max((b[1] for b in box), default=0.0), box,
    )
    if cache and names:
        # Many passes follow.  Lost blocks are computed again from the source.
        out.frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        out.cached = True
    return out
