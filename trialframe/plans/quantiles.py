"""Exact, linearly interpolated quantiles at any scale.

The built-in ``percentile`` is exact, but its buffer holds every distinct value of a group
in one task.  Ranks are bracketed instead, with nothing but small tables moving:

1. ``percentile_approx`` gives, for every wanted rank, two values that are sure to enclose
   it (the sketch has a guaranteed rank error).  A sketch depends on the order in which it is
   merged, so the brackets are written once and read by both scans that follow;
2. one scan counts what lies below each bracket and fills ``CELLS`` equal-width cells in it;
3. one scan keeps only the values in the cells where the wanted ranks fall, collapsed to
   (value, count); a window over these few rows finds the exact order statistics.

A value that fills a third of all rows collapses to one row on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col
from trialframe.plans.joins import join_keyed
from trialframe.plans.lineage import written
from trialframe.plans.onepass import long_form, per_variable

ACCURACY = 20_000
CELLS = 1_000


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """(by…, variable, q array<double>), one entry of ``q`` per probability.

    A variable without values gives null.
    """
    by, probs = list(by), [float(p) for p in probs]
    keys = [*[col(b) for b in by], F.col("variable")]
    names = [*by, "variable"]
    long = long_form(df, cols, by)
    slack = 2.0 / ACCURACY
    edges = [e for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    # One plain aggregation, also for groups without values: they keep a row, with null quantiles.
    grid = F.array(*[F.lit(e) for e in edges])
    all_groups = written(per_variable(df, cols, {
        "n": F.count, "vmin": F.min, "vmax": F.max,
        "e": lambda c: F.percentile_approx(c, grid, ACCURACY),
    }, by).drop("position"))
    sketch = all_groups.filter(F.col("n") > 0)
    # Few values: take everything, so that both neighbours of a rank are surely inside.
    few = F.col("n") <= 4 * ACCURACY
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.floor((F.col("n") - 1) * F.lit(p)).cast("long").alias("k"),
                ((F.col("n") - 1) * F.lit(p)).alias("pos"),
                F.when(few, F.col("vmin")).otherwise(F.col("e")[2 * i]).alias("lo"),
                F.when(few, F.col("vmax")).otherwise(F.col("e")[2 * i + 1]).alias("hi"),
            )
            for i, p in enumerate(probs)
        ]
    )
    brackets = sketch.select(*keys, "n", F.inline(wanted))

    # One row per (group, variable) again, so that the scan is not multiplied by the ranks.
    packed = brackets.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("b")
    )
    cell = F.when(
        F.col("hi") > F.col("lo"),
        F.least(
            F.lit(CELLS - 1),
            F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS),
        ),
    ).otherwise(0)
    placed = (
        join_keyed(long, packed, names)
        .select(*keys, "value", F.inline("b"))
        .filter(F.col("value") <= F.col("hi"))
        .withColumn("cell", F.when(F.col("value") < F.col("lo"), -1).otherwise(cell).cast("int"))
    )
    counted = placed.groupBy(*keys, "i", "cell").agg(F.count("*").alias("m"))
    w = Window.partitionBy(*keys, "i").orderBy("cell")
    cumulated = counted.withColumn("upto", F.sum("m").over(w)).withColumn(
        "before", F.col("upto") - F.col("m")
    )
    ranks = brackets.select(*keys, "i", "k", "n", "pos")
    # The cells in which rank k or k + 1 falls.
    hit = written(
        join_keyed(cumulated, ranks, [*names, "i"])
        .filter((F.col("before") <= F.least(F.col("k") + 1, F.col("n") - 1))
                & (F.col("upto") > F.col("k")))
        .filter(F.col("cell") >= 0)
        .select(*keys, "i", "cell", "before", "k", "n", "pos")
    )
    values = (
        join_keyed(placed, hit, [*names, "i", "cell"])
        .groupBy(*keys, "i", "cell", "value", "before", "k", "n", "pos")
        .agg(F.count("*").alias("m"))
    )
    inner = Window.partitionBy(*keys, "i", "cell").orderBy("value")
    ranked = values.withColumn("upto", F.col("before") + F.sum("m").over(inner))
    at = F.col("upto") - F.col("m")
    upper = F.least(F.col("k") + 1, F.col("n") - 1)
    found = ranked.groupBy(*keys, "i").agg(
        F.max(F.when((at <= F.col("k")) & (F.col("upto") > F.col("k")), F.col("value"))).alias("a"),
        F.max(F.when((at <= upper) & (F.col("upto") > upper), F.col("value"))).alias("b"),
    )
    # A rank that was not found would mean a broken sketch: fail rather than answer wrongly.
    picked = join_keyed(ranks, found, [*names, "i"], "left")
    value = F.when(
        F.col("a").isNull() | F.col("b").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
    ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("k")))
    filled = picked.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]
        ).alias("q")
    )
    empty = all_groups.filter(F.col("n") == 0).select(
        *keys, F.lit(None).cast("array<double>").alias("q"))
    return filled.unionByName(empty)


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, variable, median)."""
    rows = exact_quantiles(df, cols, [0.5], by)
    return rows.select(*[col(b) for b in by], "variable", F.col("q")[0].alias("median"))
