"""Describing, testing, naming and exporting phenotypes (clusters of participants)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col, num, split_columns
from trialframe.functions.shape import cramers_v, effect_band, eta_squared, ratio
from trialframe.functions.tails import chi2_pvalue
from trialframe.operators.features import Features
from trialframe.operators.groups import anova
from trialframe.operators.reduce import pca
from trialframe.plans.joins import join_keyed
from trialframe.plans.onepass import long_strings, per_variable

CHARACTERIZATION_SCHEMA = (
    "Variable string, TestType string, Statistic double, PValue double, "
    "CorrectedPValue double, RejectNullFDR boolean, EffectSize double"
)


def phenotype_profile(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """(label, variable, n, mean, std n−1): one row per phenotype and variable."""
    stats = per_variable(
        df.filter(col(label).isNotNull()), cols,
        {"rows": lambda c: F.count(F.lit(1)), "mean": F.avg, "std": F.stddev_samp}, [label],
    )
    return stats.select(
        col(label).alias("phenotype"), "variable", F.col("rows").alias("n"), "mean", "std"
    )


def phenotype_profile_wide(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """One row per phenotype: N_Samples and ``<c>_mean``, ``<c>_std`` of every variable."""
    return df.filter(col(label).isNotNull()).groupBy(col(label).alias("Phenotype")).agg(
        F.count("*").alias("N_Samples"),
        *[
            fn(num(c)).alias(f"{c}_{name}")
            for c in cols
            for name, fn in (("mean", F.avg), ("std", F.stddev_samp))
        ],
    )


def compare_phenotypes(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """(variable, f_statistic, p_value, eta_squared, significant, effect), smallest p first."""
    return anova(df, cols, label).select(
        "variable", "f_statistic", "p_value", "eta_squared", "significant",
        effect_band(F.col("eta_squared")).alias("effect"),
    ).orderBy(F.asc_nulls_last("p_value"), F.desc("eta_squared"))


def count_significant(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count("*").alias("n_variables"),
        F.count(F.when(F.col("significant"), 1)).alias("n_significant"),
    )


def zscore_profile(df: DataFrame, label: str, cols: Sequence[str], top: int = 20) -> DataFrame:
    """(phenotype, variable, z, rank): (cluster mean − mean) / std n−1, for the variables that
    vary most across clusters.  One pass: overall moments follow from the cluster moments."""
    stats = per_variable(
        df.filter(col(label).isNotNull()), cols,
        {"n": F.count, "m": F.avg, "ss": lambda c: F.var_pop(c) * F.count(c)}, [label],
    ).filter("n > 0")
    grand = stats.groupBy("variable").agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
    )
    both = stats.join(grand, "variable")
    spread = both.groupBy("variable").agg(
        F.sqrt(ratio(
            F.sum(F.col("ss") + F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2))),
            F.first("total") - 1,
        )).alias("std")
    ).filter("std > 0")
    z = both.join(spread, "variable").select(
        col(label).alias("phenotype"), "variable",
        ((F.col("m") - F.col("grand")) / F.col("std")).alias("z"),
    )
    ranked = z.groupBy("variable").agg(F.coalesce(F.var_samp("z"), F.lit(0.0)).alias("v"))
    w = Window.orderBy(F.desc("v"), "variable")  # one row per variable
    best = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return z.join(best.select("variable", "rank"), "variable").select(
        "phenotype", "variable", "z", "rank"
    )


def radar_data(
    df: DataFrame, label: str, cols: Sequence[str], comparison: DataFrame | None = None,
    top: int = 8,
) -> DataFrame:
    """(phenotype, variable, mean_scaled): mean z-score (σ population) per cluster of the
    variables with the largest η² (or the first ones, without a comparison)."""
    if comparison is not None:
        best = comparison.orderBy(F.desc("eta_squared"), "variable").limit(top)
        cols = [r["variable"] for r in best.select("variable").collect()]
    else:
        cols = list(cols)[:top]
    stats = per_variable(
        df.filter(col(label).isNotNull()), cols,
        {"n": F.count, "m": F.avg, "ss": lambda c: F.var_pop(c) * F.count(c)}, [label],
    ).filter("n > 0")
    grand = stats.groupBy("variable").agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
    )
    both = stats.join(grand, "variable")
    spread = both.groupBy("variable").agg(
        F.sqrt(
            F.sum(F.col("ss") + F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2)))
            / F.first("total")
        ).alias("sd")
    )
    scaled = (F.col("m") - F.col("grand")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return both.join(spread, "variable").select(
        col(label).alias("phenotype"), "variable", scaled.alias("mean_scaled")
    )


def cluster_scatter(feats: Features, labelled: DataFrame, label: str) -> DataFrame:
    """(id, PC1, PC2, label): the first two components of the scaled features."""
    wide = labelled.select(
        col(feats.id_col), col(label),
        *[F.col("x")[i].alias(c) for i, c in enumerate(feats.names)],
    )
    return pca(wide, feats.names, 2, False, feats.id_col, [label]).scores


def phenotype_names(label: Column, names: Mapping[int, str] | None = None) -> Column:
    """Given names, else ``Phenotype_<n + 1>``."""
    default = F.format_string("Phenotype_%d", label + 1)
    if not names:
        return default
    table = F.create_map(*[v for k, n in names.items() for v in (F.lit(k), F.lit(n))])
    return F.coalesce(F.element_at(table, label), default)


def assignments(
    labelled: DataFrame, method: str, k: int, cols: Sequence[str], id_col: str,
    names: Mapping[int, str] | None = None,
) -> DataFrame:
    """id, clustering columns, Phenotype, Phenotype_Name and, for mixtures, one probability each."""
    name = f"{method}_{k}"
    if name not in labelled.columns:
        raise ValueError(f"no clustering {name}: run it first")
    chance = f"{name}_probability"
    extra = (
        [F.col(chance)[i].alias(f"Phenotype_{i + 1}_Probability") for i in range(k)]
        if chance in labelled.columns
        else []
    )
    return labelled.select(
        col(id_col), *[col(c) for c in cols], col(name).alias("Phenotype"),
        phenotype_names(col(name), names).alias("Phenotype_Name"), *extra,
    )


# ---------------------------------------------------------------- tests by variable


def chi_square(df: DataFrame, variables: Sequence[str], cluster: str) -> DataFrame:
    """(variable, n, n_values, n_clusters, chi2, df, p_value, cramers_v), without continuity
    correction; chi2 is null for a table with one row or one column.

    Only observed cells travel: an empty cell adds its expected count, and the expected counts
    of all cells sum to n.
    """
    cells = long_strings(df.filter(col(cluster).isNotNull()), variables, [cluster]).groupBy(
        "variable", "value", col(cluster).alias("cluster")
    ).agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy("variable", "value").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("variable", "cluster").agg(F.sum("o").alias("c"))
    totals = cols.groupBy("variable").agg(
        F.sum("c").alias("n"), F.count("*").alias("n_clusters")
    )
    heights = rows.groupBy("variable").agg(F.count("*").alias("n_values"))
    # A value has at most one cell per cluster; clusters and variables own many cells.
    full = join_keyed(cells.join(rows, ["variable", "value"]), cols, ["variable", "cluster"])
    full = join_keyed(full, totals.join(heights, "variable"), ["variable"])
    e = F.col("r") * F.col("c") / F.col("n")
    off = F.col("o") - e
    summed = full.groupBy("variable", "n", "n_values", "n_clusters").agg(
        F.sum(off * off / e).alias("seen"), F.sum(e).alias("seen_e"),
        F.count("*").alias("n_cells"),
    )
    empty = F.when(
        F.col("n_cells") < F.col("n_values") * F.col("n_clusters"),
        F.greatest(F.col("n") - F.col("seen_e"), F.lit(0.0)),
    ).otherwise(0.0)
    free = (F.col("n_values") - 1) * (F.col("n_clusters") - 1)
    table = summed.select(
        "variable", F.col("n").cast("long").alias("n"), "n_values", "n_clusters",
        F.when(free > 0, F.col("seen") + empty).alias("chi2"),
        free.alias("df"),
    )
    v = cramers_v(F.col("chi2"), F.col("n"), F.col("n_values"), F.col("n_clusters"))
    return table.withColumn(
        "p_value", F.when(F.col("chi2").isNotNull(), chi2_pvalue(F.col("chi2"), F.col("df")))
    ).withColumn("cramers_v", v)


def benjamini_hochberg(
    tests: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """Adds corrected_p = min over larger p of p·m / rank (at most 1) and reject; missing p stay
    missing and do not count.  Families of tests (``by``) are result tables: a row per test."""
    keys = [col(b) for b in by]
    has = col(p).isNotNull() & ~F.isnan(col(p))
    up = Window.partitionBy(*keys, has).orderBy(col(p))
    whole = Window.partitionBy(*keys, has)
    ranked = tests.withColumn("__rank", F.row_number().over(up)).withColumn(
        "__m", F.count("*").over(whole)
    ).withColumn("__q", col(p) * F.col("__m") / F.col("__rank"))
    down = Window.partitionBy(*keys, has).orderBy(F.desc("__rank")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    adjusted = F.when(has, F.least(F.min("__q").over(down), F.lit(1.0)))
    out = ranked.withColumn("corrected_p", adjusted)
    return out.withColumn("reject", F.col("corrected_p") <= alpha).drop("__rank", "__m", "__q")


def compare_variable(df: DataFrame, variable: str, cluster: str = "Cluster") -> DataFrame:
    """One row of (Variable, TestType, Statistic, PValue, EffectSize) for one variable."""
    return characterize(df, cluster, [variable]).drop("CorrectedPValue", "RejectNullFDR")


def characterize(
    df: DataFrame, cluster: str, variables: Sequence[str], alpha: float = 0.05
) -> DataFrame:
    """Tests every variable across clusters and corrects for the number of tests.

    Numeric: one-way ANOVA with η²; otherwise chi-square with Cramér's V.  TestType tells
    what could not be tested: InsufficientClusters (one cluster), ANOVA_NotEnoughGroups (fewer
    than two groups with two values each; groups with one value are left out of the test), ANOVA_NoVarianceOrSameMean (F 0, p 1, effect 0),
    ChiSquare_SmallTable, Error_VariableNotFoundInSource.
    """
    spark = df.sparkSession
    if not variables or cluster not in df.columns:
        return spark.createDataFrame([], CHARACTERIZATION_SCHEMA)
    numeric, _ = split_columns(df, cluster)
    nums = [v for v in variables if v in numeric]
    cats = [v for v in variables if v in df.columns and v not in numeric]
    absent = [v for v in variables if v not in df.columns]
    nan = F.lit(math.nan)
    there = df.filter(col(cluster).isNotNull())
    base = there.select(col(cluster).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    clusters = base.limit(2).count()
    if clusters == 0:
        return spark.createDataFrame([], CHARACTERIZATION_SCHEMA)
    parts = []

    def constant(names: Sequence[str], kind: str) -> DataFrame:
        return spark.createDataFrame(
            [(v, kind, math.nan, math.nan, math.nan) for v in names],
            "Variable string, TestType string, Statistic double, PValue double, "
            "EffectSize double",
        )

    if absent:
        parts.append(constant(absent, "Error_VariableNotFoundInSource"))
    if clusters < 2 and (nums or cats):
        parts.append(constant([*nums, *cats], "InsufficientClusters"))
        nums, cats = [], []
    if nums:
        # A cluster with one value says nothing about spread; the others are tested.
        table = anova(there, nums, cluster, min_values=2)
        groups = per_variable(there, nums, {"n": F.count}, [cluster]).groupBy("variable").agg(
            F.count(F.when(F.col("n") >= 2, 1)).alias("filled"),
        )
        joined = groups.join(table, "variable", "left")
        few = F.col("filled") < 2
        # No spread at all, or the same mean everywhere but for rounding: nothing differs.
        flat = F.coalesce(
            F.col("ss_between") <= 1e-12 * (F.col("ss_between") + F.col("ss_within")), F.lit(True)
        )
        kind = (
            F.when(few, "ANOVA_NotEnoughGroups").when(flat, "ANOVA_NoVarianceOrSameMean")
            .otherwise("ANOVA")
        )
        # Spread between groups only: F is infinite and p is 0.
        f = F.coalesce("f_statistic", F.lit(math.inf))
        eta = F.when(
            F.col("f_statistic").isNotNull(),
            eta_squared(F.col("f_statistic"), F.col("df_between"), F.col("df_within")),
        ).otherwise(1.0)
        parts.append(
            joined.select(
                F.col("variable").alias("Variable"),
                kind.alias("TestType"),
                F.when(few, nan).when(flat, 0.0).otherwise(f).alias("Statistic"),
                F.when(few, nan).when(flat, 1.0)
                .otherwise(F.coalesce("p_value", F.lit(0.0))).alias("PValue"),
                F.when(few, nan).when(flat, 0.0).otherwise(eta).alias("EffectSize"),
            )
        )
    if cats:
        table = chi_square(there, cats, cluster)
        every = spark.createDataFrame([(v,) for v in cats], "variable string")
        joined = every.join(table, "variable", "left")
        small = F.col("chi2").isNull()
        parts.append(
            joined.select(
                F.col("variable").alias("Variable"),
                F.when(small, "ChiSquare_SmallTable").otherwise("Chi-Square").alias("TestType"),
                F.when(small, nan).otherwise(F.col("chi2")).alias("Statistic"),
                F.when(small, nan).otherwise(F.col("p_value")).alias("PValue"),
                F.when(small, nan).otherwise(F.col("cramers_v")).alias("EffectSize"),
            )
        )
    tests = parts[0]
    for more in parts[1:]:
        tests = tests.unionByName(more)
    corrected = benjamini_hochberg(tests, "PValue", alpha)
    return corrected.select(
        "Variable", "TestType", "Statistic", "PValue",
        F.coalesce("corrected_p", nan).alias("CorrectedPValue"),
        F.col("reject").alias("RejectNullFDR"), "EffectSize",
    )


def characterize_labels(
    data: DataFrame, labels: DataFrame, id_col: str, variables: Sequence[str],
    label: str = "Cluster",
) -> DataFrame:
    """``characterize`` for labels in a table of their own, joined by id."""
    joined = data.join(labels.select(col(id_col), col(label)), id_col)
    return characterize(joined, label, variables)

