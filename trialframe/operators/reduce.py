"""PCA and factor analysis of mixed data.

MLlib finds the components from the covariance (one aggregation of p × p numbers).  Columns
are centred and scaled beforehand by expressions, since MLlib's PCA does not centre what it
transforms.  Where categorical variables have many levels, the covariance is not formed
(``levels.py``).  Scores stay with their rows and ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.columns import col, complete_cases, num, resolve_columns, split_columns
from trialframe.functions.shape import correlation_of, ratio
from trialframe.operators.levels import fit_levels, fit_one_large
from trialframe.plans.lineage import written
from trialframe.plans.onepass import fitted, long_strings, per_variable
from trialframe.sources.dictionary import describe_variables

#: More levels than this in total are analysed without their covariance; results are equal.
COVARIANCE_LEVELS = 1_000
#: Features beside one variable of many levels whose means by level are taken in a table.
OTHER_FEATURES = 128
#: Levels of several variables of many levels, which the driver holds.
DRIVER_LEVELS = 200_000


@dataclass
class Reduction:
    """A fitted reduction.  ``scores``: id (and carried columns) with PC1… or Dim1…"""

    scores: DataFrame
    loadings: DataFrame  # variable, component int, loading
    variance: DataFrame  # component int, explained_variance, cumulative_variance
    prefix: str
    n_components: int
    samples_used: int


# Fixed value: the error text that callers of FAMD expect when no row is complete.
NO_ROWS = "No data remaining for FAMD after removing rows with missing values."


def _variance_table(df: DataFrame, ratios: Sequence[float]) -> DataFrame:
    rows, total = [], 0.0
    for i, r in enumerate(ratios, 1):
        total += float(r)
        rows.append((i, float(r), total))
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_variance double, cumulative_variance double"
    )


def _fit(
    base: DataFrame, keep: Sequence[str], features: Sequence[tuple[str, Column]],
    k: int, prefix: str, n: int,
):
    """MLlib PCA of feature expressions; the sign makes the largest loading positive."""
    wide = base.select(
        *[col(c) for c in keep], *[e.alias(f"__f{i}") for i, (_, e) in enumerate(features)]
    )
    names = [f"__f{i}" for i in range(len(features))]
    vectors = VectorAssembler(inputCols=names, outputCol="__x").transform(wide).select(
        *[col(c) for c in keep], "__x"
    )
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(vectors)
    weights = np.array(model.pc.toArray())
    signs = np.sign(weights[np.abs(weights).argmax(axis=0), range(k)])
    signs[signs == 0] = 1.0
    parts = vector_to_array("__pc")
    scores = model.transform(vectors).select(
        *[col(c) for c in keep],
        *[(parts[i] * float(signs[i])).alias(f"{prefix}{i + 1}") for i in range(k)],
    )
    return scores, weights * signs, model.explainedVariance.toArray()


def pca(
    df: DataFrame,
    cols=None,
    k: int | None = None,
    standardize: bool = True,
    id_col: str | None = None,
    carry: Sequence[str] = (),
) -> Reduction:
    """PCA of numeric columns on complete cases; k defaults to min(n − 1, p)."""
    keep = [*([id_col] if id_col else []), *carry]
    cols = resolve_columns(df, cols, keep)
    if not cols:
        raise ValueError("no numeric variable for PCA")
    whole = complete_cases(df, cols)
    fit = fitted(per_variable(whole, cols, {"n": F.count, "m": F.avg, "s": F.stddev_pop}))
    n = fit[cols[0]]["n"]
    if not n:
        raise ValueError("no complete case for PCA")
    k = max(1, min(k or len(cols), n - 1, len(cols)))
    features = [
        (c, (num(c) - fit[c]["m"]) / ((fit[c]["s"] or 1.0) if standardize else 1.0))
        for c in cols
    ]
    scores, weights, ratios = _fit(whole, keep, features, k, "PC", n)
    rows = [
        (c, j + 1, float(weights[i, j])) for i, c in enumerate(cols) for j in range(k)
    ]
    loadings = df.sparkSession.createDataFrame(
        rows, "variable string, component int, loading double"
    )
    return Reduction(scores, loadings, _variance_table(df, ratios), "PC", k, n)


def famd(
    df: DataFrame,
    num_cols=None,
    cat_cols=None,
    k: int = 10,
    id_col: str | None = None,
    covariance_levels: int = COVARIANCE_LEVELS,
    max_levels: int | None = None,
) -> Reduction:
    """FAMD (Pagès 2004) on complete cases: PCA of z-scored numeric columns together with
    indicators (1[x = level] − p) / √p.

    Up to ``covariance_levels`` levels in total the components come from the covariance, beyond it
    without it.  One variable may have any number of levels, which stay in a table; where several
    have many, or ``k`` asks for more than the other features tell apart, the components come from
    products with the covariance, to a residual of 1e-9, the driver holds about 15 (k + 8) numbers a
    level, and more than ``DRIVER_LEVELS`` are an error, as are more than ``max_levels`` in any case.

    The loadings are the variable coordinates: the correlation with each dimension for a
    numeric variable, the correlation ratio η² for a categorical one.
    """
    keep = [id_col] if id_col else []
    numeric, categorical = split_columns(df, keep)
    nums = [c for c in (num_cols if num_cols is not None else numeric) if c in df.columns]
    cats = [c for c in (cat_cols if cat_cols is not None else categorical) if c in df.columns]
    whole = complete_cases(df, [*nums, *cats])
    n = whole.count()
    if not n:
        raise ValueError(NO_ROWS)
    features: list[tuple[str, Column]] = []
    if nums:
        fit = fitted(per_variable(whole, nums, {"m": F.avg, "s": F.stddev_pop}))
        for c in nums:
            if fit[c]["s"]:
                features.append((c, (num(c) - fit[c]["m"]) / fit[c]["s"]))
    levels: list[tuple[str, str, int]] = []
    sizes: dict[str, int] = {}
    if cats:
        counted = written(long_strings(whole, cats).groupBy("variable", "value").agg(
            F.count("*").alias("m")))
        sizes = {r["variable"]: r["l"] for r in counted.groupBy("variable").agg(
            F.count("*").alias("l")).collect()}
    total = sum(sizes.values())
    if max_levels is not None and total > max_levels:
        raise ValueError(
            f"more than {max_levels} levels: an id-like column does not belong in FAMD"
        )
    carried = [*keep, *[c for c in (*nums, *cats)]]
    if total > covariance_levels:
        large = max(sorted(sizes), key=sizes.get)
        others = len(features) + total - sizes[large]
        found = None
        if others <= OTHER_FEATURES:
            rest = counted.where(F.col("variable") != large).collect()
            found = fit_one_large(
                whole, carried, [e for _, e in features], cats, large, sorted(tuple(r) for r in rest), total,
                max(1, min(k, others + sizes[large] - len(cats), n - 1)), n, "Dim")
        if found is not None:
            scores, ratios = found
            k = len(ratios)
            return Reduction(
                scores.select(*[col(c) for c in keep], *[f"Dim{i + 1}" for i in range(k)]),
                _coordinates(scores, nums, cats, k), _variance_table(df, ratios), "Dim", k, n)
        if total > DRIVER_LEVELS:
            raise ValueError(f"more than {DRIVER_LEVELS} levels in several variables or for {k} components")
    if cats:
        levels = sorted(tuple(r) for r in counted.collect())
    if not features and not levels:
        raise ValueError("no variable with spread for FAMD")
    rank = len(features) + len(levels) - len(cats)
    k = max(1, min(k, rank, n - 1))
    if len(levels) > covariance_levels:
        scores, ratios = fit_levels(
            whole, carried, [e for _, e in features], cats, levels, k, n, "Dim")
    else:
        for name, value, m in levels:
            share = m / n
            mark = (col(name).cast("string") == F.lit(value)).cast("double")
            features.append((name, (mark - share) / share**0.5))
        scores, _, ratios = _fit(whole, carried, features, k, "Dim", n)
    coordinates = _coordinates(scores, nums, cats, k)
    return Reduction(
        scores.select(*[col(c) for c in keep], *[f"Dim{i + 1}" for i in range(k)]),
        coordinates, _variance_table(df, ratios), "Dim", k, n,
    )


def _coordinates(scores: DataFrame, nums, cats, k: int) -> DataFrame:
    """Correlation (numeric) or correlation ratio (categorical) of each variable and dimension."""
    dims = [f"Dim{i + 1}" for i in range(k)]
    parts = []
    if nums:
        rows = [
            F.struct(
                F.lit(c).alias("variable"),
                F.lit(i + 1).alias("component"),
                correlation_of(num(c), F.col(d)).alias("loading"),
            )
            for c in nums
            for i, d in enumerate(dims)
        ]
        parts.append(scores.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    for c in cats:
        stats = scores.groupBy(col(c)).agg(
            F.count("*").alias("n"),
            *[F.avg(d).alias(f"m_{d}") for d in dims],
            *[(F.var_pop(d) * F.count("*")).alias(f"w_{d}") for d in dims],
        )
        # Scores are centred, so the between part needs no grand mean.
        rows = [
            F.struct(
                F.lit(c).alias("variable"),
                F.lit(i + 1).alias("component"),
                ratio(
                    F.sum(F.col("n") * F.col(f"m_{d}") * F.col(f"m_{d}")),
                    F.sum(F.col("n") * F.col(f"m_{d}") * F.col(f"m_{d}") + F.col(f"w_{d}")),
                ).alias("loading"),
            )
            for i, d in enumerate(dims)
        ]
        parts.append(stats.agg(F.array(*rows).alias("r")).select(F.inline("r")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def optimal_components(variance: DataFrame, threshold: float = 0.75) -> int:
    """First component at which the cumulative share reaches the threshold, else all."""
    row = variance.agg(
        F.coalesce(
            F.min(F.when(F.col("cumulative_variance") >= threshold, F.col("component"))),
            F.max("component"),
            F.lit(0),
        ).alias("k")
    ).first()
    return int(row["k"])


def transform(fit: Reduction, n: int | None = None) -> DataFrame:
    """The scores with only the first n components."""
    n = fit.n_components if n is None else min(n, fit.n_components)
    drop = [f"{fit.prefix}{i}" for i in range(n + 1, fit.n_components + 1)]
    return fit.scores.drop(*drop)


def top_loadings(
    loadings: DataFrame, n: int = 10, dictionary: DataFrame | None = None
) -> DataFrame:
    """The n largest |loading| of every component, with descriptions."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "variable")
    top = loadings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    if dictionary is None:
        return top
    return top.join(describe_variables(loadings, dictionary), "variable", "left")


def signed_loadings(loadings: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest positive and negative loadings of every component."""
    side = F.when(F.col("loading") > 0, "positive").when(F.col("loading") < 0, "negative")
    w = Window.partitionBy("component", "side").orderBy(F.abs("loading").desc(), "variable")
    return (
        loadings.withColumn("side", side).filter(F.col("side").isNotNull())
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    )


def biplot(fit: Reduction, a: int = 1, b: int = 2) -> tuple[DataFrame, DataFrame]:
    """(points: scores of two components, arrows: loadings stretched to 0.8 of the score range)."""
    x, y = f"{fit.prefix}{a}", f"{fit.prefix}{b}"
    keep = [c for c in fit.scores.columns if not c.startswith(fit.prefix) or c in (x, y)]
    pair = (
        fit.loadings.filter(F.col("component").isin(a, b)).groupBy("variable")
        .agg(
            F.max(F.when(F.col("component") == a, F.col("loading"))).alias("lx"),
            F.max(F.when(F.col("component") == b, F.col("loading"))).alias("ly"),
        )
    )
    reach = fit.scores.agg(F.greatest(F.max(F.abs(col(x))), F.max(F.abs(col(y)))).alias("m"))
    size = pair.agg(F.greatest(F.max(F.abs("lx")), F.max(F.abs("ly"))).alias("m"))
    longest = size.first()["m"]
    factor = 0.8 * reach.first()["m"] / longest if longest else 0.0
    arrows = pair.select(
        "variable", (F.col("lx") * factor).alias("x"), (F.col("ly") * factor).alias("y")
    )
    return fit.scores.select(*[col(c) for c in keep]), arrows

