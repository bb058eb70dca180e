"""The two analysis workflows as plain functions: data in, data and result tables out."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.columns import keep_existing, split_columns
from trialframe.operators import cluster as clustering
from trialframe.operators import impute as imputing
from trialframe.operators import quality, reduce, screen, validate
from trialframe.operators import phenotype as pheno
from trialframe.operators.explore import describe_numeric
from trialframe.operators.features import prepare_features
from trialframe.operators.missing import overview
from trialframe.plans.lineage import written
from trialframe.sources.tables import attach_from

STEP_SCHEMA = "step string, key string, value string, at timestamp"


@dataclass
class PrepConfig:
    """Switches and defaults of data preparation."""

    id_col: str
    impute_method: str = "knn"
    knn_neighbors: int = 5
    cols_to_exclude: Sequence[str] = ()
    screen_variables: bool = True
    near_zero_threshold: float = 0.01
    collinearity_threshold: float = 0.85
    vif_threshold: float = 5.0
    force_include: Sequence[str] = ()
    apply_screening: bool = True
    reduce_dimensions: bool = True
    reduction_method: str = "pca"
    n_components: int | None = None
    standardize: bool = True
    variance_threshold: float = 0.75
    apply_reduction: bool = False
    enhance_quality: bool = True
    outlier_method: str = "iqr"
    outlier_threshold: float = 1.5
    apply_transformations: bool = False
    standardize_variables: bool = False
    standardization_method: str = "zscore"
    seed: int = 42


@dataclass
class Journal:
    """What each step did: parameters and counts, for the steps table."""

    rows: list[tuple] = field(default_factory=list)

    def note(self, step: str, **facts) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        for key, value in facts.items():
            text = value if isinstance(value, str) else json.dumps(
                value, default=lambda v: list(v) if isinstance(v, (set, tuple)) else str(v)
            )
            self.rows.append((step, key, text, now))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, STEP_SCHEMA)


def prepare(df: DataFrame, config: PrepConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Impute → screen → reduce → quality, each step optional.

    Returns the processed table and the result tables, among them ``steps``.
    """
    c, journal = config, Journal()
    results: dict[str, DataFrame] = {}
    out = imputing.impute(
        df, c.impute_method, c.id_col, c.knn_neighbors, c.cols_to_exclude
    )
    if c.impute_method == "knn":
        # The search is worth keeping: several passes over its result follow.
        out = out.persist()
    numeric, _ = split_columns(df, c.id_col)
    done = [v for v in numeric if v not in set(c.cols_to_exclude)]
    if done:
        results["imputation"] = imputing.imputation_summary(df, out, done)
    journal.note("imputation", method=c.impute_method, knn_neighbors=c.knn_neighbors,
                 cols_excluded=list(c.cols_to_exclude), columns_before=len(df.columns))
    if c.screen_variables:
        forced = [c.id_col, *c.force_include]
        decisions, summary = screen.recommend_variables(
            out, c.near_zero_threshold, c.collinearity_threshold, c.vif_threshold, forced,
            c.id_col,
        )
        results["screening"], results["screening_summary"] = decisions, summary
        names = screen.recommended_names(decisions)
        if c.apply_screening:
            out = keep_existing(out, [v for v in out.columns if v in set(names)])
        journal.note("screening", applied=c.apply_screening, recommended=len(names),
                     columns_after=len(out.columns), force_include=list(c.force_include))
    if c.reduce_dimensions:
        if c.reduction_method == "pca":
            fit = reduce.pca(out, None, c.n_components, c.standardize, c.id_col)
        elif c.reduction_method == "famd":
            fit = reduce.famd(out, None, None, c.n_components or 10, c.id_col)
        else:
            raise ValueError(f"unknown reduction {c.reduction_method!r}")
        best = reduce.optimal_components(fit.variance, c.variance_threshold)
        results["variance"], results["loadings"] = fit.variance, fit.loadings
        if c.apply_reduction:
            out = reduce.transform(fit, best)
        journal.note("reduction", method=c.reduction_method, optimal_components=best,
                     samples_used=fit.samples_used, applied=c.apply_reduction)
    if c.enhance_quality:
        results["outliers"] = quality.detect_outliers(
            out, c.outlier_method, c.outlier_threshold, None, c.id_col
        )
        shapes = quality.analyze_distributions(out, None, c.id_col, c.seed)
        advice = quality.recommend_transformations(shapes)
        results["distributions"], results["recommendations"] = shapes, advice
        journal.note("quality", outlier_method=c.outlier_method,
                     outlier_threshold=c.outlier_threshold)
        if c.apply_transformations:
            plan = {r["variable"]: r["recommendation"]
                    for r in advice.filter("recommendation <> 'none'").collect()}
            out, results["applied"] = quality.apply_transformations(out, plan, c.id_col)
            journal.note("transformations", applied=plan)
        if c.standardize_variables:
            out, results["scaling"] = quality.standardize(
                out, c.standardization_method, None, c.id_col
            )
            journal.note("standardization", method=c.standardization_method)
    journal.note("result", columns=len(out.columns))
    results["steps"] = journal.table(df.sparkSession)
    return out, results


def steps_summary(steps: DataFrame) -> DataFrame:
    """(step, completed, details): every step of the workflow, done or not."""
    spark = steps.sparkSession
    order = ["imputation", "screening", "reduction", "quality", "transformations",
             "standardization"]
    every = spark.createDataFrame(list(enumerate(order)), "position int, step string")
    facts = steps.groupBy("step").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("details")
    )
    return every.join(facts, "step", "left").select(
        "position", "step", F.col("details").isNotNull().alias("completed"), "details"
    )


def pipeline_report(before: DataFrame, after: DataFrame, steps: DataFrame) -> DataFrame:
    """(section, metric, value): shapes before and after, reduction in columns, step facts."""

    def shape(df: DataFrame, section: str) -> DataFrame:
        o = overview(df)
        cells = F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"))
            for c in o.columns
        ])
        return o.select(F.lit(section).alias("section"), F.inline(cells))

    gone = 100.0 * (len(before.columns) - len(after.columns)) / len(before.columns)
    cut = before.sparkSession.createDataFrame(
        [("change", "column_reduction_pct", f"{gone:.1f}")],
        "section string, metric string, value string",
    )
    facts = steps.select(F.col("step").alias("section"), F.col("key").alias("metric"), "value")
    return shape(before, "original").unionByName(shape(after, "current")).unionByName(
        cut
    ).unionByName(facts)


def report_statistics(after: DataFrame, id_col: str) -> DataFrame:
    """Descriptive statistics of the processed table."""
    return describe_numeric(after, None, id_col)


@dataclass
class Discovery:
    """Results of phenotype discovery."""

    labelled: DataFrame
    metrics: DataFrame
    optimal: DataFrame
    profile: DataFrame
    comparison: DataFrame
    assignments: DataFrame
    method: str
    k: int


def discover(
    df: DataFrame,
    id_col: str,
    cols: Sequence[str] | None = None,
    methods: Sequence[str] = ("kmeans",),
    ks: Sequence[int] = range(2, 7),
    n_init: int = 10,
    seed: int = 42,
    min_cluster_size: int = 10,
    names: Mapping[int, str] | None = None,
    attach: Sequence[str] = (),
    metric: str = "euclidean",
) -> Discovery:
    """Prepare the matrix, cluster, score every k, choose, profile, compare and assign.

    ``metric="sqeuclidean"`` scores by one scan instead of all pairs, for tables on which the
    Euclidean silhouette (quadratic by definition) is out of reach.  The labelled rows are
    written to the shared folder once and all results read them from there.
    """
    feats = prepare_features(df, id_col, cols)
    if not feats.names:
        raise ValueError("no usable numeric feature")
    # Every method adds its columns to the same frame; Ward's labels come by a join, so they are
    # added last and no other fit runs through it.
    whole, criteria = feats, dict.fromkeys(methods)
    for method in sorted(criteria, key=lambda m: m == "agglomerative"):
        frame, criteria[method] = clustering.cluster(whole, method, ks, n_init, seed)
        whole = replace(whole, frame=frame)
    labelled = written(whole.frame)
    feats.release()
    metrics = clustering.metrics_of_methods(labelled, criteria, ks, id_col, feats.width, metric)
    optimal = validate.optimal_k(metrics, min_cluster_size)
    best = optimal.filter("optimal_k is not null").orderBy(F.desc("silhouette")).first()
    if best is None:
        raise ValueError(f"no k has clusters of at least {min_cluster_size} rows")
    method, k = best["method"], best["optimal_k"]
    label = f"{method}_{k}"
    table = pheno.assignments(labelled, method, k, feats.names, id_col, names)
    if attach:
        table = attach_from(table, df, id_col, attach)
    return Discovery(
        labelled,
        metrics,
        optimal,
        pheno.phenotype_profile(labelled, label, feats.names),
        pheno.compare_phenotypes(labelled, label, feats.names),
        table,
        method,
        k,
    )
