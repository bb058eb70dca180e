"""Treatment groups, clustering, validation, phenotypes and the whole workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.inputs import (
    CUSTOMER_FEATURES, DIMENSIONS, DIMS, LINEITEM, MEASURES, ORDERS, VECTORS, WIDTH, customers,
    dimensions, lineitem, orders, rd, rounded, table, union, vectors,
)
from trialframe.operators import cluster, groups, mixture, validate
from trialframe.operators import phenotype as pheno
from trialframe.operators.features import prepare_features
from trialframe.plans import pipeline

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- treatment groups

_LABEL = "CASE tx " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in groups.TREATMENT_LABELS.items()) + " END"


@query("group_sizes", f"WITH {ORDERS} SELECT {_LABEL} AS treatment_group, count(*) AS n FROM oc "
       "GROUP BY 1")
def group_sizes(spark, sf):
    return groups.group_sizes(groups.with_treatment(orders(spark, sf)), "treatment_group")


@query(
    "factorial_counts",
    f"WITH {ORDERS}, t AS (SELECT CAST(tx IN (1, 3) AS INTEGER) AS has_meditation, "
    "CAST(tx IN (1, 2) AS INTEGER) AS has_tdcs FROM oc) SELECT has_meditation, "
    'count(CASE WHEN has_tdcs = 0 THEN 1 END) AS "0", count(CASE WHEN has_tdcs = 1 THEN 1 END) '
    'AS "1" FROM t GROUP BY has_meditation',
)
def factorial_counts(spark, sf):
    return groups.factorial_counts(
        groups.with_treatment(orders(spark, sf)), "has_meditation", "has_tdcs")


@query(
    "factorial_groups",
    "SELECT CASE WHEN quality = 0 AND toxic = 0 THEN 'Control' WHEN quality = 1 AND toxic = 0 "
    "THEN 'quality Only' WHEN quality = 0 AND toxic = 1 THEN 'toxic Only' ELSE "
    "'quality + toxic' END AS treatment_group, count(*) AS n FROM labels GROUP BY 1",
)
def factorial_groups(spark, sf):
    df = groups.factorial_groups(
        table(spark, sf, "labels"), "quality", "toxic", "quality", "toxic")
    return groups.group_sizes(df, "treatment_group")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_BASE_NUM = ["o_totalprice", "c_acctbal"]
_BASE_CAT = ["o_orderstatus", "o_orderpriority"]
_BASELINE = (
    f"WITH {ORDERS}, t AS (" + union(
        _BASE_NUM,
        "SELECT '{v}' AS variable, c_mktsegment AS g, printf('%.2f', avg({v})) || ' ± ' || "
        "printf('%.2f', stddev_samp({v})) AS text FROM oc GROUP BY c_mktsegment")
    + " UNION ALL " + union(
        _BASE_CAT,
        "SELECT '{v}', c_mktsegment, arg_max({v}, (n, r)) || ' (' || "
        "printf('%.1f', max(n) * 100.0 / sum(n)) || '%)' FROM (SELECT c_mktsegment, {v}, "
        "count(*) AS n, -dense_rank() OVER (ORDER BY {v}) AS r FROM oc GROUP BY c_mktsegment, {v}) "
        "GROUP BY c_mktsegment")
    + ") SELECT variable, "
    + ", ".join(f"coalesce(max(CASE WHEN g = '{s}' THEN text END), 'N/A') AS \"{s}\""
                for s in SEGMENTS)
    + " FROM t GROUP BY variable"
)


@query("baseline_table", _BASELINE)
def baseline_table(spark, sf):
    return groups.baseline_table(
        orders(spark, sf), [*_BASE_NUM, *_BASE_CAT], "c_mktsegment", SEGMENTS)


@query(
    "categorical_by_group",
    f"WITH {ORDERS} " + union(
        _BASE_CAT,
        "SELECT c_mktsegment, '{v}' AS variable, {v} AS value, count(*) AS n, "
        + rd("count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY c_mktsegment)")
        + " AS pct FROM oc GROUP BY c_mktsegment, {v}"),
)
def categorical_by_group(spark, sf):
    return rounded(groups.categorical_by_group(orders(spark, sf), _BASE_CAT, "c_mktsegment"))


@query(
    "outcome_stats",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        "SELECT l_returnflag, '{v}' AS variable, count({v}) AS n, " + ", ".join(
            f"{rd(e, 4)} AS {n}" for n, e in {
                "mean": "avg({v})", "median": "median({v})", "std": "stddev_samp({v})",
                "min": "min({v})", "max": "max({v})"}.items())
        + " FROM li GROUP BY l_returnflag"),
)
def outcome_stats(spark, sf):
    return rounded(groups.outcome_stats(lineitem(spark, sf), MEASURES, "l_returnflag"), 4)


def _anova_sql(variables, group: str, source: str) -> str:
    """F and η² per variable; for three groups the tail of F is (1 + 2F/d)^(−d/2)."""
    return union(
        variables,
        "SELECT '{v}' AS variable, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n, "
        "sum(n * (m - g) ** 2) AS ssb, sum(ssw) AS ssw FROM (SELECT " + group + ", count({v}) AS "
        "n, avg({v}) AS m, var_pop({v}) * count({v}) AS ssw, (SELECT avg({v}) FROM " + source
        + ") AS g FROM " + source + " WHERE {v} IS NOT NULL GROUP BY " + group + ")")


_F = "(ssb / (n_groups - 1)) / (ssw / (n - n_groups))"


@query(
    "anova",
    f"WITH {LINEITEM}, a AS (" + _anova_sql(MEASURES, "l_returnflag", "li")
    + f"), f AS (SELECT *, {_F} AS f, n - n_groups AS d FROM a) SELECT variable, n_groups, n, "
    f"{rd('f', 4)} AS f_statistic, {rd('(1 + 2 * f / d) ** (-d / 2)')} AS p_value, "
    f"{rd('ssb / (ssb + ssw)')} AS eta_squared, (1 + 2 * f / d) ** (-d / 2) < 0.05 AS "
    "significant FROM f",
)
def anova(spark, sf):
    t = groups.anova(lineitem(spark, sf), MEASURES, "l_returnflag")
    return rounded(t.select("variable", "n_groups", "n", F.round("f_statistic", 4).alias(
        "f_statistic"), "p_value", "eta_squared", "significant"))


_SMD = (
    f"WITH {ORDERS}, s AS (" + union(
        _BASE_NUM, "SELECT '{v}' AS variable, c_mktsegment AS g, count({v}) AS n, avg({v}) AS m, "
        "var_samp({v}) AS v FROM oc GROUP BY c_mktsegment")
    + "), b AS (SELECT s.variable, s.g AS c_mktsegment, r.m AS rm, sqrt(r.v) AS rs, "
    "abs((s.m - r.m) / sqrt(((r.n - 1) * r.v + (s.n - 1) * s.v) / (r.n + s.n - 2))) AS smd "
    "FROM s JOIN s r ON r.variable = s.variable AND r.g = 'BUILDING' AND s.g <> 'BUILDING'), "
    "c AS (SELECT *, CASE WHEN smd < 0.1 THEN 'good' WHEN smd < 0.2 THEN 'acceptable' ELSE 'poor' "
    "END AS assessment FROM b)"
)


def _balance(spark, sf):
    return groups.smd_balance(orders(spark, sf), _BASE_NUM, "c_mktsegment", "BUILDING")


@query("smd_balance", _SMD + f" SELECT variable, c_mktsegment, {rd('rm', 4)} AS reference_mean, "
       f"{rd('rs', 4)} AS reference_std, {rd('smd', 4)} AS smd, assessment FROM c")
def smd_balance(spark, sf):
    return rounded(_balance(spark, sf), 4)


@query(
    "smd_matrix",
    _SMD + " SELECT variable, " + ", ".join(
        f"{rd(f'''max(CASE WHEN c_mktsegment = '{s}' THEN smd END)''')} AS \"{s}\""
        for s in SEGMENTS if s != "BUILDING") + " FROM c GROUP BY variable",
)
def smd_matrix(spark, sf):
    return rounded(groups.smd_matrix(
        _balance(spark, sf), "c_mktsegment", [s for s in SEGMENTS if s != "BUILDING"]))


@query(
    "balance_summary",
    _SMD + ", t AS (SELECT count(CASE WHEN assessment = 'good' THEN 1 END) AS good, "
    "count(CASE WHEN assessment = 'acceptable' THEN 1 END) AS acceptable, "
    "count(CASE WHEN assessment = 'poor' THEN 1 END) AS poor, count(*) AS n FROM c) "
    "SELECT good, acceptable, poor, CASE WHEN poor = 0 AND acceptable <= n * 0.2 THEN 'good' "
    "WHEN poor <= n * 0.2 THEN 'acceptable' ELSE 'poor' END AS overall FROM t",
)
def balance_summary(spark, sf):
    return groups.balance_summary(_balance(spark, sf))


@query(
    "pre_post_change",
    f"WITH {LINEITEM} SELECT l_returnflag, {rd('avg(l_discount)')} AS pre_mean, "
    f"{rd('avg(l_tax)')} AS post_mean, {rd('avg(l_tax) - avg(l_discount)')} AS change "
    "FROM li GROUP BY l_returnflag",
)
def pre_post_change(spark, sf):
    return rounded(
        groups.pre_post_change(lineitem(spark, sf), "l_discount", "l_tax", "l_returnflag"))


# ---------------------------------------------------------------- validation

GIVEN = ["given_10", "given_5", "given_3"]
_LONG = "lab AS (" + union(GIVEN, "SELECT vec_id, x, '{v}' AS labeling, {v} AS label FROM ve") + ")"


def _silhouette_sql(distance: str) -> str:
    return (
        f"WITH {VECTORS}, {_LONG}, d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, "
        f"{distance} AS d FROM ve a, ve b), c AS (SELECT l.labeling, m.vec_id AS i, m.label AS "
        "own, l.label, sum(d.d) AS s, count(*) AS n FROM d JOIN lab l ON l.vec_id = d.j JOIN lab m "
        "ON m.vec_id = d.i AND m.labeling = l.labeling GROUP BY ALL), ab AS (SELECT labeling, i, "
        "max(CASE WHEN label = own THEN s / nullif(n - 1, 0) END) AS a, "
        "min(CASE WHEN label <> own THEN s / n END) AS b FROM c GROUP BY labeling, i) "
    )


_S = "avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)"


@query("silhouette", _silhouette_sql("list_distance(a.x, b.x)")
       + f"SELECT labeling, {rd(_S)} AS silhouette FROM ab GROUP BY labeling")
def silhouette(spark, sf):
    return rounded(validate.silhouette(vectors(spark, sf), GIVEN, "vec_id", WIDTH))


@query("silhouette_squared", _silhouette_sql("list_distance(a.x, b.x) ** 2")
       + f"SELECT labeling, {rd(_S)} AS silhouette FROM ab GROUP BY labeling")
def silhouette_squared(spark, sf):
    return rounded(
        validate.silhouette(vectors(spark, sf), GIVEN, "vec_id", WIDTH, "sqeuclidean"))


_SS = (
    f"WITH {VECTORS}, {_LONG}, e AS (SELECT labeling, label, unnest(x) AS v, "
    "generate_subscripts(x, 1) AS j FROM lab), m AS (SELECT labeling, label, j, count(*) AS n, "
    "avg(v) AS m, var_pop(v) * count(*) AS w FROM e GROUP BY ALL), g AS (SELECT labeling, j, "
    "sum(n * m) / sum(n) AS g FROM m GROUP BY ALL), t AS (SELECT labeling, sum(w) AS w, "
    "sum(n * (m - g) ** 2) AS b, count(DISTINCT label) AS k, "
    "sum(CASE WHEN j = 1 THEN n END) AS n FROM m JOIN g USING (labeling, j) GROUP BY labeling) "
)


@query("calinski_harabasz", _SS + "SELECT labeling, " + rd("(b / (k - 1)) / (w / (n - k))")
       + " AS calinski FROM t")
def calinski_harabasz(spark, sf):
    return rounded(validate.calinski_harabasz(vectors(spark, sf), GIVEN, WIDTH))


@query("within_ss", _SS + f"SELECT labeling, {rd('w')} AS within_ss FROM t")
def within_ss(spark, sf):
    return rounded(validate.within_ss(vectors(spark, sf), GIVEN, WIDTH))


@query("cluster_sizes", f"WITH {VECTORS}, {_LONG} SELECT labeling, label, count(*) AS n FROM lab "
       "GROUP BY ALL")
def cluster_sizes(spark, sf):
    return validate.cluster_sizes(vectors(spark, sf), GIVEN)


@query(
    "jaccard",
    f"WITH {ORDERS}, t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, "
    "CAST(count(*) AS DOUBLE) AS n FROM oc GROUP BY ALL), "
    "s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS shared, "
    "(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS l, "
    "(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS r) "
    "SELECT CAST(shared AS BIGINT) AS pairs_both, CAST(l + r - shared AS BIGINT) AS "
    f"pairs_either, {rd('shared / (l + r - shared)')} AS jaccard FROM s",
)
def jaccard(spark, sf):
    return rounded(validate.jaccard(orders(spark, sf), "o_orderstatus", "o_orderpriority"))


@query(
    "jaccard_of_labels",
    f"WITH {VECTORS} SELECT count(CASE WHEN a.given_10 = b.given_10 AND a.given_3 = b.given_3 "
    "THEN 1 END) AS pairs_both, count(CASE WHEN a.given_10 = b.given_10 OR a.given_3 = b.given_3 "
    "THEN 1 END) AS pairs_either, " + rd(
        "count(CASE WHEN a.given_10 = b.given_10 AND a.given_3 = b.given_3 THEN 1 END) / "
        "count(CASE WHEN a.given_10 = b.given_10 OR a.given_3 = b.given_3 THEN 1 END)")
    + " AS jaccard FROM ve a JOIN ve b ON a.vec_id < b.vec_id",
)
def jaccard_of_labels(spark, sf):
    return rounded(validate.jaccard(vectors(spark, sf), "given_10", "given_3"))


def _given_metrics(spark, sf):
    return cluster.cluster_metrics(vectors(spark, sf), "given", [3, 5, 10], "vec_id", WIDTH)


@query(
    "optimal_k",
    _silhouette_sql("list_distance(a.x, b.x)") + f", s AS (SELECT labeling, {_S} AS silhouette "
    "FROM ab GROUP BY labeling), z AS (SELECT labeling, min(n) AS m FROM (SELECT labeling, label, "
    "count(*) AS n FROM lab GROUP BY ALL) GROUP BY labeling), k AS (SELECT silhouette, m, "
    "CAST(regexp_extract(labeling, '_(\\d+)$', 1) AS INTEGER) AS k FROM s JOIN z USING (labeling)) "
    "SELECT 'given' AS method, arg_max(k, silhouette) FILTER (m >= 10) AS optimal_k, "
    f"{rd('max(silhouette) FILTER (m >= 10)')} AS silhouette, "
    "string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) FILTER (m >= 10) AS valid_k FROM k",
)
def optimal_k(spark, sf):
    best = validate.optimal_k(_given_metrics(spark, sf), 10)
    return rounded(best.withColumn("valid_k", F.array_join("valid_k", "|")))


# ---------------------------------------------------------------- phenotypes


@query(
    "phenotype_profile",
    f"WITH {DIMENSIONS} " + union(
        DIMS, "SELECT given_10 AS phenotype, '{v}' AS variable, count(*) AS n, "
        f"{rd('avg({v})')} AS mean, {rd('stddev_samp({v})')} AS std FROM di GROUP BY given_10"),
)
def phenotype_profile(spark, sf):
    return rounded(pheno.phenotype_profile(dimensions(spark, sf), "given_10", DIMS))


@query(
    "compare_phenotypes",
    f"WITH {DIMENSIONS}, a AS (" + _anova_sql(DIMS, "given_3", "di")
    + f"), f AS (SELECT *, {_F} AS f, n - n_groups AS d, ssb / (ssb + ssw) AS eta FROM a) "
    f"SELECT variable, {rd('f', 4)} AS f_statistic, {rd('(1 + 2 * f / d) ** (-d / 2)')} AS "
    f"p_value, {rd('eta')} AS eta_squared, (1 + 2 * f / d) ** (-d / 2) < 0.05 AS significant, "
    "CASE WHEN eta >= 0.14 THEN 'large' WHEN eta >= 0.06 THEN 'medium' WHEN eta >= 0.01 THEN "
    "'small' ELSE 'negligible' END AS effect FROM f",
)
def compare_phenotypes(spark, sf):
    t = pheno.compare_phenotypes(dimensions(spark, sf), "given_3", DIMS)
    return rounded(t.withColumn("f_statistic", F.round("f_statistic", 4)))


def _z_sql(sd: str, label: str = "given_5") -> str:
    return (
        f"WITH {DIMENSIONS}, z AS (" + union(
            DIMS, f"SELECT {label} AS phenotype, '{{v}}' AS variable, (avg({{v}}) - g) / s AS z "
            f"FROM di, (SELECT avg({{v}}) AS g, {sd}({{v}}) AS s FROM di) "
            f"GROUP BY {label}, g, s") + ")"
    )


@query(
    "zscore_profile",
    _z_sql("stddev_samp") + ", v AS (SELECT variable, row_number() OVER (ORDER BY var_samp(z) "
    "DESC, variable) AS rank FROM z GROUP BY variable) SELECT phenotype, variable, "
    f"{rd('z')} AS z, CAST(rank AS INTEGER) AS rank FROM z JOIN v USING (variable) WHERE rank <= 5",
)
def zscore_profile(spark, sf):
    return rounded(pheno.zscore_profile(dimensions(spark, sf), "given_5", DIMS, 5))


@query(
    "radar_data",
    _z_sql("stddev_pop") + ", a AS (" + _anova_sql(DIMS, "given_5", "di") + "), b AS (SELECT "
    "variable FROM a ORDER BY ssb / (ssb + ssw) DESC, variable LIMIT 4) SELECT phenotype, "
    f"variable, {rd('z')} AS mean_scaled FROM z WHERE variable IN (SELECT variable FROM b)",
)
def radar_data(spark, sf):
    d = dimensions(spark, sf)
    return rounded(pheno.radar_data(
        d, "given_5", DIMS, pheno.compare_phenotypes(d, "given_5", DIMS), 4))


_CHI_VARS = ["o_orderpriority", "c_mktsegment"]


def _chi_sql(variables, group: str, source: str) -> str:
    """χ² per variable; for an even number d of degrees of freedom its tail is
    e^(−x/2) · Σ_{i < d/2} (x/2)^i / i!."""
    one = (
        "SELECT '{v}' AS variable, CAST(n AS BIGINT) AS n, n_values, n_clusters, chi2, "
        "(n_values - 1) * (n_clusters - 1) AS d FROM (SELECT any_value(n) AS n, "
        "count(DISTINCT val) AS n_values, count(DISTINCT grp) AS n_clusters, "
        "sum((coalesce(o, 0) - r * c / n) ** 2 / (r * c / n)) AS chi2 FROM "
        "(SELECT {v} AS val, CAST(count(*) AS DOUBLE) AS r FROM @s WHERE {v} IS NOT NULL GROUP BY 1)"
        " CROSS JOIN (SELECT @g AS grp, CAST(count(*) AS DOUBLE) AS c FROM @s WHERE {v} IS NOT NULL"
        " GROUP BY 1) CROSS JOIN (SELECT CAST(count({v}) AS DOUBLE) AS n FROM @s) LEFT JOIN "
        "(SELECT {v} AS val, @g AS grp, CAST(count(*) AS DOUBLE) AS o FROM @s GROUP BY 1, 2) "
        "USING (val, grp))"
    )
    return union(variables, one.replace("@s", source).replace("@g", group))


_CHI_P = "exp(-chi2 / 2) * list_sum([(chi2 / 2) ** i / gamma(i + 1) FOR i IN range(0, d // 2)])"


@query(
    "chi_square",
    f"WITH {ORDERS}, c AS (" + _chi_sql(_CHI_VARS, "o_orderstatus", "oc")
    + f") SELECT variable, n, n_values, n_clusters, {rd('chi2')} AS chi2, d AS df, "
    f"{rd(_CHI_P)} AS p_value, "
    + rd("sqrt(chi2 / (n * (least(n_values, n_clusters) - 1)))") + " AS cramers_v FROM c",
)
def chi_square(spark, sf):
    return rounded(pheno.chi_square(orders(spark, sf), _CHI_VARS, "o_orderstatus"))


_MIXED = ["o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment", "c_nationkey"]
_TESTS = (
    f"WITH {ORDERS}, a AS ("
    + _anova_sql(["o_totalprice", "c_acctbal", "c_nationkey"], "o_orderstatus", "oc")
    + f"), f AS (SELECT *, {_F} AS f, n - n_groups AS d FROM a), c AS ("
    + _chi_sql(_CHI_VARS, "o_orderstatus", "oc")
    + "), t AS (SELECT variable, 'ANOVA' AS kind, f AS stat, (1 + 2 * f / d) ** (-d / 2) AS p, "
    f"ssb / (ssb + ssw) AS e FROM f UNION ALL SELECT variable, 'Chi-Square', chi2, {_CHI_P}, "
    "sqrt(chi2 / (n * (least(n_values, n_clusters) - 1))) FROM c), "
    "r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM t), "
    "h AS (SELECT *, least(1, min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS cp "
    "FROM r)"
)


@query(
    "characterize",
    _TESTS + f" SELECT variable AS Variable, kind AS TestType, {rd('stat', 4)} AS Statistic, "
    f"{rd('p')} AS PValue, {rd('cp')} AS CorrectedPValue, cp <= 0.05 AS RejectNullFDR, "
    f"{rd('e')} AS EffectSize FROM h",
)
def characterize(spark, sf):
    t = pheno.characterize(orders(spark, sf), "o_orderstatus", _MIXED)
    return rounded(t.withColumn("Statistic", F.round("Statistic", 4)))


_EDGES = (
    f"WITH {ORDERS}, e AS (SELECT *, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM oc) THEN 'X' "
    "ELSE o_orderstatus END AS cl FROM oc), e2 AS (SELECT * FROM e WHERE cl <> 'X'), a AS ("
    + _anova_sql(["o_totalprice"], "cl", "e2")
    + f"), f AS (SELECT variable, {_F} AS f, n - n_groups AS d, ssb / (ssb + ssw) AS e FROM a), "
    "t AS (SELECT variable, f, (1 + 2 * f / d) ** (-d / 2) AS p, e FROM f)"
)


@query(
    "characterize_edges",
    _EDGES + f" SELECT variable AS Variable, 'ANOVA' AS TestType, {rd('f', 4)} AS Statistic, "
    f"{rd('p')} AS PValue, {rd('least(1, 2 * p)')} AS CorrectedPValue, least(1, 2 * p) <= 0.05 "
    f"AS RejectNullFDR, {rd('e')} AS EffectSize FROM t UNION ALL "
    "SELECT 'same', 'ANOVA_NoVarianceOrSameMean', 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, false, "
    "0.0::DOUBLE UNION ALL SELECT 'one_side', 'ANOVA_NotEnoughGroups', 'nan'::DOUBLE, 'nan'::DOUBLE, "
    "'nan'::DOUBLE, NULL, 'nan'::DOUBLE",
)
def characterize_edges(spark, sf):
    """A cluster with one row, a constant, and a variable that one cluster alone has."""
    o = orders(spark, sf)
    first = o.agg(F.min("o_orderkey")).first()[0]
    o = o.withColumn("cl", F.when(F.col("o_orderkey") == first, "X").otherwise(F.col("o_orderstatus")))
    o = o.withColumn("same", F.lit(2.5)).withColumn(
        "one_side", F.when(F.col("cl") == "F", F.col("o_totalprice")))
    t = pheno.characterize(o, "cl", ["o_totalprice", "same", "one_side"])
    return rounded(t.withColumn("Statistic", F.round("Statistic", 4)))


@query(
    "fdr_bh",
    f"WITH {DIMENSIONS}, a AS (" + _anova_sql(DIMS, "given_3", "di")
    + f"), f AS (SELECT variable, (1 + 2 * {_F} / (n - n_groups)) ** (-(n - n_groups) / 2) AS p "
    "FROM a), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM f), "
    "h AS (SELECT *, least(1, min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) AS cp FROM r)"
    f" SELECT variable, {rd('p')} AS p_value, {rd('cp')} AS corrected_p, cp <= 0.05 AS reject "
    "FROM h",
)
def fdr_bh(spark, sf):
    t = pheno.compare_phenotypes(dimensions(spark, sf), "given_3", DIMS)
    return rounded(pheno.benjamini_hochberg(t.select("variable", "p_value")))


# ---------------------------------------------------------------- clustering


def _feats(spark, sf):
    return prepare_features(customers(spark, sf), "c_custkey", CUSTOMER_FEATURES)


def _vec_feats(spark, sf):
    """All values of the vectors."""
    wide = [f"e{i}" for i in range(1, WIDTH + 1)]
    return prepare_features(dimensions(spark, sf, WIDTH), "vec_id", wide)


@query("kmeans")
def kmeans(spark, sf):
    feats = _feats(spark, sf)
    frame, _ = cluster.cluster(feats, "kmeans")
    return frame.drop("x")


@query("kmeans_metrics")
def kmeans_metrics(spark, sf):
    feats = _vec_feats(spark, sf)
    frame, criteria = cluster.cluster(feats, "kmeans")
    return cluster.cluster_metrics(
        frame, "kmeans", range(2, 7), "vec_id", feats.width, criteria)


@query("ward")
def ward(spark, sf):
    return cluster.cluster(_feats(spark, sf), "agglomerative")[0].drop("x")


@query("gmm")
def gmm(spark, sf):
    return mixture.gmm(_feats(spark, sf))[0].drop("x")


@query("gmm_criteria")
def gmm_criteria(spark, sf):
    frame, models = mixture.gmm(_vec_feats(spark, sf))
    return mixture.mixture_criteria(frame, models)


@query("gmm_parameters")
def gmm_parameters(spark, sf):
    frame, models = mixture.gmm(_feats(spark, sf))
    return mixture.mixture_table(frame, models)


@query("gap_statistic")
def gap_statistic(spark, sf):
    return validate.gap_statistic(_vec_feats(spark, sf))[0]


@query("bootstrap_stability")
def bootstrap_stability(spark, sf):
    return validate.bootstrap_stability(_vec_feats(spark, sf), k=3)


@query("cluster_scatter")
def cluster_scatter(spark, sf):
    feats = _feats(spark, sf)
    frame, _ = cluster.cluster(feats, "kmeans", [3])
    return pheno.cluster_scatter(feats, frame, "kmeans_3")


@query("assignments")
def assignments(spark, sf):
    feats = _feats(spark, sf)
    frame, _ = cluster.cluster(feats, "gmm", [3])
    return pheno.assignments(frame, "gmm", 3, feats.names, "c_custkey", {0: "First"})


# Groups that are known: ten sums over all 64 values of a vector, the label's own shifted far out.
# A method that finds them gives each label's rows one cluster, whatever number it bears.
_PLANTED = [f"s{i}" for i in range(10)]
_PLANTED_SQL = "SELECT min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY label"


def _planted(spark, sf):
    v = vectors(spark, sf)
    total = lambda i: sum((F.col("x")[j] for j in range(i, WIDTH, 10)), F.lit(0.0))
    return v.select("vec_id", *[
        (total(i) + F.when(F.col("given_10") == i, 100.0).otherwise(0.0)).alias(f"s{i}")
        for i in range(10)])


def _partition(labelled, label: str):
    return labelled.groupBy(label).agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("n")).drop(label)


@query("kmeans_planted", _PLANTED_SQL)
def kmeans_planted(spark, sf):
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    return _partition(cluster.cluster(feats, "kmeans", [10])[0], "kmeans_10")


@query("ward_planted", _PLANTED_SQL)
def ward_planted(spark, sf):
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    return _partition(cluster.cluster(feats, "agglomerative", [10])[0], "agglomerative_10")


@query("gmm_planted", _PLANTED_SQL)
def gmm_planted(spark, sf):
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    return _partition(mixture.gmm(feats, [10], n_init=10)[0], "gmm_10")


# The groups lie so far apart that every responsibility is 0 or 1 in double precision: weights,
# means and covariances are those of the labels' rows, in units of the whole table's spread.
_Z = "z AS (SELECT label, " + ", ".join(
    f"(s{i} - avg(s{i}) OVER ()) / stddev_pop(s{i}) OVER () AS s{i}" for i in range(10)) + " FROM p)"
_SUMS = "p AS (SELECT label, " + ", ".join(
    " + ".join(f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(i, WIDTH, 10))
    + f" + CASE WHEN label = {i} THEN 100 ELSE 0 END AS s{i}" for i in range(10)) + " FROM embeddings)"
_COV = " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, count(*) / (SELECT count(*) FROM z) AS weight, avg(s{i}) AS mean_i, "
    f"avg(s{j}) AS mean_j, covar_pop(s{i}, s{j}) + {1e-6 if i == j else 0.0} AS covariance "
    "FROM z GROUP BY label" for i in range(10) for j in range(i, 10))


@query(
    "gmm_parameters_planted",
    f"WITH {_SUMS}, {_Z}, c AS ({_COV}) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
    f"{rd('weight')} AS weight, {rd('mean_i')} AS mean_i, {rd('mean_j')} AS mean_j, "
    f"{rd('covariance')} AS covariance FROM c",
)
def gmm_parameters_planted(spark, sf):
    """Weight, means and covariance of every pair of variables and component."""
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    frame, models = mixture.gmm(feats, [10], n_init=10)
    t = mixture.mixture_table(frame, models)
    rows = t.select("weight", "mean", F.posexplode("covariance").alias("i", "row")).select(
        "weight", "mean", "i", F.posexplode("row").alias("j", "covariance")).where("i <= j")
    return rounded(rows.select("i", "j", "weight", F.col("mean")[F.col("i")].alias("mean_i"),
                               F.col("mean")[F.col("j")].alias("mean_j"), "covariance"))


# At the planted k the clusters are the labels' rows, so log W is that of their spread.
@query(
    "gap_planted",
    f"WITH {_SUMS}, {_Z}, w AS (SELECT " + " + ".join(f"count(*) * var_pop(s{i})" for i in range(10))
    + f" AS w FROM z GROUP BY label) SELECT CAST(10 AS INTEGER) AS k, {rd('ln(sum(w))')} AS log_w FROM w",
)
def gap_planted(spark, sf):
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    return rounded(validate.gap_statistic(feats, [10])[0].select("k", "log_w"))


@query(
    "assignments_planted",
    "WITH n AS (SELECT label, min(vec_id) AS first_id, count(*) AS n FROM embeddings GROUP BY label) "
    "SELECT first_id, n, true AS one_name, CAST(1.0 AS DOUBLE) AS least_probability FROM n",
)
def assignments_planted(spark, sf):
    """Rows, names and probabilities of the phenotypes that a mixture assigns."""
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    frame, _ = mixture.gmm(feats, [10], n_init=10)
    t = pheno.assignments(frame, "gmm", 10, feats.names, "vec_id", {0: "First"})
    own = F.element_at(F.array(*[f"Phenotype_{i}_Probability" for i in range(1, 11)]), F.col("Phenotype") + 1)
    named = F.col("Phenotype_Name") == F.when(F.col("Phenotype") == 0, "First").otherwise(
        F.format_string("Phenotype_%d", F.col("Phenotype") + 1))
    return rounded(t.groupBy("Phenotype").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.min(named).alias("one_name"),
        F.min(own).alias("least_probability")).drop("Phenotype"))


# Two of the variables make three groups.  With responsibilities of 0 and 1 the log-likelihood of
# a group is n (log w - log 2π - log|S| / 2 - tr(S⁻¹ C) / 2), C its covariance and S with the ridge.
@query(
    "gmm_criteria_planted",
    f"WITH {_SUMS}, {_Z}, g AS (SELECT 3 AS k, CASE WHEN label = 0 THEN 0 WHEN label = 1 THEN 1 "
    "ELSE 2 END AS g, s0, s1 FROM z UNION ALL SELECT 1, 0, s0, s1 FROM z), "
    "c AS (SELECT k, g, count(*) AS n, covar_pop(s0, s0) AS a, covar_pop(s1, s1) AS b, "
    "covar_pop(s0, s1) AS c FROM g GROUP BY k, g), "
    "d AS (SELECT *, (a + 1e-6) * (b + 1e-6) - c * c AS det, sum(n) OVER (PARTITION BY k) AS total FROM c), "
    "l AS (SELECT k, max(total) AS total, sum(n * (ln(n / total) - ln(2 * pi()) - 0.5 * ln(det) "
    "- 0.5 * ((b + 1e-6) * a + (a + 1e-6) * b - 2 * c * c) / det)) AS ll FROM d GROUP BY k) "
    f"SELECT CAST(k AS INTEGER) AS k, {rd('ll', 4)} AS log_likelihood, "
    f"{rd('-2 * ll + (6 * k - 1) * ln(total)', 4)} AS bic, {rd('-2 * ll + 2 * (6 * k - 1)', 4)} AS aic FROM l",
)
def gmm_criteria_planted(spark, sf):
    feats = prepare_features(_planted(spark, sf), "vec_id", ["s0", "s1"])
    frame, models = mixture.gmm(feats, [1, 3], n_init=10)
    return rounded(mixture.mixture_criteria(frame, models), 4)


@query(
    "bootstrap_planted",
    "SELECT CAST(1.0 AS DOUBLE) AS mean_jaccard, CAST(1.0 AS DOUBLE) AS min_jaccard "
    "FROM (SELECT count(DISTINCT label) AS k FROM embeddings) WHERE k = 10",
)
def bootstrap_planted(spark, sf):
    feats = prepare_features(_planted(spark, sf), "vec_id", _PLANTED)
    t = validate.bootstrap_stability(feats, k=10, n_bootstrap=20)
    return rounded(t.select("mean_jaccard", "min_jaccard"))


# ---------------------------------------------------------------- workflows


def _prepared(spark, sf):
    table_ = customers(spark, sf).withColumn(
        "avg_price", F.when(F.col("c_custkey") % 9 != 0, F.col("avg_price")))
    config = pipeline.PrepConfig("c_custkey", force_include=["c_mktsegment"])
    return table_, pipeline.prepare(table_, config)


@query("prepare")
def prepare(spark, sf):
    return _prepared(spark, sf)[1][0]


@query("prepare_steps")
def prepare_steps(spark, sf):
    return pipeline.steps_summary(_prepared(spark, sf)[1][1]["steps"])


@query("pipeline_report")
def pipeline_report(spark, sf):
    before, (after, results) = _prepared(spark, sf)
    return pipeline.pipeline_report(before, after, results["steps"])


@query("discover")
def discover(spark, sf):
    return pipeline.discover(
        customers(spark, sf), "c_custkey", CUSTOMER_FEATURES, ("kmeans", "agglomerative"),
        attach=["c_mktsegment"]).assignments


# What discovery must find in the planted groups, whichever method it takes: the k of the labels,
# and the silhouettes of their partition.
@query(
    "discover_planted",
    _PLANTED_SQL.replace("SELECT ", "SELECT CAST(10 AS INTEGER) AS k, ", 1),
)
def discover_planted(spark, sf):
    found = pipeline.discover(
        _planted(spark, sf), "vec_id", _PLANTED, ("kmeans", "agglomerative", "gmm"), [9, 10, 11])
    label = f"{found.method}_{found.k}"
    return _partition(found.labelled, label).select(F.lit(found.k).alias("k"), "first_id", "n")


@query("discover_metrics")
def discover_metrics(spark, sf):
    return pipeline.discover(
        dimensions(spark, sf, WIDTH), "vec_id", [f"e{i}" for i in range(1, WIDTH + 1)],
        ("kmeans", "agglomerative", "gmm")).metrics
