"""Phase I: profiling, missing data, imputation, screening, quality, reduction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from suite.inputs import (
    DICTIONARY, LINEITEM, MEASURES, ORDERS, PARTS, VISITS, WORDS, dictionary, lineitem, parts, rd, rounded,
    table, union, visits, words,
)
from trialframe.operators import explore, impute, missing, quality, reduce, screen
from trialframe.plans.lineage import shared_folder
from trialframe.plans.moments import correlations
from trialframe.plans.quantiles import exact_quantiles
from trialframe.sources import dictionary as names
from trialframe.sources import tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


KINDS = {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double",
         "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string"}


# ---------------------------------------------------------------- profiling


@query(
    "profile_table",
    f"WITH {LINEITEM} SELECT variable, position, CASE kind WHEN 'DOUBLE' THEN 'double' ELSE "
    "'string' END AS dtype, n, missing_values, n_present FROM (" + union(
        KINDS,
        "SELECT '{v}' AS variable, CAST({i} AS INTEGER) AS position, max(typeof({v})) AS kind, "
        "count(*) AS n, count(*) - count({v}) AS missing_values, count({v}) AS n_present FROM li",
    ) + ")",
)
def profile_table(spark, sf):
    return explore.profile_table(lineitem(spark, sf).select(*KINDS))


MISSING_SQL = (
    f"WITH {LINEITEM}, m AS (" + union(
        KINDS,
        "SELECT '{v}' AS variable, count(*) - count({v}) AS missing_values, "
        "(count(*) - count({v})) * 100.0 / count(*) AS percentage FROM li",
    ) + ")"
)


@query(
    "missing_report",
    MISSING_SQL + f" SELECT variable, missing_values, {rd('percentage')} AS percentage, "
    "CASE WHEN variable IN ('l_returnflag', 'l_linestatus') THEN 'string' ELSE 'double' END "
    "AS dtype FROM m",
)
def missing_report(spark, sf):
    return rounded(missing.missing_report(lineitem(spark, sf).select(*KINDS)))


@query(
    "top_missing",
    MISSING_SQL + f" SELECT variable, {rd('percentage')} AS percentage FROM m "
    "WHERE missing_values > 0 ORDER BY m.percentage DESC, variable LIMIT 2",
)
def top_missing(spark, sf):
    report = missing.missing_report(lineitem(spark, sf).select(*KINDS))
    return rounded(missing.top_missing(report, 2).select("variable", "percentage"))


_ANY = " OR ".join(f"{v} IS NULL" for v in MEASURES)


@query(
    "overview",
    f"WITH {LINEITEM}, m AS (SELECT count(*) AS n_rows, "
    f"sum(CASE WHEN {_ANY} THEN 0 ELSE 1 END) AS complete_rows, "
    + ", ".join(f"count(*) - count({v}) AS m_{v}" for v in KINDS)
    + " FROM li), c AS (SELECT *, "
    + " + ".join(f"m_{v}" for v in KINDS) + " AS cells, "
    + " + ".join(f"CASE WHEN m_{v} > 0 THEN 1 ELSE 0 END" for v in KINDS) + " AS touched FROM m) "
    "SELECT n_rows, CAST(6 AS BIGINT) AS n_columns, CAST(cells AS BIGINT) AS missing_cells, "
    f"{rd('cells * 100.0 / (n_rows * 6)')} AS pct_missing_cells, "
    "CAST(touched AS BIGINT) AS n_variables_missing, "
    f"{rd('touched * 100.0 / 6')} AS pct_variables_missing, "
    "CAST(complete_rows AS BIGINT) AS complete_rows, "
    f"{rd('complete_rows * 100.0 / n_rows')} AS pct_complete_rows FROM c",
)
def overview(spark, sf):
    return rounded(missing.overview(lineitem(spark, sf).select(*KINDS)))


@query(
    "missing_by_group",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        "SELECT l_returnflag, '{v}' AS variable, "
        + rd("(count(*) - count({v})) * 100.0 / count(*)") + " AS percentage FROM li "
        "GROUP BY l_returnflag",
    ),
)
def missing_by_group(spark, sf):
    return rounded(missing.missing_by_group(lineitem(spark, sf), MEASURES, "l_returnflag"))


PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]


@query(
    "missing_correlation",
    f"WITH {LINEITEM} " + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, "
        + rd(f"corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, "
             f"CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END)") + " AS r FROM li"
        for a, b in PAIRS
    ),
)
def missing_correlation(spark, sf):
    return rounded(missing.missing_correlation(lineitem(spark, sf), MEASURES))


@query(
    "missing_patterns",
    f"WITH {LINEITEM} SELECT "
    + ", ".join(f"({v} IS NULL) AS {v}__missing" for v in MEASURES)
    + ", count(*) AS n FROM li GROUP BY ALL",
)
def missing_patterns(spark, sf):
    return missing.missing_patterns(lineitem(spark, sf), MEASURES)


@query(
    "describe_numeric",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        "SELECT '{v}' AS variable, count({v}) AS count, " + ", ".join(
            f"{rd(e, 4)} AS {n}" for n, e in {
                "mean": "avg({v})", "std": "stddev_samp({v})", "min": "min({v})",
                "q1": "quantile_cont({v}, 0.25)", "median": "quantile_cont({v}, 0.5)",
                "q3": "quantile_cont({v}, 0.75)", "max": "max({v})",
            }.items()
        ) + ", count(*) - count({v}) AS missing, "
        + rd("(count(*) - count({v})) * 100.0 / count(*)", 4) + " AS missing_pct, "
        + rd("skewness({v})", 4) + " AS skew, " + rd("kurtosis({v})", 4)
        + " AS kurtosis FROM li",
    ),
)
def describe_numeric(spark, sf):
    return rounded(explore.describe_numeric(lineitem(spark, sf), MEASURES), 4)


@query(
    "value_counts",
    f"WITH {LINEITEM} " + union(
        ["l_returnflag", "l_linestatus"],
        "SELECT '{v}' AS variable, {v} AS value, count(*) AS n, "
        + rd("count(*) * 100.0 / sum(count(*)) OVER ()") + " AS pct FROM li GROUP BY {v}",
    ),
)
def value_counts(spark, sf):
    return rounded(explore.value_counts(lineitem(spark, sf), ["l_returnflag", "l_linestatus"]))


@query(
    "categorical_summary",
    union(["lang", "source"],
          "SELECT '{v}' AS variable, count(DISTINCT {v}) AS n_distinct, count({v}) AS n, "
          "count(*) - count({v}) AS missing FROM documents"),
)
def categorical_summary(spark, sf):
    return explore.categorical_summary(table(spark, sf, "documents"), ["lang", "source"])


def _histogram_sql(density: bool) -> str:
    extra = f", {rd('coalesce(c.n, 0) / (total * w)')} AS density" if density else ""
    return (
        "WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w, "
        "count(value) AS total FROM events), "
        "c AS (SELECT least(CAST(floor((value - lo) / w) AS INTEGER), 49) AS bin, count(*) AS n "
        "FROM events, r GROUP BY 1) "
        f"SELECT CAST(g AS INTEGER) AS bin, {rd('lo + g * w')} AS lower, "
        f"{rd('lo + (g + 1) * w')} AS upper, coalesce(c.n, 0) AS n{extra} "
        "FROM range(50) t(g) CROSS JOIN r LEFT JOIN c ON c.bin = g"
    )


@query("histogram", _histogram_sql(False))
def histogram(spark, sf):
    return rounded(explore.histogram(table(spark, sf, "events"), "value", 50))


@query("histogram_density", _histogram_sql(True))
def histogram_density(spark, sf):
    return rounded(explore.histogram(table(spark, sf, "events"), "value", 50, density=True))


@query(
    "box_stats",
    "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events "
    "GROUP BY event_type), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low_fence, "
    "q3 + 1.5 * (q3 - q1) AS high_fence FROM q) "
    "SELECT event_type, 'value' AS variable, "
    + ", ".join(f"{rd(c)} AS {c}" for c in ("q1", "median", "q3", "low_fence", "high_fence"))
    + ", count(*) AS n, "
    + rd("min(CASE WHEN value BETWEEN low_fence AND high_fence THEN value END)")
    + " AS whisker_low, "
    + rd("max(CASE WHEN value BETWEEN low_fence AND high_fence THEN value END)")
    + " AS whisker_high, "
    "count(CASE WHEN value NOT BETWEEN low_fence AND high_fence THEN 1 END) AS n_outliers "
    "FROM events JOIN f USING (event_type) GROUP BY event_type, f.q1, f.median, f.q3, "
    "f.low_fence, f.high_fence",
)
def box_stats(spark, sf):
    return rounded(explore.box_stats(table(spark, sf, "events"), ["value"], ["event_type"]))


@query(
    "quantiles_by_bracket",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        "SELECT l_returnflag, '{v}' AS variable, " + ", ".join(
            rd(f"quantile_cont({{v}}, {p})", 4) + f" AS q{int(p * 100)}"
            for p in (0.05, 0.25, 0.5, 0.95)
        ) + " FROM li GROUP BY l_returnflag",
    ),
)
def quantiles_by_bracket(spark, sf):
    rows = exact_quantiles(
        lineitem(spark, sf), MEASURES, [0.05, 0.25, 0.5, 0.95], ["l_returnflag"]
    )
    return rounded(rows.select(
        "l_returnflag", "variable",
        *[F.col("q")[i].alias(n) for i, n in enumerate(("q5", "q25", "q50", "q95"))]), 4)


# ---------------------------------------------------------------- dictionary

_CASES = " UNION ALL ".join(
    f"SELECT '{c}' AS category, variable FROM words WHERE "
    + " OR ".join(f"contains(variable, '{m}')" for m in marks)
    for c, marks in names.CATEGORY_PATTERNS.items() if marks
)


@query("categorize", f"WITH {WORDS} {_CASES}")
def categorize(spark, sf):
    return names.categorize(words(spark, sf)).select("category", "variable")


@query("category_sizes", f"WITH {WORDS}, c AS ({_CASES}) "
       "SELECT category, count(*) AS n_variables FROM c GROUP BY category")
def category_sizes(spark, sf):
    return names.category_sizes(names.categorize(words(spark, sf)))


_ORDER = "CASE category " + " ".join(
    f"WHEN '{c}' THEN {i}" for i, c in enumerate(names.CATEGORY_PATTERNS)) + " END"


@query(
    "first_category",
    f"WITH {WORDS}, c AS ({_CASES}), b AS (SELECT variable, arg_min(category, {_ORDER}) AS "
    "category FROM c GROUP BY variable) SELECT variable, coalesce(category, 'uncategorized') "
    "AS category FROM words LEFT JOIN b USING (variable)",
)
def first_category(spark, sf):
    return names.first_category(words(spark, sf))


@query(
    "outcome_variables",
    f"WITH {WORDS} SELECT variable FROM words WHERE " + " OR ".join(
        f"contains(variable, '{m}')"
        for m in [*names.CATEGORY_PATTERNS["outcome"], *names.OUTCOME_MARKS]),
)
def outcome_variables(spark, sf):
    return names.outcome_variables(words(spark, sf))


_VISIT_CASES = _CASES.replace("FROM words", "FROM visits").replace(
    "contains(variable", "contains(lower(variable)")


@query("visit_categories", f"WITH {VISITS}, c AS ({_VISIT_CASES}) "
       "SELECT category, count(*) AS n_variables FROM c GROUP BY category")
def visit_categories(spark, sf):
    return names.category_sizes(names.categorize(visits(spark, sf)))


def _marked_sql(categories: list[str], marks: list[str]) -> str:
    return f"WITH {VISITS} SELECT variable FROM visits WHERE " + " OR ".join(
        [f"contains(lower(variable), '{m}')" for c in categories for m in names.CATEGORY_PATTERNS[c]]
        + [f"contains(variable, '{m}')" for m in marks])


@query("baseline_variables", _marked_sql(["baseline", "demographic"], names.BASELINE_MARKS))
def baseline_variables(spark, sf):
    return names.baseline_variables(visits(spark, sf))


@query("visit_outcomes", _marked_sql(["outcome"], names.OUTCOME_MARKS))
def visit_outcomes(spark, sf):
    return names.outcome_variables(visits(spark, sf))


_KINDS_OF = {"amount": ["quantity"], "money": ["price", "tax", "discount"], "code": ["flag", "status"]}
_KIND_CASES = " UNION ALL ".join(
    f"SELECT '{c}' AS category, variable FROM m WHERE "
    + " OR ".join(f"contains(variable, '{x}')" for x in marks) for c, marks in _KINDS_OF.items())


@query(
    "missing_by_category",
    MISSING_SQL + f", c AS ({_KIND_CASES}) SELECT category, variable, missing_values, "
    f"{rd('percentage')} AS percentage FROM c JOIN m USING (variable) WHERE missing_values > 0",
)
def missing_by_category(spark, sf):
    report = missing.missing_report(lineitem(spark, sf).select(*KINDS))
    kinds = names.categorize(report, _KINDS_OF)
    return rounded(missing.missing_by_category(kinds, report).select(
        "category", "variable", "missing_values", "percentage"))


@query(
    "save_and_load",
    f"WITH {PARTS} SELECT p_partkey, {rd('p_size')} AS p_size, {rd('avg_qty')} AS avg_qty FROM pa",
)
def save_and_load(spark, sf):
    """Some columns written to the shared folder and read back as a study."""
    path = f"{shared_folder(spark)}/study-{uuid.uuid4().hex}"
    tables.save_table(parts(spark, sf), path, columns=["p_partkey", "p_size", "avg_qty"])
    return rounded(tables.load_study(spark, path)[0])


def _asked(spark, sf):
    """Names to look up: full names, other case, parts of names, and unknown ones."""
    d = dictionary(spark, sf)
    return (
        d.select("variable")
        .union(d.select(F.upper("variable")))
        .union(table(spark, sf, "part").select(F.upper("p_name")))
        .union(table(spark, sf, "supplier").select("s_name"))
        .distinct()
    )


@query(
    "describe_variables",
    f"WITH {DICTIONARY}, asked AS (SELECT variable FROM dict UNION SELECT upper(variable) FROM "
    "dict UNION SELECT upper(p_name) FROM part UNION SELECT s_name FROM supplier), "
    "hits AS (SELECT a.variable, d.description, d.ord, CASE WHEN d.variable = a.variable THEN 1 "
    "WHEN lower(d.variable) = lower(a.variable) THEN 2 ELSE 3 END AS rule FROM asked a JOIN dict d "
    "ON contains(lower(d.variable), lower(a.variable))), "
    "best AS (SELECT variable, description FROM hits QUALIFY row_number() OVER "
    "(PARTITION BY variable ORDER BY rule, ord) = 1) "
    "SELECT variable, description FROM asked LEFT JOIN best USING (variable)",
)
def describe_variables(spark, sf):
    return names.describe_variables(_asked(spark, sf), dictionary(spark, sf))


@query(
    "dictionary_search",
    f"WITH {DICTIONARY} SELECT * FROM dict WHERE regexp_matches(variable, '(?i)^RED.*[37]$') "
    "OR regexp_matches(description, '(?i)^RED.*[37]$') "
    "OR regexp_matches(CAST(ord AS VARCHAR), '(?i)^RED.*[37]$')",
)
def dictionary_search(spark, sf):
    return names.search_dictionary(dictionary(spark, sf), "^RED.*[37]$")


@query(
    "prefix_groups",
    f"WITH {DICTIONARY}, p AS (SELECT CASE WHEN contains(variable, '.') THEN "
    "split_part(variable, '.', 1) ELSE 'General' END AS prefix, variable, ord FROM dict), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY ord) AS r FROM p) "
    "SELECT prefix, count(*) AS n_variables, string_agg(variable, '|' ORDER BY ord) FILTER "
    "(r <= 10) AS examples FROM r GROUP BY prefix",
)
def prefix_groups(spark, sf):
    return names.prefix_groups(dictionary(spark, sf)).withColumn(
        "examples", F.array_join("examples", "|"))


_SCALES = ["small", "red", "blue", "large"]


@query(
    "scale_timepoints",
    f"WITH {DICTIONARY}, s AS (SELECT unnest({_SCALES!r}) AS scale), "
    "o AS (SELECT scale, variable, description, ord FROM s JOIN dict "
    "ON starts_with(variable, scale)), "
    "c AS (SELECT scale, regexp_extract(variable, '[.](0|5|10)$', 1) AS time_point, "
    "count(*) AS n_measurements FROM o WHERE regexp_matches(variable, '[.](0|5|10)$') "
    "GROUP BY ALL), b AS (SELECT scale, arg_min(description, ord) AS scale_description FROM o "
    "WHERE NOT contains(variable, '.') GROUP BY scale) "
    "SELECT scale, time_point, n_measurements, scale_description FROM c LEFT JOIN b USING (scale)",
)
def scale_timepoints(spark, sf):
    return names.scale_timepoints(dictionary(spark, sf), _SCALES)


@query(
    "term_counts",
    "WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1)) AS term "
    "FROM documents) SELECT term, count(*) AS n FROM t WHERE NOT regexp_matches(term, '^[0-9]+$') "
    f"AND term NOT IN ({', '.join(repr(w) for w in names.STOPWORDS)}) GROUP BY term "
    "ORDER BY n DESC, term LIMIT 100",
)
def term_counts(spark, sf):
    return names.term_counts(table(spark, sf, "documents"), "text", 100)


# ---------------------------------------------------------------- imputation


def _filled(fn: str) -> str:
    return (
        f"WITH {LINEITEM}, m AS (SELECT "
        + ", ".join(f"{fn}({v}) AS m_{v}" for v in MEASURES)
        + " FROM li) SELECT l_orderkey, l_partkey, l_linenumber, "
        + ", ".join(f"{rd(f'coalesce({v}, m_{v})')} AS {v}" for v in MEASURES)
        + " FROM li, m"
    )


def _imputed(spark, sf, method, **kw):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    return impute.impute(lineitem(spark, sf), method, exclude=keys, **kw)


@query("impute_mean", _filled("avg"))
def impute_mean(spark, sf):
    return rounded(_imputed(spark, sf, "mean").drop("l_returnflag", "l_linestatus"))


@query("impute_median", _filled("median"))
def impute_median(spark, sf):
    return rounded(_imputed(spark, sf, "median").drop("l_returnflag", "l_linestatus"))


PART_COLS = ["p_size", "p_retailprice", "avg_qty"]
_KNN = (
    f"WITH {PARTS}, s AS (SELECT "
    + ", ".join(f"avg({v}) AS m_{v}, stddev_pop({v}) AS s_{v}" for v in PART_COLS)
    + " FROM pa), z AS (SELECT p_partkey, "
    + ", ".join(f"({v} - m_{v}) / s_{v} AS z_{v}" for v in PART_COLS)
    + " FROM pa, s), d AS (SELECT r.p_partkey AS id, g.p_partkey AS donor, "
    + ", ".join(f"r.z_{v} AS r_{v}, g.z_{v} AS g_{v}" for v in PART_COLS)
    + ", 3.0 * (" + " + ".join(f"coalesce((r.z_{v} - g.z_{v}) ** 2, 0)" for v in PART_COLS)
    + ") / nullif(" + " + ".join(
        f"CASE WHEN r.z_{v} IS NULL OR g.z_{v} IS NULL THEN 0 ELSE 1 END" for v in PART_COLS)
    + ", 0) AS d2 FROM z r JOIN z g ON r.p_partkey <> g.p_partkey WHERE "
    + " OR ".join(f"r.z_{v} IS NULL" for v in PART_COLS) + "), n AS ("
    + " UNION ALL ".join(
        f"SELECT id, '{v}' AS v, avg(g_{v}) AS z FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY id ORDER BY d2, donor) AS r FROM d WHERE r_{v} IS NULL AND "
        f"g_{v} IS NOT NULL AND d2 IS NOT NULL) WHERE r <= 5 GROUP BY id"
        for v in PART_COLS)
    + ") SELECT p_partkey, "
    + ", ".join(
        rd(f"coalesce({v}, coalesce((SELECT z FROM n WHERE n.id = p_partkey AND n.v = '{v}'), 0)"
           f" * s_{v} + m_{v})") + f" AS {v}" for v in PART_COLS)
    + " FROM pa, s"
)


@query("impute_knn", _KNN)
def impute_knn(spark, sf):
    return rounded(impute.impute(parts(spark, sf), "knn", "p_partkey", 5))


@query(
    "imputation_summary",
    f"WITH {LINEITEM} " + union(
        MEASURES, "SELECT '{v}' AS variable, count(*) - count({v}) AS missing_before, "
        "count(*) - count({v}) AS filled, CAST(0 AS BIGINT) AS remaining FROM li"),
)
def imputation_summary(spark, sf):
    return impute.imputation_summary(
        lineitem(spark, sf), _imputed(spark, sf, "mean"), MEASURES)


@query(
    "imputed_variables",
    f"WITH {LINEITEM} SELECT * FROM (" + union(
        MEASURES, "SELECT '{v}' AS variable, count(*) - count({v}) AS missing_before, "
        "count(*) - count({v}) AS filled, CAST(0 AS BIGINT) AS remaining FROM li")
    + ") WHERE filled > 0",
)
def imputed_variables(spark, sf):
    return impute.imputed_variables(lineitem(spark, sf), _imputed(spark, sf, "mean"), MEASURES)


def _summary_sql(stage: str, value: str) -> str:
    return union(
        MEASURES, f"SELECT '{stage}' AS stage, '{{v}}' AS variable, count({value}) AS n, "
        + ", ".join(f"{rd(e.replace('#', value), 4)} AS {n}" for n, e in {
            "mean": "avg(#)", "median": "median(#)", "std": "stddev_samp(#)", "min": "min(#)",
            "max": "max(#)"}.items())
        + f", count(*) - count({value}) AS missing, "
        + rd(f"(count(*) - count({value})) * 100.0 / count(*)", 4) + " AS missing_pct FROM li, m")


@query(
    "imputation_before_after",
    f"WITH {LINEITEM}, m AS (SELECT " + ", ".join(f"avg({v}) AS m_{v}" for v in MEASURES)
    + " FROM li) " + _summary_sql("before", "{v}") + " UNION ALL "
    + _summary_sql("after", "coalesce({v}, m_{v})"),
)
def imputation_before_after(spark, sf):
    return rounded(impute.before_after(
        lineitem(spark, sf), _imputed(spark, sf, "mean"), MEASURES), 4)


_STATUS = (
    f"WITH {LINEITEM}, m AS (SELECT " + ", ".join(f"median({v}) AS m_{v}" for v in MEASURES)
    + " FROM li), st AS (" + union(
        MEASURES, "SELECT '{v}' AS variable, CASE WHEN {v} IS NULL THEN 'Imputed' ELSE 'Original' "
        "END AS status, coalesce({v}, m_{v}) AS value FROM li, m") + ")"
)


@query(
    "imputation_validation",
    _STATUS + " SELECT variable, status, count(*) AS n, " + ", ".join(
        f"{rd(e, 4)} AS {n}" for n, e in {
            "mean": "avg(value)", "median": "median(value)", "std": "stddev_samp(value)",
            "min": "min(value)", "max": "max(value)"}.items())
    + " FROM st GROUP BY variable, status",
)
def imputation_validation(spark, sf):
    return rounded(
        impute.imputation_validation(_imputed(spark, sf, "median", flags=True), MEASURES), 4)


_WELCH = (
    " SELECT variable, n1, n2, {t} AS t, {d} AS df FROM (SELECT *, v1 / n1 AS a, v2 / n2 AS b "
    "FROM w)"
).format(
    t=rd("(m1 - m2) / sqrt(a + b)"),
    d=rd("(a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))", 2),
)


@query(
    "imputation_test",
    _STATUS + ", w AS (SELECT variable, "
    + ", ".join(
        f"{fn}(CASE WHEN status = '{s}' THEN value END) AS {n}{i}"
        for i, s in ((1, "Original"), (2, "Imputed"))
        for n, fn in (("n", "count"), ("m", "avg"), ("v", "var_samp")))
    + " FROM st GROUP BY variable)" + _WELCH,
)
def imputation_test(spark, sf):
    tested = impute.imputation_test(_imputed(spark, sf, "median", flags=True), MEASURES)
    return rounded(tested.select("variable", "n1", "n2", "t"), 6).join(
        rounded(tested.select("variable", "df"), 2), "variable")


@query(
    "welch_t",
    "WITH w AS (SELECT 'value' AS variable, " + ", ".join(
        f"{fn}(CASE WHEN event_type = '{s}' THEN value END) AS {n}{i}"
        for i, s in ((1, "click"), (2, "view"))
        for n, fn in (("n", "count"), ("m", "avg"), ("v", "var_samp"))) + " FROM events)" + _WELCH,
)
def welch_t(spark, sf):
    long = table(spark, sf, "events").select(
        F.lit("value").alias("variable"), "event_type", "value")
    tested = impute.welch_t(long, "event_type", "click", "view")
    return rounded(tested.select("variable", "n1", "n2", "t"), 6).join(
        rounded(tested.select("variable", "df"), 2), "variable")


# ---------------------------------------------------------------- screening


@query(
    "near_zero_variance",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        "SELECT '{v}' AS variable, CAST(sum(CASE WHEN {v} IS NULL THEN 0 ELSE 1 END) AS BIGINT) "
        "AS n_unique, " + rd("max(CASE WHEN {v} IS NULL THEN 0 ELSE m END) / sum(m)")
        + " AS most_common_freq, sum(CASE WHEN {v} IS NULL THEN 0 ELSE 1 END) < "
        "greatest(2, floor(sum(m) * 0.01)) AS is_near_zero "
        "FROM (SELECT {v}, count(*) AS m FROM li GROUP BY {v})"),
)
def near_zero_variance(spark, sf):
    return rounded(screen.near_zero_variance(lineitem(spark, sf), 0.01, MEASURES))


@query(
    "correlation",
    f"WITH {LINEITEM} " + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {rd(f'corr({a}, {b})')} AS r FROM li"
        for a, b in PAIRS),
)
def correlation(spark, sf):
    return rounded(screen.correlation(lineitem(spark, sf), MEASURES))


_WIDE = (
    "WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, "
    "generate_subscripts(embedding, 1) AS j FROM embeddings) "
    "SELECT 'e' || a.j AS var1, 'e' || b.j AS var2, " + rd("corr(a.v, b.v)")
    + " AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.j < b.j GROUP BY a.j, b.j"
)


@query("correlation_wide", _WIDE)
def correlation_wide(spark, sf):
    from suite.inputs import WIDTH, dimensions

    cols = [f"e{i + 1}" for i in range(WIDTH)]
    return rounded(correlations(dimensions(spark, sf, WIDTH), cols).select("var1", "var2", "r"))


# Prices with and without tax are nearly collinear, and the quantity has few values.
SCREEN = ["l_quantity", "l_extendedprice", "gross"]
_SCREEN_SQL = (
    f"WITH {LINEITEM}, sc AS (SELECT l_orderkey, l_quantity, l_extendedprice, "
    "l_extendedprice * (1 + l_tax) AS gross FROM li), "
    "cc AS (SELECT * FROM sc WHERE l_quantity IS NOT NULL AND gross IS NOT NULL), "
    "r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, gross) AS ac, "
    "corr(l_extendedprice, gross) AS bc FROM cc), v AS ("
    "SELECT 'l_quantity' AS variable, 1 / (1 - (ab*ab + ac*ac - 2*ab*ac*bc) / (1 - bc*bc)) AS vif "
    "FROM r UNION ALL SELECT 'l_extendedprice', "
    "1 / (1 - (ab*ab + bc*bc - 2*ab*ac*bc) / (1 - ac*ac)) FROM r "
    "UNION ALL SELECT 'gross', 1 / (1 - (ac*ac + bc*bc - 2*ab*ac*bc) / (1 - ab*ab)) FROM r)"
)


def _screened(spark, sf):
    li = lineitem(spark, sf)
    return li.select(
        "l_orderkey", "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"))


@query("vif", _SCREEN_SQL + f" SELECT variable, {rd('vif', 3)} AS vif FROM v")
def vif(spark, sf):
    return rounded(screen.vif(_screened(spark, sf), SCREEN), 3)


@query("high_vif", _SCREEN_SQL + f" SELECT variable, {rd('vif', 3)} AS vif FROM v WHERE vif > 2 "
       "ORDER BY v.vif DESC, variable LIMIT 20")
def high_vif(spark, sf):
    return rounded(screen.high_vif(screen.vif(_screened(spark, sf), SCREEN), 2.0), 3)


_PAIR_SQL = ", p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM sc"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "gross"),
                 ("l_extendedprice", "gross"))) + ")"


@query("collinear_pairs", _SCREEN_SQL + _PAIR_SQL
       + f" SELECT var1, var2, {rd('abs(r)')} AS correlation FROM p WHERE abs(r) >= 0.85")
def collinear_pairs(spark, sf):
    return rounded(screen.collinear_pairs(_screened(spark, sf), 0.85, SCREEN))


@query(
    "correlation_degree",
    _SCREEN_SQL + _PAIR_SQL + ", e AS (SELECT var1 AS node FROM p WHERE abs(r) >= 0.5 UNION ALL "
    "SELECT var2 FROM p WHERE abs(r) >= 0.5) SELECT n.node, count(e.node) AS degree FROM "
    f"(SELECT unnest({SCREEN!r}) AS node) n LEFT JOIN e ON e.node = n.node GROUP BY n.node",
)
def correlation_degree(spark, sf):
    return screen.correlation_network(_screened(spark, sf), 0.5, SCREEN)[1]


@query(
    "correlation_edges",
    f"WITH {LINEITEM}, p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r FROM li" for a, b in PAIRS)
    + "), e AS (SELECT * FROM p WHERE abs(r) >= 0.001), s AS (SELECT min(abs(r)) AS lo, "
    f"max(abs(r)) AS hi FROM e) SELECT var1, var2, {rd('r')} AS r, "
    + rd("1 + (abs(r) - lo) / (hi - lo) * 9") + " AS width FROM e, s",
)
def correlation_edges(spark, sf):
    return rounded(screen.correlation_network(lineitem(spark, sf), 0.001, MEASURES)[0])


_DECIDE = (
    _SCREEN_SQL + _PAIR_SQL + ", nz AS (" + union(
        SCREEN, "SELECT '{v}' AS variable FROM sc HAVING count(DISTINCT {v}) < "
        "greatest(2, floor(count(*) * 0.01))")
    + "), col AS (SELECT DISTINCT var2 AS variable FROM p WHERE abs(r) >= 0.85), "
    "hv AS (SELECT variable FROM v WHERE vif > 5)"
)


@query(
    "recommend_variables",
    _DECIDE + f", a AS (SELECT unnest({['l_orderkey', *SCREEN]!r}) AS variable), f AS (SELECT "
    "variable, variable IN (SELECT variable FROM nz) AS n, variable IN (SELECT variable FROM col) "
    "AS c, variable IN (SELECT variable FROM hv) AS h FROM a) SELECT variable, "
    "(NOT n AND NOT c AND NOT h) OR variable = 'l_extendedprice' AS recommended, "
    "concat_ws('|', CASE WHEN n THEN 'near_zero_variance' END, CASE WHEN c THEN 'collinear' END, "
    "CASE WHEN h THEN 'high_vif' END) AS reasons FROM f",
)
def recommend_variables(spark, sf):
    decisions, _ = screen.recommend_variables(
        _screened(spark, sf), force_include=["l_extendedprice"], id_col="l_orderkey")
    return decisions.withColumn("reasons", F.array_join("reasons", "|"))


_FIRST_KIND = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(variable, '{x}')" for x in marks) + f" THEN '{c}'"
    for c, marks in _KINDS_OF.items()) + " ELSE 'uncategorized' END"


@query(
    "recommended_by_category",
    ORACLES["recommend_variables"].replace("SELECT variable, (NOT n", f"SELECT {_FIRST_KIND} AS "
    "category, variable FROM (SELECT variable, (NOT n", 1) + ") WHERE recommended",
)
def recommended_by_category(spark, sf):
    return screen.recommended_by_category(recommend_variables(spark, sf), _KINDS_OF)


@query(
    "ols_trend",
    f"WITH {LINEITEM} SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, "
    + ", ".join(f"{rd(f'regr_{f}(l_extendedprice, l_quantity)', 4)} AS {f}"
                for f in ("slope", "intercept", "r2")) + " FROM li",
)
def ols_trend(spark, sf):
    return rounded(screen.ols_trend(lineitem(spark, sf), "l_quantity", "l_extendedprice"), 4)


# ---------------------------------------------------------------- quality


def _outliers(spark, sf, method, threshold):
    return rounded(quality.detect_outliers(lineitem(spark, sf), method, threshold, MEASURES), 4)


@query(
    "outliers_iqr",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        "SELECT '{v}' AS variable, " + ", ".join(
            f"{rd(e, 4)} AS {n}" for n, e in {
                "q1": "q1", "q3": "q3", "iqr": "q3 - q1", "lower_bound": "q1 - 0.4 * (q3 - q1)",
                "upper_bound": "q3 + 0.4 * (q3 - q1)"}.items())
        + ", count(CASE WHEN {v} < q1 - 0.4 * (q3 - q1) OR {v} > q3 + 0.4 * (q3 - q1) THEN 1 END) "
        "AS n_outliers, " + rd("count(CASE WHEN {v} < q1 - 0.4 * (q3 - q1) OR {v} > q3 + 0.4 * "
                               "(q3 - q1) THEN 1 END) * 100.0 / count(*)", 4)
        + " AS outlier_percentage FROM li, (SELECT quantile_cont({v}, 0.25) AS q1, "
        "quantile_cont({v}, 0.75) AS q3 FROM li) GROUP BY q1, q3"),
)
def outliers_iqr(spark, sf):
    return _outliers(spark, sf, "iqr", 0.4).drop("center", "scale")


@query(
    "outliers_zscore",
    f"WITH {LINEITEM} " + union(
        MEASURES,
        f"SELECT '{{v}}' AS variable, {rd('m', 4)} AS center, {rd('s', 4)} AS scale, "
        "count(CASE WHEN abs(({v} - m) / s) > 1.6 THEN 1 END) AS n_outliers, "
        + rd("count(CASE WHEN abs(({v} - m) / s) > 1.6 THEN 1 END) * 100.0 / count(*)", 4)
        + " AS outlier_percentage FROM li, (SELECT avg({v}) AS m, stddev_pop({v}) AS s FROM li) "
        "GROUP BY m, s"),
)
def outliers_zscore(spark, sf):
    return _outliers(spark, sf, "zscore", 1.6).select(
        "variable", "center", "scale", "n_outliers", "outlier_percentage")


@query(
    "outliers_modified_zscore",
    f"SELECT 'value' AS variable, {rd('m', 4)} AS center, {rd('s', 4)} AS scale, "
    "count(CASE WHEN 0.6745 * abs(value - m) / s > 3.5 THEN 1 END) AS n_outliers, "
    + rd("count(CASE WHEN 0.6745 * abs(value - m) / s > 3.5 THEN 1 END) * 100.0 / count(*)", 4)
    + " AS outlier_percentage FROM events, (SELECT median(value) AS m, mad(value) AS s "
    "FROM events) GROUP BY m, s",
)
def outliers_modified_zscore(spark, sf):
    return rounded(
        quality.detect_outliers(table(spark, sf, "events"), "modified_zscore", 3.5, ["value"]), 4
    ).select("variable", "center", "scale", "n_outliers", "outlier_percentage")


@query(
    "outlier_rows",
    "SELECT event_id, 'value' AS variable, value FROM events, (SELECT quantile_cont(value, 0.25) "
    "AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE value < q1 - 1.5 * (q3 - q1) "
    "OR value > q3 + 1.5 * (q3 - q1)",
)
def outlier_rows(spark, sf):
    return quality.outlier_rows(table(spark, sf, "events"), "event_id", cols=["value"])


@query(
    "outlier_summary",
    "SELECT CAST(1 AS BIGINT) AS variables_checked, CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END "
    "AS BIGINT) AS variables_with_outliers, count(*) AS total_outliers FROM events, "
    "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) "
    "WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
)
def outlier_summary(spark, sf):
    return quality.outlier_summary(
        quality.detect_outliers(table(spark, sf, "events"), "iqr", 1.5, ["value"]))


SHAPES = ["value", "squared"]
_SHAPE_SRC = "WITH ev AS (SELECT event_id, value, value * value AS squared FROM events)"
_SHAPE = ", sh AS (" + union(
    SHAPES,
    "SELECT '{v}' AS variable, count({v}) AS n_samples, avg({v}) AS mean, median({v}) AS median, "
    "stddev_pop({v}) AS std, min({v}) AS min, max({v}) AS max, "
    "avg(({v} - m) ** 3) / stddev_pop({v}) ** 3 AS skewness, kurtosis_pop({v}) AS kurtosis "
    "FROM ev, (SELECT avg({v}) AS m FROM ev)") + ")"


def _shapes(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "value", (F.col("value") * F.col("value")).alias("squared"))


@query(
    "distributions",
    _SHAPE_SRC + _SHAPE + " SELECT variable, n_samples, " + ", ".join(
        f"{rd(c, 4)} AS {c}" for c in
        ("mean", "median", "std", "min", "max", "skewness", "kurtosis"))
    + f", {rd('abs(mean - median)', 4)} AS mean_median_difference FROM sh",
)
def distributions(spark, sf):
    return rounded(quality.distributions(_shapes(spark, sf), SHAPES), 4)


@query(
    "distribution_summary",
    _SHAPE_SRC + _SHAPE + " SELECT count(*) AS variables_analyzed, count(CASE WHEN abs(skewness) "
    "> 1 THEN 1 END) AS skewed_variables, count(CASE WHEN abs(skewness) > 2 THEN 1 END) AS "
    "highly_skewed_variables FROM sh",
)
def distribution_summary(spark, sf):
    return quality.distribution_summary(quality.distributions(_shapes(spark, sf), SHAPES))


@query(
    "recommend_transforms",
    _SHAPE_SRC + _SHAPE + " SELECT variable, CASE WHEN abs(skewness) <= 0.5 THEN 'none' WHEN "
    "skewness > 2 THEN 'log' WHEN skewness > 1 THEN 'sqrt' WHEN skewness < -1 THEN 'square' ELSE "
    f"'yeo-johnson' END AS recommendation, {rd('skewness', 4)} AS skewness FROM sh",
)
def recommend_transforms(spark, sf):
    advice = quality.recommend_transformations(
        quality.distributions(_shapes(spark, sf), SHAPES))
    return rounded(advice.select("variable", "recommendation", "skewness"), 4)


_LOW = "(SELECT min(value - 5) AS lo FROM events)"


def _transform(spark, sf, kind):
    e = table(spark, sf, "events").select("event_id", (F.col("value") - 5).alias("value"))
    return rounded(quality.apply_transformations(e, {"value": kind}, "event_id")[0])


@query("transform_log", "SELECT event_id, " + rd(
    "ln(value - 5 + CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END)")
    + f" AS value FROM events, {_LOW}")
def transform_log(spark, sf):
    return _transform(spark, sf, "log")


@query("transform_sqrt", "SELECT event_id, " + rd(
    "sqrt(value - 5 + CASE WHEN lo < 0 THEN abs(lo) + 0.01 ELSE 0 END)")
    + f" AS value FROM events, {_LOW}")
def transform_sqrt(spark, sf):
    return _transform(spark, sf, "sqrt")


@query("transform_square", f"SELECT event_id, {rd('(value - 5) * (value - 5)')} AS value "
       "FROM events")
def transform_square(spark, sf):
    return _transform(spark, sf, "square")


@query(
    "applied_transformations",
    "WITH e AS (SELECT min(value - 5) AS lo, min(value * value) AS sq FROM events), "
    "o AS (SELECT CASE WHEN lo <= 0 THEN abs(lo) + 1 ELSE 0 END AS a, "
    "CASE WHEN sq < 0 THEN abs(sq) + 0.01 ELSE 0 END AS b FROM e) "
    f"SELECT 'value' AS variable, 'log' AS type, {rd('a')} AS offset FROM o UNION ALL "
    f"SELECT 'squared', 'sqrt', {rd('b')} FROM o UNION ALL SELECT 'event_id', 'square', NULL FROM o",
)
def applied_transformations(spark, sf):
    """What was applied: kinds and offsets (the identifier is squared as a plain number here)."""
    e = table(spark, sf, "events").select(
        "event_id", (F.col("value") - 5).alias("value"), (F.col("value") * F.col("value")).alias("squared"))
    plan = {"value": "log", "squared": "sqrt", "event_id": "square", "none": "log"}
    return rounded(quality.apply_transformations(e, plan)[1].select("variable", "type", "offset"))


def _power_grid(name: str, values: str, source: str = "") -> str:
    """Best exponent per variable on a grid of g, as two common table expressions."""
    up, down = "ln(1 + abs(x))", "(2 - g)"
    psi = (f"CASE WHEN x >= 0 THEN CASE WHEN g = 0 THEN {up} ELSE (exp({up} * g) - 1) / g END ELSE CASE WHEN g = 2 "
           f"THEN -{up} ELSE -(exp({up} * {down}) - 1) / {down} END END")
    return (f"{name} AS (SELECT variable, g, -n / 2.0 * ln(v) + (g - 1) * j AS fit FROM (SELECT variable, g, "
            f"var_pop({psi}) AS v, count(x) AS n, sum(sign(x) * {up}) AS j FROM (SELECT s.variable, x, {values} AS g "
            f"FROM sv s {source}) GROUP BY variable, g)), "
            f"{name}_best AS (SELECT variable, arg_max(g, fit) AS b FROM {name} GROUP BY variable)")


_POWER = (
    "WITH sv AS (SELECT event_id, 'value' AS variable, value AS x FROM events UNION ALL "
    "SELECT event_id, 'squared', value * value FROM events), "
    + _power_grid("ga", "(i - 24) / 4.0::DOUBLE", ", range(49) t(i)") + ", "
    + _power_grid("gb", "b + (i - 8) / 32.0::DOUBLE", "JOIN ga_best USING (variable), range(17) t(i)") + ", "
    + _power_grid("gc", "b + (i - 8) / 256.0::DOUBLE", "JOIN gb_best USING (variable), range(17) t(i)") + ", "
    "la AS (SELECT variable, b + CASE WHEN lo + hi - 2 * top < 0 THEN (lo - hi) / (lo + hi - 2 * top) / 512 ELSE 0 END "
    "AS lam FROM (SELECT variable, b, max(CASE WHEN g = b THEN fit END) AS top, max(CASE WHEN g = b - 1 / 256.0::DOUBLE "
    "THEN fit END) AS lo, max(CASE WHEN g = b + 1 / 256.0::DOUBLE THEN fit END) AS hi FROM gc JOIN gc_best "
    "USING (variable) GROUP BY variable, b)), "
    "ps AS (SELECT event_id, variable, CASE WHEN x >= 0 THEN (exp(ln(1 + abs(x)) * lam) - 1) / lam ELSE "
    "-(exp(ln(1 + abs(x)) * (2 - lam)) - 1) / (2 - lam) END AS y FROM sv JOIN la USING (variable)), "
    "ms AS (SELECT variable, avg(y) AS m, stddev_pop(y) AS s FROM ps GROUP BY variable) "
)


@query(
    "yeo_johnson",
    _POWER + "SELECT event_id, " + ", ".join(
        rd(f"max(CASE WHEN variable = '{v}' THEN (y - m) / s END)", 3) + f" AS {v}" for v in SHAPES)
    + " FROM ps JOIN ms USING (variable) GROUP BY event_id",
)
def yeo_johnson(spark, sf):
    """Both variables at their likeliest exponent, standardised, on the grids of the SQL."""
    return rounded(quality.apply_transformations(
        _shapes(spark, sf), {"value": "yeo-johnson", "squared": "yeo-johnson"}, "event_id")[0], 3)


@query("yeo_johnson_exponents",
       _POWER + f"SELECT variable, 'yeo-johnson' AS type, {rd('lam')} AS lambda FROM la")
def yeo_johnson_exponents(spark, sf):
    return rounded(quality.apply_transformations(
        _shapes(spark, sf), {"value": "yeo-johnson", "squared": "yeo-johnson"}, "event_id")[1]
        .select("variable", "type", "lambda"))


@query("transform_effect")
def transform_effect(spark, sf):
    return quality.transform_effect(
        table(spark, sf, "events"), "value", None, 50, "event_id")[0]


@query("shapiro")
def shapiro(spark, sf):
    return quality.shapiro(_shapes(spark, sf), SHAPES, "event_id")


def _scaled(fit: str, expr: str) -> str:
    return (
        f"WITH {LINEITEM}, m AS (SELECT " + ", ".join(fit.replace("{v}", v) for v in MEASURES)
        + " FROM li) SELECT l_orderkey, l_partkey, l_linenumber, "
        + ", ".join(f"{rd(expr.replace('{v}', v))} AS {v}" for v in MEASURES) + " FROM li, m"
    )


def _standard(spark, sf, method):
    li = lineitem(spark, sf).drop("l_returnflag", "l_linestatus")
    return rounded(quality.standardize(li, method, MEASURES)[0])


@query("standardize_zscore", _scaled("avg({v}) AS m_{v}, stddev_pop({v}) AS s_{v}",
                                     "({v} - m_{v}) / s_{v}"))
def standardize_zscore(spark, sf):
    return _standard(spark, sf, "zscore")


@query("standardize_robust", _scaled(
    "median({v}) AS m_{v}, quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS s_{v}",
    "({v} - m_{v}) / s_{v}"))
def standardize_robust(spark, sf):
    return _standard(spark, sf, "robust")


@query("standardize_minmax", _scaled("min({v}) AS m_{v}, max({v}) - min({v}) AS s_{v}",
                                     "({v} - m_{v}) / s_{v}"))
def standardize_minmax(spark, sf):
    return _standard(spark, sf, "minmax")


def _details_sql(method: str, center: str, scale: str) -> str:
    return f"WITH {LINEITEM} " + union(
        MEASURES, f"SELECT '{{v}}' AS variable, '{method}' AS method, "
        f"{rd(center, 5)} AS center, {rd(scale, 5)} AS scale FROM li")


def _details(spark, sf, method):
    return rounded(quality.standardize(lineitem(spark, sf), method, MEASURES)[1].drop("formula"), 5)


@query("zscore_details", _details_sql("zscore", "avg({v})", "stddev_pop({v})"))
def zscore_details(spark, sf):
    return _details(spark, sf, "zscore")


@query("robust_details", _details_sql(
    "robust", "median({v})", "quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)"))
def robust_details(spark, sf):
    return _details(spark, sf, "robust")


@query("minmax_details", _details_sql("minmax", "min({v})", "max({v}) - min({v})"))
def minmax_details(spark, sf):
    return _details(spark, sf, "minmax")


# ---------------------------------------------------------------- reduction

# Two standardised columns with correlation r have components (z1 ± z2) / √2 with shares
# (1 ± |r|) / 2; an indicator pair of a two-level factor acts as one standardised column.
_TWO = "cc AS (SELECT * FROM li WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"


@query(
    "pca_variance",
    f"WITH {LINEITEM}, {_TWO}, r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM cc) "
    f"SELECT CAST(1 AS INTEGER) AS component, {rd('(1 + r) / 2')} AS explained_variance, "
    f"{rd('(1 + r) / 2')} AS cumulative_variance FROM r UNION ALL SELECT 2, {rd('(1 - r) / 2')}, "
    f"{rd('1')} FROM r",
)
def pca_variance(spark, sf):
    return rounded(reduce.pca(lineitem(spark, sf), ["l_quantity", "l_extendedprice"]).variance)


# Components with the treatment group at their side: mean squares of the scores per group.
@query(
    "components_by_treatment",
    f"WITH {ORDERS}, s AS (SELECT avg(o_totalprice) AS ma, stddev_pop(o_totalprice) AS sa, "
    "avg(c_acctbal) AS mb, stddev_pop(c_acctbal) AS sb, CASE WHEN corr(o_totalprice, c_acctbal) "
    "< 0 THEN -1 ELSE 1 END AS g FROM oc), z AS (SELECT tx, (o_totalprice - ma) / sa AS a, "
    "g * (c_acctbal - mb) / sb AS b FROM oc, s) SELECT tx, count(*) AS n, "
    f"{rd('avg((a + b) * (a + b)) / 2', 5)} AS pc1, {rd('avg((a - b) * (a - b)) / 2', 5)} AS pc2 "
    "FROM z GROUP BY tx",
)
def components_by_treatment(spark, sf):
    from suite.inputs import orders

    o = orders(spark, sf).withColumnRenamed("tx.group", "tx")
    scores = reduce.pca(o, ["o_totalprice", "c_acctbal"], id_col="o_orderkey", carry=["tx"]).scores
    return rounded(scores.groupBy("tx").agg(
        F.count("*").alias("n"), F.avg(F.col("PC1") ** 2).alias("pc1"), F.avg(F.col("PC2") ** 2).alias("pc2")), 5)


_P = "SELECT o_orderkey, o_totalprice, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey"


@query(
    "pca_scores",
    f"WITH p AS ({_P}), s AS (SELECT avg(o_totalprice) AS ma, stddev_pop(o_totalprice) AS sa, "
    "avg(c_acctbal) AS mb, stddev_pop(c_acctbal) AS sb, CASE WHEN corr(o_totalprice, c_acctbal) "
    "< 0 THEN -1 ELSE 1 END AS g FROM p), z AS (SELECT o_orderkey, (o_totalprice - ma) / sa AS a, "
    f"g * (c_acctbal - mb) / sb AS b FROM p, s) SELECT o_orderkey, {rd('abs(a + b) / sqrt(2)', 5)} "
    f"AS abs_pc1, {rd('abs(a - b) / sqrt(2)', 5)} AS abs_pc2 FROM z",
)
def pca_scores(spark, sf):
    from suite.inputs import orders

    fit = reduce.pca(orders(spark, sf), ["o_totalprice", "c_acctbal"], id_col="o_orderkey")
    return rounded(reduce.transform(fit).select(
        "o_orderkey", F.abs("PC1").alias("abs_pc1"), F.abs("PC2").alias("abs_pc2")), 5)


def _dims(spark, sf):
    from suite.inputs import DIMS, dimensions

    return reduce.pca(dimensions(spark, sf), DIMS, id_col="vec_id")


@query("top_loadings")
def top_loadings(spark, sf):
    return reduce.top_loadings(_dims(spark, sf).loadings, 3)


@query("signed_loadings")
def signed_loadings(spark, sf):
    return reduce.signed_loadings(_dims(spark, sf).loadings, 3)


@query("biplot_arrows")
def biplot_arrows(spark, sf):
    return reduce.biplot(_dims(spark, sf))[1]


@query(
    "optimal_components",
    f"WITH {LINEITEM}, {_TWO}, r AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM cc) "
    "SELECT CAST(CASE WHEN (1 + r) / 2 >= 0.75 THEN 1 ELSE 2 END AS INTEGER) AS n_components, "
    "(SELECT count(*) FROM cc) AS samples_used FROM r",
)
def optimal_components(spark, sf):
    fit = reduce.pca(lineitem(spark, sf), ["l_quantity", "l_extendedprice"])
    rows = [(reduce.optimal_components(fit.variance, 0.75), fit.samples_used)]
    return spark.createDataFrame(rows, "n_components int, samples_used long")


@query(
    "famd_variance",
    f"WITH {LINEITEM}, cc AS (SELECT * FROM li WHERE l_quantity IS NOT NULL), r AS (SELECT "
    "abs(corr(l_quantity, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END)) AS r FROM cc) "
    f"SELECT CAST(1 AS INTEGER) AS component, {rd('(1 + r) / 2')} AS explained_variance, "
    f"{rd('(1 + r) / 2')} AS cumulative_variance FROM r UNION ALL SELECT 2, {rd('(1 - r) / 2')}, "
    f"{rd('1')} FROM r",
)
def famd_variance(spark, sf):
    fit = reduce.famd(lineitem(spark, sf), ["l_quantity"], ["l_linestatus"], 10)
    return rounded(fit.variance)


@query(
    "famd_many_levels",
    "WITH li AS (SELECT l_partkey, CAST(l_quantity AS DOUBLE) AS x FROM lineitem WHERE l_partkey IS NOT NULL AND "
    "l_quantity IS NOT NULL), m AS (SELECT count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM li), "
    "g AS (SELECT l_partkey, count(*) AS c, avg(x) AS a FROM li GROUP BY l_partkey), "
    "e AS (SELECT sqrt(sum(c * (a - m) * (a - m)) / max(n * v)) AS eta, count(*) AS levels FROM g, m) "
    f"SELECT CAST(1 AS INTEGER) AS component, {rd('(1 + eta) / levels', 9)} AS explained_variance, "
    f"{rd('(1 + eta) / levels', 9)} AS cumulative_variance FROM e",
)
def famd_many_levels(spark, sf):
    """A number and a variable of as many levels as there are parts: the leading component."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("double").alias("x"))
    return rounded(reduce.famd(li, ["x"], ["part"], 1).variance, 9)


@query("famd_scores")
def famd_scores(spark, sf):
    from suite.inputs import orders

    return reduce.famd(
        orders(spark, sf), ["o_totalprice", "c_acctbal"], ["o_orderstatus", "c_mktsegment"], 4,
        "o_orderkey").scores


@query("famd_coordinates")
def famd_coordinates(spark, sf):
    from suite.inputs import orders

    return reduce.famd(
        orders(spark, sf), ["o_totalprice", "c_acctbal"], ["o_orderstatus", "c_mktsegment"], 4,
        "o_orderkey").loadings
