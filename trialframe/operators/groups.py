"""Treatment groups: labels, baseline and outcome tables, ANOVA, balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.columns import col, num, split_columns
from trialframe.functions.shape import balance_class, ratio
from trialframe.functions.tails import f_pvalue
from trialframe.operators.explore import summarize
from trialframe.plans.joins import join_keyed
from trialframe.plans.onepass import long_strings, per_variable

# Treatment codes and the two factors behind them.
TREATMENT_COLUMN = "tx.group"
TREATMENT_LABELS = {
    0: "Control (No tDCS, No Meditation)",
    1: "tDCS + Meditation",
    2: "tDCS Only",
    3: "Meditation Only",
}
TDCS_CODES = (1, 2)
MEDITATION_CODES = (1, 3)
TREATMENT_HINTS = ("tx", "treat", "group")


def treatment_column(columns: Sequence[str]) -> str | None:
    """``tx.group``, else the first name that looks like a treatment code."""
    if TREATMENT_COLUMN in columns:
        return TREATMENT_COLUMN
    return next((c for c in columns if any(h in c.lower() for h in TREATMENT_HINTS)), None)


def recode(value: Column, labels: Mapping) -> Column:
    """Labels for codes; codes without a label become null."""
    chain = None
    for code, text in labels.items():
        hit = value == F.lit(code)
        chain = F.when(hit, F.lit(text)) if chain is None else chain.when(hit, F.lit(text))
    return chain


def with_treatment(
    df: DataFrame, column: str | None = None, labels: Mapping[int, str] | None = None
) -> DataFrame:
    """Adds treatment_group, has_tdcs and has_meditation: one column, not one table per group."""
    column = column or treatment_column(df.columns)
    if column is None:
        raise ValueError("no treatment column found")
    code = col(column)
    return df.withColumns(
        {
            "treatment_group": recode(code, labels or TREATMENT_LABELS),
            "has_tdcs": code.isin(*TDCS_CODES).cast("int"),
            "has_meditation": code.isin(*MEDITATION_CODES).cast("int"),
        }
    )


def factorial_groups(
    df: DataFrame, flag_a: str, flag_b: str, name_a: str = "A", name_b: str = "B",
    out: str = "treatment_group",
) -> DataFrame:
    """2 × 2 label from two 0/1 flags: Control, A Only, B Only, A + B; a missing flag gives null."""
    a, b = col(flag_a), col(flag_b)
    label = (
        F.when((a == 0) & (b == 0), "Control")
        .when((a == 1) & (b == 0), f"{name_a} Only")
        .when((a == 0) & (b == 1), f"{name_b} Only")
        .when((a == 1) & (b == 1), f"{name_a} + {name_b}")
    )
    return df.withColumn(out, label)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.filter(col(group).isNotNull()).groupBy(col(group)).agg(F.count("*").alias("n"))


def factorial_counts(df: DataFrame, rows: str, columns: str, values=(0, 1)) -> DataFrame:
    """Count matrix of two factors, with 0 for empty cells; values that are known need no scan."""
    return (
        df.groupBy(col(rows)).pivot(columns, list(values)).agg(F.count(F.lit(1)))
        .na.fill(0).filter(col(rows).isNotNull())
    )


def _display(value: Column, digits: int) -> Column:
    """A number as text; ``nan`` where there is none."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise("nan")


def baseline_long(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """(variable, group, text): numeric ``mean ± std``; categorical ``mode (pct% of group)``.

    Ties of the mode go to the smaller value.  Everything is aggregated per (variable, value,
    group) first, so a large group or a dominant value never travels as rows.
    """
    present = [v for v in variables if v in df.columns]
    numeric, _ = split_columns(df, group)
    nums = [v for v in present if v in numeric]
    cats = [v for v in present if v not in numeric]
    df = df.filter(col(group).isNotNull())
    parts = []
    if nums:
        stats = per_variable(df, nums, {"m": F.avg, "s": F.stddev_samp}, [group])
        text = F.concat(_display(F.col("m"), 2), F.lit(" ± "), _display(F.col("s"), 2))
        parts.append(stats.select("variable", col(group), text.alias("text")))
    if cats:
        sizes = df.groupBy(col(group)).agg(F.count("*").alias("rows"))
        counts = long_strings(df, cats, [group]).groupBy(col(group), "variable", "value").agg(
            F.count("*").alias("n")
        )
        mode = counts.groupBy(col(group), "variable").agg(
            F.max_by("value", F.struct("n", _reverse("value"))).alias("value"),
            F.max("n").alias("n"),
        )
        every = sizes.select(
            col(group), "rows", F.explode(F.array(*[F.lit(c) for c in cats])).alias("variable")
        )
        joined = every.join(mode, [group, "variable"], "left")
        text = F.concat(
            F.col("value"), F.lit(" ("), _display(F.col("n") / F.col("rows") * 100, 1), F.lit("%)")
        )
        parts.append(joined.select(
            "variable", col(group), F.coalesce(text, F.lit("N/A")).alias("text")))
    if not parts:
        raise ValueError("no variable of the table was given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _reverse(name: str) -> Column:
    """A sort key that is larger for smaller strings (code points negated)."""
    return F.transform(F.split(col(name), ""), lambda ch: -F.ascii(ch))


def baseline_table(
    df: DataFrame, variables: Sequence[str], group: str, groups: Sequence | None = None
) -> DataFrame:
    """One row per variable, one column per group; absent combinations are ``N/A``."""
    long = baseline_long(df, variables, group)
    pivot = long.groupBy("variable").pivot(group, list(groups) if groups else None)
    return pivot.agg(F.first("text")).na.fill("N/A")


def categorical_by_group(df: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """(group, variable, value, n, pct of the group's non-missing values)."""
    counts = long_strings(df, variables, [group]).groupBy(col(group), "variable", "value").agg(
        F.count("*").alias("n")
    )
    totals = counts.groupBy(col(group), "variable").agg(F.sum("n").alias("total"))
    return join_keyed(counts, totals, [group, "variable"]).select(
        col(group), "variable", "value", "n", (F.col("n") / F.col("total") * 100).alias("pct")
    )


def outcome_stats(df: DataFrame, outcomes: Sequence[str], group: str) -> DataFrame:
    """(group, variable, n, mean, median, std, min, max)."""
    return summarize(df.filter(col(group).isNotNull()), outcomes, [group]).drop(
        "missing", "missing_pct"
    )


def anova(
    df: DataFrame, variables: Sequence[str], group: str, min_values: int = 1
) -> DataFrame:
    """(variable, n_groups, n, ss_between, ss_within, df_between, df_within, f_statistic,
    p_value, eta_squared, significant).

    Per (variable, group) only count, mean and variance leave the tasks.  Groups with fewer than
    ``min_values`` values are left out.  Fewer than two groups, or no spare degree of freedom,
    give null F and p.
    """
    stats = per_variable(
        df.filter(col(group).isNotNull()),
        variables,
        {"n": F.count, "m": F.avg, "ss": lambda c: F.var_pop(c) * F.count(c)},
        [group],
    ).filter(F.col("n") >= max(1, min_values))
    grand = stats.groupBy("variable").agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum("ss").alias("ss_within"),
    )
    between = (
        stats.join(grand.select("variable", "grand"), "variable")
        .groupBy("variable")
        .agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2))).alias("ss_between"))
    )
    d1, d2 = F.col("n_groups") - 1, F.col("total") - F.col("n_groups")
    table = grand.join(between, "variable").select(
        "variable",
        "n_groups",
        F.col("total").alias("n"),
        "ss_between",
        "ss_within",
        d1.alias("df_between"),
        d2.alias("df_within"),
    )
    ok = (F.col("df_between") > 0) & (F.col("df_within") > 0) & (F.col("ss_within") > 0)
    f = F.when(
        ok,
        (F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within")),
    )
    total_ss = F.col("ss_between") + F.col("ss_within")
    table = table.withColumn("f_statistic", f).withColumn(
        "eta_squared", F.when(total_ss > 0, F.col("ss_between") / total_ss).otherwise(0.0)
    )
    return (
        table.withColumn(
            "p_value",
            F.when(
                F.col("f_statistic").isNotNull(),
                f_pvalue(F.col("f_statistic"), F.col("df_between"), F.col("df_within")),
            ),
        )
        .withColumn("significant", F.col("p_value") < 0.05)
    )


def smd_balance(
    df: DataFrame, variables: Sequence[str], group: str, reference
) -> DataFrame:
    """(variable, group, reference_mean, reference_std, smd, assessment) against one group.

    |m₂ − m₁| / pooled σ; no spread gives 0, a group without values null.
    """
    stats = per_variable(
        df.filter(col(group).isNotNull()), variables,
        {"n": F.count, "m": F.avg, "v": F.var_samp}, [group],
    )
    ref = stats.filter(col(group) == F.lit(reference)).select(
        "variable",
        F.col("n").alias("n0"),
        F.col("m").alias("reference_mean"),
        F.col("v").alias("v0"),
    ).filter("n0 > 0")
    both = stats.filter(col(group) != F.lit(reference)).join(ref, "variable")
    zero = F.lit(0.0)
    pooled = F.sqrt(ratio(
        (F.col("n0") - 1) * F.coalesce("v0", zero) + (F.col("n") - 1) * F.coalesce("v", zero),
        F.col("n0") + F.col("n") - 2,
    ))
    smd = F.when(
        F.col("n") > 0,
        F.when(pooled > 0, F.abs((F.col("m") - F.col("reference_mean")) / pooled)).otherwise(0.0),
    )
    return both.select(
        "variable",
        col(group),
        "reference_mean",
        F.sqrt("v0").alias("reference_std"),
        smd.alias("smd"),
    ).withColumn("assessment", balance_class(F.col("smd")))


def smd_matrix(balance: DataFrame, group: str, groups: Sequence | None = None) -> DataFrame:
    """variable × group."""
    return balance.groupBy("variable").pivot(group, list(groups) if groups else None).agg(
        F.first("smd")
    )


def balance_summary(balance: DataFrame) -> DataFrame:
    """One row: good, acceptable, poor, overall."""
    counts = balance.filter(F.col("smd").isNotNull()).agg(
        *[F.count(F.when(F.col("assessment") == c, 1)).alias(c)
          for c in ("good", "acceptable", "poor")],
        F.count("*").alias("total"),
    )
    fifth = F.col("total") * 0.2
    overall = (
        F.when((F.col("poor") == 0) & (F.col("acceptable") <= fifth), "good")
        .when(F.col("poor") <= fifth, "acceptable")
        .otherwise("poor")
    )
    return counts.select("good", "acceptable", "poor", overall.alias("overall"))


def pre_post_change(df: DataFrame, pre: str, post: str, group: str) -> DataFrame:
    """(group, pre_mean, post_mean, change of the means)."""
    a, b = F.avg(num(pre)), F.avg(num(post))
    return df.filter(col(group).isNotNull()).groupBy(col(group)).agg(
        a.alias("pre_mean"), b.alias("post_mean"), (b - a).alias("change")
    )
