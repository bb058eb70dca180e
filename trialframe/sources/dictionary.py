"""The data dictionary and everything that is derived from variable names.

Names are matched with equi-joins and single scans.  There is no product of names and
dictionary rows: pattern lists are literals inside the expression, and the substring rule is
an equi-join on the substrings of the dictionary names.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.columns import col

# The category of a variable follows from substrings of its lower-case name.
CATEGORY_PATTERNS: dict[str, list[str]] = {
    "demographic": ["age", "gender", "race", "education", "height", "weight", "history", "bmi"],
    "clinical": ["knee", "pain", "klscore", "womac", "oa", "joint"],
    "treatment": ["tdcs", "tx.group", "meditation", "treatment"],
    "outcome": ["differ", "m1", "m2", "m3", "change"],
    "baseline": ["_0", ".0", "baseline"],
    "follow_up": ["_5", "_10", ".5", ".10", "follow"],
    "pain_assessment": ["pain", "womac", "nrs"],
    "physical_assessment": ["functional", "physical", "step"],
    "psychological": ["pcs", "fmi", "css", "cesd", "catastrophizing", "depression"],
    "qst": ["hpth", "hpto", "ppt", "qst", "temperature", "punctate", "cpm"],
    "biomarker": [],
}
# Assessment scales, measured on days 0, 5 and 10.
SCALES = ["WOMAC", "NRS", "HPTH", "HPTO", "PPT", "CPM", "FMI", "PCS"]
TIME_POINTS = ["0", "5", "10"]
# Markers of baseline and outcome variables beyond their categories.
BASELINE_MARKS = [".0", "_0"]
OUTCOME_MARKS = ["M1", "M2", "M3", "10", "differ", "Differ"]
NO_DESCRIPTION = "No description available"
# Common English words that carry no topic.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her his "
    "how i if in into is it its me my no nor not of on or our she so that the their them then "
    "there these they this those to too was we were what when where which who why will with "
    "would you your"
).split()


def normalize_dictionary(raw: DataFrame) -> DataFrame:
    """First two columns become variable and description; ``ord`` keeps the row order.

    Order matters ("first match wins").  An ``ord`` column of the source is kept; otherwise
    the read order is used, which holds for a file read in order.
    """
    names = raw.columns
    if len(names) < 2:
        raise ValueError("a dictionary needs a variable and a description column")
    rest = [c for c in names[2:] if c != "ord"]
    order = F.col("ord").cast("long") if "ord" in names[2:] else F.monotonically_increasing_id()
    return raw.select(
        col(names[0]).cast("string").alias("variable"),
        col(names[1]).cast("string").alias("description"),
        *[col(c) for c in rest],
        order.alias("ord"),
    )


def variables_of(df: DataFrame) -> DataFrame:
    """(variable, position, dtype) from the schema."""
    rows = [(name, i, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "variable string, position int, dtype string")


def describe_variables(variables: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(variable, description): exact name, else same name in another case, else a dictionary
    name that contains it (any case); the first dictionary row wins; no match gives null.

    Only names that are still open go on to the next, more expensive rule.
    """
    names = variables.select("variable").filter(F.col("variable").isNotNull()).distinct()
    entries = dictionary.filter(F.col("variable").isNotNull()).select(
        F.col("variable").alias("entry"), F.struct("ord", "description").alias("hit")
    )
    exact = entries.groupBy("entry").agg(F.min_by("hit", "hit.ord").alias("hit"))
    step1 = names.join(exact, names["variable"] == exact["entry"], "left").select(
        "variable", "hit"
    )
    lowered = entries.groupBy(F.lower("entry").alias("entry")).agg(
        F.min_by("hit", "hit.ord").alias("hit")
    )
    open1 = step1.filter("hit is null").select("variable", F.lower("variable").alias("key"))
    step2 = open1.join(lowered, F.col("key") == F.col("entry"), "left").select(
        "variable", "key", "hit"
    )
    # Every substring of the (short) dictionary names, once per name.
    pieces = F.expr(
        "array_distinct(flatten(transform(sequence(1, length(entry)), i -> "
        "transform(sequence(1, length(entry) - i + 1), n -> substring(entry, i, n)))))"
    )
    parts = (
        lowered.filter(F.length("entry") > 0)
        .select(F.explode(pieces).alias("piece"), "hit")
        .groupBy("piece")
        .agg(F.min_by("hit", "hit.ord").alias("hit"))
    )
    step3 = (
        step2.filter("hit is null")
        .select("variable", "key")
        .join(parts, F.col("key") == F.col("piece"), "left")
        .select("variable", "hit")
    )
    found = (
        step1.filter("hit is not null")
        .unionByName(step2.filter("hit is not null").select("variable", "hit"))
        .unionByName(step3)
    )
    return found.select("variable", F.col("hit.description").alias("description"))


def with_descriptions(report: DataFrame, dictionary: DataFrame, default: str | None = None):
    """A report by variable, with a description column."""
    text = describe_variables(report, dictionary)
    joined = report.join(text, "variable", "left")
    if default is None:
        return joined
    return joined.withColumn("description", F.coalesce("description", F.lit(default)))


def search_dictionary(dictionary: DataFrame, term: str) -> DataFrame:
    """Rows in which any column matches a case-insensitive regular expression."""
    hits = [col(c).cast("string").rlike(f"(?i){term}") for c in dictionary.columns]
    return dictionary.filter(reduce(Column.__or__, [F.coalesce(h, F.lit(False)) for h in hits]))


def categorize(
    variables: DataFrame, patterns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """(category, category_order, variable), one row per category that a name falls in."""
    table = CATEGORY_PATTERNS if patterns is None else patterns
    lowered = F.lower("variable")
    found = []
    for order, (category, marks) in enumerate(table.items()):
        if marks:
            hit = reduce(Column.__or__, [lowered.contains(m) for m in marks])
            found.append(F.when(hit, F.struct(F.lit(category).alias("category"),
                                              F.lit(order).alias("category_order"))))
    if not found:
        raise ValueError("no pattern")
    return (
        variables.select("variable")
        .distinct()
        .select("variable", F.explode(F.array_compact(F.array(*found))).alias("c"))
        .select("c.category", "c.category_order", "variable")
    )


def category_sizes(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count("*").alias("n_variables"))


def category_detail(categories: DataFrame, missing: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(category, variable, description, missing_values, percentage)."""
    facts = missing.select("variable", "missing_values", "percentage")
    return with_descriptions(
        categories.select("category", "variable").join(facts, "variable", "left"),
        dictionary,
        NO_DESCRIPTION,
    )


def first_category(
    variables: DataFrame, patterns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """(variable, category): the first matching category, else ``uncategorized``."""
    best = categorize(variables, patterns).groupBy("variable").agg(
        F.min_by("category", "category_order").alias("category")
    )
    return (
        variables.select("variable").distinct().join(best, "variable", "left")
        .withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    )


def _marked(variables: DataFrame, categories: Iterable[str], marks: Iterable[str]) -> DataFrame:
    wanted = {c: CATEGORY_PATTERNS[c] for c in categories}
    lowered = F.lower("variable")
    hit = reduce(
        Column.__or__,
        [lowered.contains(m) for ms in wanted.values() for m in ms]
        + [F.col("variable").contains(m) for m in marks],
    )
    return variables.filter(hit).select("variable").distinct()


def baseline_variables(variables: DataFrame) -> DataFrame:
    """Baseline and demographic variables, and names with a day-0 mark."""
    return _marked(variables, ["baseline", "demographic"], BASELINE_MARKS)


def outcome_variables(variables: DataFrame) -> DataFrame:
    """Outcome variables, and names with a later-visit or difference mark."""
    return _marked(variables, ["outcome"], OUTCOME_MARKS)


def drop_category(df: DataFrame, category: str = "follow_up") -> DataFrame:
    """The table without the columns of a category (names only, no job)."""
    marks = CATEGORY_PATTERNS[category]
    return df.select(
        *[col(c) for c in df.columns if not any(m in c.lower() for m in marks)]
    )


def prefix_groups(dictionary: DataFrame, first: int = 10) -> DataFrame:
    """(prefix, n_variables, examples): text before the first dot, else ``General``.

    Ranks up to ``first`` are cut on the map side (window group limit), so a prefix that owns
    most names is not sorted in one task.
    """
    named = dictionary.filter(F.length("variable") > 0).select(
        F.when(F.instr("variable", ".") > 0, F.split("variable", "[.]")[0])
        .otherwise("General").alias("prefix"),
        "variable",
        "ord",
    )
    counts = named.groupBy("prefix").agg(F.count("*").alias("n_variables"))
    w = Window.partitionBy("prefix").orderBy("ord")
    head = (
        named.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first)
        .groupBy("prefix")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "variable"))),
                         lambda s: s["variable"]).alias("examples"))
    )
    return counts.join(head, "prefix")


def scale_timepoints(dictionary: DataFrame, scales: Sequence[str] = tuple(SCALES)) -> DataFrame:
    """(scale, time_point, n_measurements, scale_description) of names like ``WOMAC.Pain.10``."""
    starts = F.filter(
        F.array(*[F.lit(s) for s in scales]), lambda s: F.col("variable").startswith(s)
    )
    owned = dictionary.select(F.explode(starts).alias("scale"), "variable", "description", "ord")
    day = F.regexp_extract("variable", r"[.](0|5|10)$", 1)
    counts = (
        owned.withColumn("time_point", day)
        .filter(F.col("time_point").isin(TIME_POINTS))
        .groupBy("scale", "time_point")
        .agg(F.count("*").alias("n_measurements"))
    )
    # The first undotted name of the scale describes it.
    bare = (
        owned.filter(F.instr("variable", ".") == 0)
        .groupBy("scale")
        .agg(F.min_by("description", "ord").alias("scale_description"))
    )
    return counts.join(bare, "scale", "left")


def term_counts(
    texts: DataFrame, column: str = "description", top: int = 100,
    stopwords: Sequence[str] = tuple(STOPWORDS),
) -> DataFrame:
    """(term, n): the most frequent words of a text column, without stop words and numbers."""
    words = F.regexp_extract_all(F.lower(col(column)), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    terms = (
        texts.filter(col(column).isNotNull())
        .select(F.explode(words).alias("term"))
        .filter(~F.col("term").isin(list(stopwords)) & ~F.col("term").rlike(r"^[0-9]+$"))
    )
    return (
        terms.groupBy("term").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("term")).limit(top)
    )


def dictionary_summary(dictionary: DataFrame) -> DataFrame:
    """(n_rows, n_described): size of a dictionary."""
    return dictionary.agg(
        F.count("*").alias("n_rows"), F.count("description").alias("n_described")
    )


def from_rows(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """A dictionary from (variable, description) pairs."""
    data = [(v, d, i) for i, (v, d) in enumerate(rows)]
    return spark.createDataFrame(data, "variable string, description string, ord long")
