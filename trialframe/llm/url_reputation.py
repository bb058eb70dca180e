"""URL filters by empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages are counted per host.  Each level gets a beta prior from the one above it: the
global share of bad pages gives the prior of the suffixes, a suffix that of its registered
domains, a domain that of its hosts.  The strength of a prior is that of a beta-binomial fitted
by moments over all members of the level.  A page is blocked if the lower posterior bound of
its host's share of bad pages exceeds a threshold; explicit rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of the host, without user and port."""
    return F.substring_index(name_of(host), ".", -1)


def domain_of(host: Column) -> Column:
    """The last two labels: the registered domain under one-label suffixes."""
    return F.substring_index(name_of(host), ".", -2)


def name_of(host: Column) -> Column:
    return F.regexp_replace(F.substring_index(host, "@", -1), ":[0-9]*$", "")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]],
                  values: str) -> Column:
    """The rule (``values="rule"``) or its verdict for the longest (verdict, host, path) that fits.

    ``rules`` is a hand-kept list; it becomes one CASE expression inside the scan.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    out = F.lit(None).cast("string")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p if values == "rule" else verdict)).otherwise(out)
    return out


def _strength(counts: DataFrame, mean: Column, bounds: tuple[float, float]) -> float:
    """Prior strength of one level: moments of the beta-binomial over (n, bad) with given means."""
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), mean))
    dev = (F.col("bad") - F.col("n") * m) ** 2 / (F.col("n") * m * (1 - m))
    row = counts.where("n > 0").agg(
        F.round(F.sum(dev), 9).alias("q"), F.count("*").alias("c"),
        F.sum(F.col("n") - 1).alias("d"),
    ).first()
    if not row["c"] or not row["d"]:
        return bounds[1]
    rho = (row["q"] - row["c"]) / row["d"]
    return bounds[1] if rho <= 0 else min(bounds[1], max(bounds[0], 1 / rho - 1))


def host_reputation(
    hosts: DataFrame, outcomes: DataFrame, z: float = 1.645,
    bounds: tuple[float, float] = (2.0, 1000.0),
) -> DataFrame:
    """host, n, bad, mean, bound for every row of ``hosts`` (host, distinct).

    ``outcomes`` has host and bad (0/1) per labelled page; rows with a null are left out.  A host
    without labelled pages has its domain's posterior, an unknown domain its suffix's.  Without
    any label the mean is one half.  ``bound`` is the lower bound on the logit scale:
    ``logit(a/(a+b)) - z * sqrt(1/a + 1/b)`` for the posterior Beta(a, b).
    """
    seen = outcomes.where("host is not null and bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"),
    )
    per_host = store(
        hosts.join(seen, "host", "left").select(
            "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"),
            F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"),
        ),
        "reputation",
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = per_host.agg(*sums).first()
    root = ((total["bad"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    suffixes = per_host.groupBy("suffix").agg(*sums)
    k = _strength(suffixes, F.lit(root), bounds)
    suffixes = suffixes.select(
        "suffix", ((F.col("bad") + k * root) / (F.col("n") + k)).alias("suffix_mean"),
    )
    domains = per_host.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    k = _strength(domains, F.col("suffix_mean"), bounds)
    domains = domains.select(
        "domain",
        ((F.col("bad") + k * F.col("suffix_mean")) / (F.col("n") + k)).alias("domain_mean"),
    )
    rated = per_host.join(domains, "domain")
    k = _strength(rated, F.col("domain_mean"), bounds)
    a = F.col("bad") + k * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + k * (1 - F.col("domain_mean"))
    return rated.select("host", "n", F.col("bad"), a.alias("a"), b.alias("b")).select(
        "host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"),
        (1 / (1 + F.exp(-(F.log(F.col("a") / F.col("b"))
                          - z * F.sqrt(1 / F.col("a") + 1 / F.col("b")))))).alias("bound"),
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (),
    max_bad: float = 0.3, z: float = 1.645, url_col: str = "url",
) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict, n_labelled, bad_mean, bad_bound.

    ``outcomes``: host and bad (0/1) per labelled page.  The verdict is that of the longest
    rule; without a rule, ``block`` if the lower posterior bound of the host's share of bad
    pages is above ``max_bad``, else ``allow``.  A null url or one without ``://`` has an empty
    host and path and is judged as host ''.  Repeated rows stay repeated, an empty table gives
    an empty result, and columns of the same names are replaced.  One host may hold any share
    of the pages: counts are summed before the shuffle and the last join is one that Spark
    splits or broadcasts by its own size check.
    """
    names = ["host", "path", "rule", "verdict", "n_labelled", "bad_mean", "bad_bound"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    parsed = pages.select(*kept, host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"))
    hosts = parsed.select("host").distinct()
    rating = host_reputation(hosts, outcomes, z).select(
        F.col("host").alias("rated_host"), F.col("n").alias("n_labelled"),
        F.col("mean").alias("bad_mean"), F.col("bound").alias("bad_bound"),
    )
    host, path = F.col("host"), F.col("path")
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return (
        parsed.join(rating, F.col("host") == F.col("rated_host"), "left").drop("rated_host")
        .withColumn("rule", matching_rule(host, path, rules, "rule"))
        .withColumn("verdict", F.coalesce(matching_rule(host, path, rules, "verdict"), own))
    )
