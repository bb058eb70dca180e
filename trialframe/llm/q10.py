"""Query op10_url_reputation and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import table
from trialframe.llm.url_reputation import filter_urls, host_of

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
MAX_BAD = 0.25


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by rules, then by host reputation.

    The given tables label ids, not pages: the outcome of a page is that of the label with its
    id, bad for low quality or toxic.
    """
    pages = table(spark, sf_dir, "pages")
    bad = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    outcomes = pages.select("page_id", host_of(F.col("url")).alias("host")).join(
        bad, F.col("page_id") == F.col("doc_id")).select("host", "bad")
    return filter_urls(pages.select("page_id", "url"), outcomes, RULES, MAX_BAD).select(
        "page_id", "host", "path", "rule", "verdict", "n_labelled",
        F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_bound", 6).alias("bad_bound"),
    )


def _level(name: str, prior: str, source: str) -> str:
    return f"""{name}_k AS (SELECT CASE WHEN d IS NULL OR d = 0 OR (q - c) / d <= 0 THEN 1000.0::DOUBLE
  ELSE least(1000.0, greatest(2.0, 1 / ((q - c) / d) - 1)) END AS k FROM (SELECT
  round(sum(pow(bad - n * m, 2) / (n * m * (1 - m))), 9) AS q, count(*)::DOUBLE AS c,
  sum(n - 1)::DOUBLE AS d FROM (SELECT n::DOUBLE AS n, bad::DOUBLE AS bad,
  greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, {prior})) AS m FROM {source} WHERE n > 0)))"""


_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), " \
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = f"""WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
seen AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM p JOIN o ON page_id = doc_id GROUP BY host),
h AS (SELECT host, name, regexp_extract(name, '[^.]*[.]?[^.]*$') AS domain,
  regexp_extract(name, '[^.]*$') AS suffix, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
  FROM (SELECT DISTINCT host, regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', '')
  AS name FROM p) LEFT JOIN seen USING (host)),
r AS (SELECT (coalesce(sum(bad), 0) + 1.0)::DOUBLE / (coalesce(sum(n), 0) + 2.0)::DOUBLE AS root FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(root) AS root FROM h, r GROUP BY suffix),
{_level("s", "root", "s")},
sm AS (SELECT suffix, (bad::DOUBLE + k * root) / (n::DOUBLE + k) AS suffix_mean FROM s, s_k),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(suffix_mean) AS suffix_mean
  FROM h JOIN sm USING (suffix) GROUP BY domain, suffix),
{_level("d", "suffix_mean", "d")},
dm AS (SELECT domain, (bad::DOUBLE + k * suffix_mean) / (n::DOUBLE + k) AS domain_mean FROM d, d_k),
hd AS (SELECT host, n, bad, domain_mean FROM h JOIN dm USING (domain)),
{_level("h", "domain_mean", "hd")},
ab AS (SELECT host, n, bad::DOUBLE + k * domain_mean AS a,
  n::DOUBLE - bad::DOUBLE + k * (1 - domain_mean) AS b FROM hd, h_k),
rep AS (SELECT host, n, a / (a + b) AS bad_mean,
  1 / (1 + exp(-(ln(a / b) - 1.645::DOUBLE * sqrt(1 / a + 1 / b)))) AS bad_bound FROM ab),
f AS (SELECT page_id, p.host, path, n, bad_mean, bad_bound, CASE
  WHEN (p.host = 'example.org' OR suffix(p.host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
  WHEN (p.host = 'example.org' OR suffix(p.host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
  WHEN (p.host = 'com' OR suffix(p.host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
  WHEN (p.host = 'com' OR suffix(p.host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
  WHEN (p.host = 'org' OR suffix(p.host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule
  FROM p JOIN rep ON p.host = rep.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block' WHEN bad_bound > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n AS BIGINT) AS n_labelled, round(bad_mean, 6) AS bad_mean, round(bad_bound, 6) AS bad_bound FROM f"""
