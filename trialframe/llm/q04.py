"""Query op4_temperature_mixing and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.mixing import mix_sources

ENTROPY = 0.999


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to 99.9 % of the entropy of an even mix, with as many words as there are."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, target_entropy=ENTROPY).select(
        "doc_id", "source", "epoch", "block", "block_rank")


ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s,
  CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) % 1024 AS block,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
b AS (SELECT s, block, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY s, block),
t AS (SELECT sum(tokens) AS total FROM b),
src AS (SELECT s, sum(b.tokens) AS tokens, any_value(total) AS total FROM b, t GROUP BY s HAVING sum(b.tokens) > 0),
g AS (SELECT {ENTROPY}::DOUBLE * ln(count(*)::DOUBLE) AS goal FROM src),
search(lo, hi) AS (SELECT 0::BIGINT, 1048577::BIGINT UNION ALL
  SELECT CASE WHEN h >= goal - 1e-12 THEN m ELSE lo END, CASE WHEN h >= goal - 1e-12 THEN hi ELSE m END
  FROM (SELECT lo, hi, m, (SELECT goal FROM g) AS goal, (SELECT sum(-w * ln(w)) FROM (SELECT
    pow(tokens / total, m / 1048576.0::DOUBLE) / sum(pow(tokens / total, m / 1048576.0::DOUBLE)) OVER () AS w FROM src)) AS h
    FROM (SELECT lo, hi, (lo + hi) // 2 AS m FROM search WHERE hi - lo > 1))),
a AS (SELECT max(lo) / 1048576.0::DOUBLE AS alpha FROM search),
q AS (SELECT s, tokens AS source_tokens, round(pow(tokens / total, alpha)
  / sum(pow(tokens / total, alpha)) OVER () * total / tokens, 9) AS repeat FROM src, a),
e AS (SELECT b.s, block, tokens, coalesce(repeat, 1) AS repeat, coalesce(source_tokens, 0) AS source_tokens, epoch
  FROM b LEFT JOIN q USING (s), (SELECT CAST(unnest(range(0, 1000)) AS INTEGER) AS epoch)
  WHERE epoch < coalesce(repeat, 1)),
p AS (SELECT s, block, epoch, least(1.0::DOUBLE, repeat - epoch) * source_tokens AS room,
  row_number() OVER w AS block_rank, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, md5('mix|' || s || '|' || epoch || '|' || block) AS o FROM e)
  WINDOW w AS (PARTITION BY s, epoch ORDER BY o, block))
SELECT doc_id, source, epoch, d.block, CAST(block_rank AS INTEGER) AS block_rank
  FROM d JOIN p ON d.s = p.s AND d.block = p.block WHERE upto <= room + 1e-6"""
