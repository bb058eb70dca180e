"""Query op8_warc and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.warc import archive_report, new_archive_folder, read_archives, write_archives


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives (64 KB segments, 16 KB chunks), read them back, report."""
    path = write_archives(table(spark, sf_dir, "pages"), new_archive_folder(spark),
                          segment_bytes=1 << 16, chunk_bytes=1 << 14)
    return archive_report(read_archives(spark, path))


_BITS = " || ".join(
    f"lpad(bin(strpos('0123456789abcdef', substr(digest, {i}, 1)) - 1), 4, '0')" for i in range(1, 41))
_TEXT = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(
        f"{16 >> k} * CAST(substr(bits, {5 * j + k + 1}, 1) AS INTEGER)" for k in range(5)) + ", 1)"
    for j in range(32))

ORACLE = f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest,
  CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last, {_BITS} AS bits FROM p)
SELECT page_id, payload_bytes, {_TEXT} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, true AS verified FROM b"""
