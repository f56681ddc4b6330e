"""Differences between the two replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.timestamps import instant
from quern.operators.copies import differences
from quern.session import table


def p2_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = instant(F.col("created_at"))
    return differences(
        table(spark, sf_dir, "replica_a"), table(spark, sf_dir, "replica_b"), ["source", "chunk_id"], {"text": F.col("text"), "created_at": at, "page_no": F.col("page_no")}, at
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_differences(spark, sf_dir).select("source", "chunk_id", "diff")


QUERIES = {f.__name__: f for f in (p2_found, p2_differences)}

_INSTANT = "epoch_us(CAST(CASE WHEN regexp_matches(created_at, '[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$') THEN created_at || 'Z' ELSE created_at END AS TIMESTAMPTZ))"
_LATEST = (
    "SELECT DISTINCT ON (source, chunk_id) source, chunk_id, text, page_no, us FROM (SELECT *, {i} AS us FROM {t} WHERE source IS NOT NULL AND chunk_id IS NOT NULL) ORDER BY source, chunk_id, us DESC NULLS LAST"
)
_BOTH = f"""
WITH a AS ({_LATEST.format(i=_INSTANT, t="replica_a")}), b AS ({_LATEST.format(i=_INSTANT, t="replica_b")}),
 j AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.source IS NULL AS no_a, b.source IS NULL AS no_b,
  a.text AS ta, b.text AS tb, a.us AS ua, b.us AS ub, a.page_no AS pa, b.page_no AS pb FROM a FULL JOIN b ON a.source = b.source AND a.chunk_id = b.chunk_id),
 d AS (SELECT source, chunk_id, 'only_a' AS diff, NULL AS value_a, NULL AS value_b FROM j WHERE no_b UNION ALL SELECT source, chunk_id, 'only_b', NULL, NULL FROM j WHERE no_a
  UNION ALL SELECT source, chunk_id, 'text', ta, tb FROM j WHERE ta IS DISTINCT FROM tb AND NOT no_a AND NOT no_b
  UNION ALL SELECT source, chunk_id, 'created_at', CAST(ua AS VARCHAR), CAST(ub AS VARCHAR) FROM j WHERE ua IS DISTINCT FROM ub AND NOT no_a AND NOT no_b
  UNION ALL SELECT source, chunk_id, 'page_no', CAST(pa AS VARCHAR), CAST(pb AS VARCHAR) FROM j WHERE pa IS DISTINCT FROM pb AND NOT no_a AND NOT no_b)
"""
SQL = {
    "p2_found": _BOTH + "SELECT source, chunk_id, diff FROM d",
    "p2_differences": _BOTH + "SELECT source, chunk_id, diff, value_a, value_b FROM d",
}
