"""Queries of problem 5 (only new or changed records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.operators.incremental import change_feed, replay
from stratalith.operators.scale import shared_dir
from stratalith.sources.tables import table


def _tables(spark, d):
    return table(spark, d, "signatures"), table(spark, d, "index_runs"), table(spark, d, "parse_cache")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Run by run through the store, with the failed runs of the log in between."""
    return replay(*_tables(spark, d), shared_dir(spark))


def p5_feed(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from one plan over the whole log."""
    return change_feed(*_tables(spark, d))


QUERIES = {"p5_found": p5_found, "p5_feed": p5_feed}

_PATH = r"regexp_replace(replace(rel_path, '\', '/'), '^\./', '')"

ORACLE = {
    "p5_found": rf"""
WITH runs AS (
  SELECT run_id, started_at, lag(run_id) OVER (ORDER BY started_at, run_id) AS prev_id
  FROM (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'success')
), sig AS (
  SELECT repo, {_PATH} AS path, len, mtime_ns, walked_at, loaded_at, sig_id FROM signatures
  WHERE len IS NOT NULL AND mtime_ns IS NOT NULL
), state AS (
  SELECT r.run_id, r.prev_id, s.repo, s.path,
         arg_max([s.len, s.mtime_ns], (s.walked_at, s.loaded_at, s.sig_id)) AS st
  FROM sig s JOIN runs r ON s.loaded_at <= r.started_at
  GROUP BY ALL
), entry AS (
  SELECT repo, {_PATH} AS path, [size, mtime_secs * 1000000000 + mtime_nanos] AS st FROM parse_cache
)
SELECT n.run_id, n.repo, n.path AS rel_path
FROM state n
LEFT JOIN state o ON o.run_id = n.prev_id AND o.repo IS NOT DISTINCT FROM n.repo AND o.path = n.path
LEFT JOIN entry e ON e.repo IS NOT DISTINCT FROM n.repo AND e.path = n.path
WHERE n.st IS DISTINCT FROM coalesce(o.st, e.st)
"""
}
ORACLE["p5_feed"] = ORACLE["p5_found"]
