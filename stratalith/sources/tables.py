"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read ``<root>/<name>.parquet`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns with exact repeats of a row counted once.

    Columns are pruned first, so the shuffle carries only what the caller needs; the
    partial aggregate removes repeats before it."""
    return df.select(*columns).distinct()
