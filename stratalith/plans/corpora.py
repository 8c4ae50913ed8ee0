"""Corpora over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.sources.tables import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all repositories once each, their paths led by the repository."""
    t = table(spark, d, "chunks")
    # chunk_id is a key and repeats are exact, so a query that needs no content reads and moves none
    rows = t.select("chunk_id", F.concat_ws("/", "repo", "file_path").alias("file_path"), "language", "start_line", "end_line", "content", "doc_len")
    return rows.dropDuplicates(["chunk_id"])


CHUNKS = "(SELECT DISTINCT chunk_id, concat_ws('/', repo, file_path) AS file_path, language, start_line, end_line, content, doc_len FROM chunks)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the whole text under its repository and path."""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("chunk_id"), F.concat_ws("/", "repo", "doc_path").alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"))


DOCS = "(SELECT doc_id AS chunk_id, concat_ws('/', repo, doc_path) AS file_path, lang AS language, text AS content FROM documents)"

STEM = r"lower(regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '^(.+?)(?:\.[^.]*)?$', 1))"


def stem_sql(path: str) -> str:
    return STEM.format(path)


def dirs_sql(path: str) -> str:
    return f"list_slice(string_split({path}, '/'), greatest(len(string_split({path}, '/')) - 3, 1), len(string_split({path}, '/')) - 1)"
