"""Log-entropy weighting: how distinctive a term is for a record."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.operators.scale import lookup_join


def log_entropy(postings: DataFrame, heavy_floor: int = 100_000) -> DataFrame:
    """(doc_id, term, tf, df, weight) for ``postings`` (term, doc_id, tf), one row per pair.

    weight = ln(1 + tf) * (1 - H / ln N): H is the entropy of the term's spread over records and
    N the number of records. H = ln(gf) - sum(tf ln tf) / gf, so one aggregation over terms gives
    gf, H and df together. With N = 1 the global part is 1.

    Rows with null term, doc_id or tf, or tf <= 0, do not exist. Exact repeats count once; several
    different tf of a pair are added. An empty table gives an empty one. Terms in a large part
    of all records are joined by broadcast (``lookup_join``), so no task holds such a term.
    """
    usable = postings.select("term", "doc_id", "tf").where(
        F.col("term").isNotNull() & F.col("doc_id").isNotNull() & (F.col("tf") > 0)
    )
    pairs = usable.distinct().groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
    n = pairs.agg(F.count_distinct("doc_id")).first()[0]
    tf = F.col("tf").cast("double")
    terms = pairs.groupBy("term").agg(
        F.sum(tf).alias("_gf"), F.sum(tf * F.log(tf)).alias("_tlt"), F.count(F.lit(1)).alias("df")
    )
    spread = (F.log("_gf") - F.col("_tlt") / F.col("_gf")) / F.lit(float(math.log(n)) if n and n > 1 else 1.0)
    terms = terms.select("term", "df", F.greatest(F.lit(0.0), 1 - spread).alias("_global"))
    scored = lookup_join(pairs, terms, ["term"], "df", heavy_floor)
    return scored.select("doc_id", "term", "tf", "df", (F.log1p(tf) * F.col("_global")).alias("weight"))


def top_terms(postings: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, rank, term): the ``k`` terms of each record that weigh most, to 9 decimals; ties go
    to the term that sorts first. Rows that are no rows for ``log_entropy`` do not exist here; extra
    columns are ignored. Spark's group limit keeps k rows per record before the shuffle."""
    order = Window.partitionBy("doc_id").orderBy(F.round("weight", 9).desc(), "term")
    ranked = log_entropy(postings).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "term")


def distinctive_terms(
    postings: DataFrame, chunks: DataFrame, min_tf: int = 3, per: int = 60, min_df: int = 2, max_df: int = 4
) -> DataFrame:
    """Weighted rows whose term is frequent in its chunk and shared by few chunks.

    The weight finds the candidates: a term of at most ``max_df`` records has an entropy of at most
    ln(max_df), so a row with tf >= ``min_tf`` weighs at least ln(1 + min_tf) * (1 - ln(max_df) / ln N),
    and no row below that can qualify. An exact check follows: tf >= ``min_tf``, ``per`` * tf >=
    doc_len (a chunk without length has no rows), and df within ``min_df``..``max_df``."""
    weighted = log_entropy(postings)
    records = postings.where(F.col("term").isNotNull() & (F.col("tf") > 0)).agg(F.count_distinct("doc_id")).first()[0]
    floor = math.log1p(min_tf) * max(0.0, 1 - math.log(max_df) / math.log(records) if records > 1 else 1.0)
    found = weighted.where(F.col("weight") >= floor - 1e-9)
    scored = found.where((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df))
    lengths = chunks.select(F.col("chunk_id").alias("doc_id"), "doc_len").where(F.col("doc_len").isNotNull()).groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"))
    return scored.join(lengths, "doc_id").where(F.lit(per) * F.col("tf") >= F.col("doc_len"))
