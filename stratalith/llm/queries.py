"""Queries of the training-data problems, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm import distinctive, handwritten, mixing, neighbours, packing, rankmix, sizes, spam, topn, validity
from stratalith.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vectors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.syntax_verdicts(table(spark, d, "files")).where(~F.col("valid")).select("file_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return validity.invalid_rates(table(spark, d, "files"))


def _origins(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.file_origins(table(spark, d, "files"), table(spark, d, "library_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _origins(spark, d).where(F.col("reason").isNotNull()).select("file_id").distinct()


def p3_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of hand-written files only."""
    return handwritten.handwritten_chunks(table(spark, d, "chunks"), _origins(spark, d)).select("chunk_id").distinct()


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    """How far the grammar rules of every file recur in other repositories."""
    return handwritten.shared_rules(table(spark, d, "files"), table(spark, d, "library_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits").select("hit_id", "chunk_id", "repo", "file_path", F.lower(F.trim("source")).alias("source"), "score")
    return topn.top_n(hits, ["repo", "file_path", "source"], "score", ["chunk_id", "hit_id"], 3).select("hit_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, d, "postings"), table(spark, d, "chunks")).select("doc_id", "term")


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.log_entropy(table(spark, d, "postings")).select("doc_id", "term", "df", F.round("weight", 6).alias("weight"))


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """The terms that weigh most in every chunk."""
    return distinctive.top_terms(table(spark, d, "postings"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rankmix.fused_top(table(spark, d, "hits"), table(spark, d, "queries")).select("query_id", "chunk_id")


def p7_walk(spark: SparkSession, d: str) -> DataFrame:
    """The ranking by the walk itself."""
    return rankmix.walk_top(table(spark, d, "hits"), table(spark, d, "queries")).select("query_id", "chunk_id", "place")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Where every document goes, for each capacity."""
    sized = sizes.with_sizes(table(spark, d, "documents").select("doc_id", "text"))
    return packing.fill_containers(sized, table(spark, d, "container_specs"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents with their copies, as much in all as the listed sources hold."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "doc_path", "text")
    return mixing.mix(sizes.with_sizes(docs), table(spark, d, "mix_targets"), "supply")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_documents(table(spark, d, "documents"))


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    """By what the flagged documents are spam."""
    return spam.spam_evidence(table(spark, d, "documents"))


QUERIES = {
    "p8_containers": p8_containers, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_evidence": p10_evidence,
    "p1_found": p1_found, "p2_found": p2_found, "p2_rates": p2_rates, "p3_found": p3_found, "p3_handwritten": p3_handwritten, "p3_shared": p3_shared, "p4_found": p4_found, "p6_found": p6_found, "p6_weights": p6_weights, "p6_top": p6_top, "p7_found": p7_found, "p7_walk": p7_walk}

ORACLE = {
    "p4_found": """
SELECT hit_id FROM (
  SELECT hit_id, row_number() OVER (PARTITION BY repo, file_path, lower(trim(source)) ORDER BY score DESC, chunk_id ASC NULLS FIRST, hit_id) AS n
  FROM (SELECT DISTINCT hit_id, chunk_id, repo, file_path, source, score FROM hits WHERE score IS NOT NULL AND NOT isnan(score))
) WHERE n <= 3
""",
    "p6_found": """
WITH p AS (SELECT term, doc_id, sum(tf) AS tf FROM (SELECT DISTINCT term, doc_id, tf FROM postings WHERE tf > 0 AND term IS NOT NULL AND doc_id IS NOT NULL) GROUP BY ALL),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT chunk_id, max(doc_len) AS doc_len FROM chunks GROUP BY chunk_id)
SELECT p.doc_id, p.term FROM p JOIN t USING (term) JOIN c ON c.chunk_id = p.doc_id
WHERE p.tf >= 3 AND 60 * p.tf >= c.doc_len AND t.df BETWEEN 2 AND 4
""",
    "p6_weights": """
WITH p AS (SELECT term, doc_id, sum(tf) AS tf FROM (SELECT DISTINCT term, doc_id, tf FROM postings WHERE tf > 0 AND term IS NOT NULL AND doc_id IS NOT NULL) GROUP BY ALL),
g AS (SELECT term, sum(tf)::DOUBLE AS gf, count(*) AS df FROM p GROUP BY term),
e AS (SELECT p.term, any_value(g.df) AS df, -sum((p.tf / g.gf) * ln(p.tf / g.gf)) / ln((SELECT count(DISTINCT doc_id) FROM p)) AS h FROM p JOIN g USING (term) GROUP BY p.term)
SELECT p.doc_id, p.term, e.df, round(ln(1 + p.tf) * greatest(0, 1 - e.h), 6) AS weight FROM p JOIN e USING (term)
""",
    "p6_top": """
WITH p AS (SELECT term, doc_id, sum(tf) AS tf FROM (SELECT DISTINCT term, doc_id, tf FROM postings WHERE tf > 0 AND term IS NOT NULL AND doc_id IS NOT NULL) GROUP BY ALL),
g AS (SELECT term, sum(tf)::DOUBLE AS gf FROM p GROUP BY term),
e AS (SELECT p.term, -sum((p.tf / g.gf) * ln(p.tf / g.gf)) / ln((SELECT count(DISTINCT doc_id) FROM p)) AS h FROM p JOIN g USING (term) GROUP BY p.term)
SELECT * FROM (SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY round(ln(1 + p.tf) * greatest(0, 1 - e.h), 9) DESC, p.term)::INT AS rank, p.term FROM p JOIN e USING (term)) WHERE rank <= 5
""",
    "p7_walk": """
WITH RECURSIVE h AS (
  SELECT query_id, chunk_id, lower(trim(source)) AS s, max(score) AS score FROM hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND lower(trim(source)) IN ('bm25', 'semantic') AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY score DESC, chunk_id) AS n FROM h),
i AS (SELECT query_id, chunk_id, max(n) FILTER (s = 'bm25') AS rb, max(n) FILTER (s = 'semantic') AS rs FROM r GROUP BY ALL),
t AS (SELECT query_id, max(rb) AS tb, max(rs) AS ts, count(*)::DOUBLE AS n FROM i GROUP BY query_id HAVING max(rb) IS NOT NULL AND max(rs) IS NOT NULL),
q AS (SELECT query_id, max(alpha) AS alpha FROM queries GROUP BY query_id),
g AS (SELECT query_id, chunk_id, coalesce(rb, tb + 1) AS ob, coalesce(rs, ts + 1) AS os, coalesce(rb, n) AS cb, coalesce(rs, n) AS cs, n, coalesce(alpha, 0.5) AS a FROM i JOIN t USING (query_id) LEFT JOIN q USING (query_id)),
w AS (
  SELECT 0 AS step, *, 1.0::DOUBLE / n AS x FROM g
  UNION ALL
  SELECT step + 1, query_id, chunk_id, ob, os, cb, cs, n, a,
    0.15 / n + 0.85 * ((1 - a) * sum(x / cb) OVER (PARTITION BY query_id ORDER BY ob DESC) + a * sum(x / cs) OVER (PARTITION BY query_id ORDER BY os DESC)) FROM w WHERE step < 60
), m AS (SELECT query_id, chunk_id, x / sum(x) OVER (PARTITION BY query_id) AS walk FROM w WHERE step = 60)
SELECT query_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(walk, 9) DESC, chunk_id)::INT AS place FROM m) WHERE place <= 5
""",
    "p7_found": """
WITH h AS (
  SELECT query_id, chunk_id, lower(trim(source)) AS s, max(score) AS score FROM hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND lower(trim(source)) IN ('bm25', 'semantic') AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY score DESC, chunk_id) AS n FROM h),
q AS (SELECT query_id, max(alpha) AS alpha FROM queries GROUP BY query_id),
f AS (
  SELECT r.query_id, r.chunk_id, round(sum(CASE WHEN s = 'semantic' THEN coalesce(alpha, 0.5) ELSE 1 - coalesce(alpha, 0.5) END / (60 + n)), 12) AS v
  FROM r LEFT JOIN q USING (query_id)
  WHERE r.query_id IN (SELECT query_id FROM r GROUP BY query_id HAVING count(DISTINCT s) = 2) GROUP BY r.query_id, r.chunk_id
)
SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) AS k FROM f) WHERE k <= 5
""",
}
