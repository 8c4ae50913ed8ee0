"""Queries of the encoders over a small vocabulary and token vectors made from a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.operators import encoders
from stratalith.plans.corpora import CHUNKS, chunks

DIM = 6
_PIECES = "cache snap shot parse er con fig token query index re to un in on ing ed render state file path line config search".split()
VOCAB = ["[UNK]", *"abcdefghijklmnopqrstuvwxyz0123456789", *(f"##{c}" for c in "abcdefghijklmnoprstuvwxyz01234567"), *_PIECES, *(f"##{p}" for p in _PIECES), "(", ")", ".", "_", "=", ","]


def _vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(VOCAB, range(len(VOCAB)))), "token string, id int")


def _vectors(spark: SparkSession) -> DataFrame:
    v = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda j: ((F.col("id") * 37 + j * 11) % 19 - 9) / 10)
    return spark.range(1, len(VOCAB)).where("id % 9 <> 4").select(F.col("id").cast("int").alias("id"), v.alias("vector"))


def wordpiece_ids(spark: SparkSession, d: str) -> DataFrame:
    """How often each token stands in all chunks."""
    return encoders.wordpiece(chunks(spark, d), "chunk_id", F.col("content"), _vocabulary(spark)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def token_length(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(encoders.median_token_bytes(_vocabulary(spark)),)], "median int")


def wordpiece_pool(spark: SparkSession, d: str) -> DataFrame:
    """Pooled vectors of all chunks, rarer tokens weighing more."""
    v = _vocabulary(spark)
    weights = v.where("id % 2 = 0").select("id", (1 + F.col("id") / 100).alias("weight"))
    encoder = encoders.StaticEncoder(v, _vectors(spark), DIM, weights)
    return encoder.encode(chunks(spark, d), "chunk_id", F.col("content")).select("chunk_id", "idx", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (wordpiece_ids, token_length, wordpiece_pool)}

_V = "v AS (SELECT token, id, starts_with(token, '##') AS cont, CASE WHEN starts_with(token, '##') THEN substr(token, 3) ELSE token END AS piece FROM (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(VOCAB)) + ") t(token, id) WHERE id > 0)"


def _tokens(content: str) -> str:
    return rf"""{_V},
wd AS (SELECT chunk_id, unnest(range(1, len(ws) + 1)) AS wp, unnest(ws) AS w FROM (SELECT chunk_id, regexp_extract_all(lower({content}), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]') AS ws FROM {CHUNKS} WHERE content IS NOT NULL)),
st AS (
  SELECT w, 1 AS pos, 0 AS n, 0 AS id FROM (SELECT DISTINCT w FROM wd WHERE length(w) <= 100)
  UNION ALL
  SELECT w, pos + l, n + 1, id FROM (
    SELECT st.w, st.pos, st.n, v.id, length(piece) AS l, row_number() OVER (PARTITION BY st.w, st.pos ORDER BY length(piece) DESC) AS rn
    FROM st JOIN v ON v.cont = (st.pos > 1) AND starts_with(substr(st.w, st.pos), piece) WHERE st.pos <= length(st.w)) WHERE rn = 1
), good AS (SELECT w FROM st WHERE pos = length(w) + 1), pc AS (SELECT w, n, id FROM st WHERE n > 0 AND w IN (SELECT w FROM good)),
tk AS (SELECT chunk_id, wp, coalesce(n, 1) AS n, coalesce(pc.id, 0) AS id FROM wd LEFT JOIN pc USING (w))"""


_MEDIAN = sorted(len(t.encode()) for t in VOCAB)[len(VOCAB) // 2]
ORACLE = {
    "wordpiece_ids": f"WITH RECURSIVE {_tokens('content')} SELECT id::INT AS id, count(*) AS n FROM tk GROUP BY 1",
    "token_length": "SELECT length(token)::INT AS median FROM (SELECT unnest([" + ", ".join(f"'{t}'" for t in VOCAB) + f"]) AS token) ORDER BY length(token) LIMIT 1 OFFSET {len(VOCAB) // 2}",
    "wordpiece_pool": f"""WITH RECURSIVE {_tokens(f'left(content, 512 * {_MEDIAN})')},
kp AS (SELECT * FROM (SELECT chunk_id, id, row_number() OVER (PARTITION BY chunk_id ORDER BY wp, n) AS k FROM tk WHERE id > 0) WHERE k <= 512),
mn AS (SELECT chunk_id, j::INT AS idx, sum((CASE WHEN id % 2 = 0 THEN 1 + id / 100.0 ELSE 1 END) * ((id * 37 + j * 11) % 19 - 9) / 10.0)::DOUBLE / count(*) AS m FROM kp, range({DIM}) r(j) WHERE id % 9 <> 4 GROUP BY chunk_id, j)
SELECT chunk_id, idx, round(m / sqrt(s), 6) AS value FROM (SELECT *, sum(m * m) OVER (PARTITION BY chunk_id) AS s FROM mn) WHERE m <> 0 AND s > 1e-16""",
}
