"""Dense retrieval: exact cosine of one query against all vectors, and the hashing encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import vectors
from stratalith.functions.text import tokenize


def usable(table: DataFrame, dim: int) -> DataFrame:
    """Rows with exactly ``dim`` finite values: the sum of squares of floats is finite just then."""
    square = _sum(F.col("embedding")[i].cast("double") * F.col("embedding")[i].cast("double") for i in range(dim))
    return table.where((F.coalesce(F.size("embedding"), F.lit(-1)) == dim) & square.isNotNull() & ~F.isnan(square) & (square < F.lit(float("inf"))))


def _sum(terms) -> Column:
    """A flat sum of terms that stay inside generated code; sums of eight keep the tree shallow."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [sum(terms[i + 1 : i + 8], terms[i]) for i in range(0, len(terms), 8)]
    return terms[0]


def scores(table: DataFrame, query: list[float], selection: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score): cosine with ``query``; a narrow scan with the query as literals, so only
    ids and scores are told apart from their repeats. Rows of no length keep score 0. The sign does
    not restrict."""
    rows = table if selection is None else table.join(selection.select("chunk_id").distinct(), "chunk_id", "left_semi")
    v = [F.col("embedding")[i].cast("double") for i in range(len(query))]
    size = sum(x * x for x in query) ** 0.5
    dot = _sum(x * F.lit(float(q) / (size if size > 1e-8 else 1.0)) for x, q in zip(v, query))
    norm = F.sqrt(_sum(x * x for x in v))
    return rows.select("chunk_id", (dot / F.when(norm > 1e-8, norm).otherwise(1.0)).alias("score")).distinct()


def hash_vectors(texts: DataFrame, key: str, text: Column, dim: int = 256) -> DataFrame:
    """(key, idx, value): the sparse unit vector of every text's tokens, repeats included.

    One aggregation per (key, place) and one per key."""
    # texts move once, whole, to their key; every aggregation and the join below then stay in place
    terms = texts.select(key, text.alias("_text")).repartition(key).select(key, F.explode(tokenize(F.col("_text"))).alias("term"))
    # equal tokens are counted first, so each is hashed once per text
    counts = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(key, vectors.bucket(F.col("term"), dim).alias("idx")).agg(F.sum(F.col("n") * vectors.sign(F.col("term"))).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))  # at most ``dim`` rows a key
    return cells.withColumn("norm", norm).select(key, "idx", F.when(F.col("norm") > 1e-8, F.col("v") / F.col("norm")).otherwise(F.col("v")).alias("value")).where(F.col("value") != 0)


def hash_query(query: str, dim: int = 256) -> dict[int, float]:
    """The same vector of one text on the driver."""
    import hashlib

    from stratalith.functions.text import tokenize_str

    out: dict[int, float] = {}
    for t in tokenize_str(query):
        digest = hashlib.md5(t.encode()).hexdigest()
        i = int(digest[:8], 16) % dim
        out[i] = out.get(i, 0.0) + (-1.0 if int(digest[8], 16) >= 8 else 1.0)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {i: v / norm if norm > 1e-8 else v for i, v in out.items() if v}


def semantic_scores(index: DataFrame, query: str, dim: int = 256, selection: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) over a ``hash_vectors`` table keyed by chunk_id: only the places the query
    uses are read (an IN filter on idx)."""
    q = hash_query(query, dim)
    if not q:
        raise ValueError("the query has no terms")
    rows = index.where(F.col("idx").isin(list(q)))
    if selection is not None:
        rows = rows.join(selection.select("chunk_id").distinct(), "chunk_id", "left_semi")
    table = F.create_map(*[F.lit(x) for kv in q.items() for x in kv])
    return rows.groupBy("chunk_id").agg(F.sum(F.col("value") * table[F.col("idx")]).alias("score"))


def chunk_at(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """The first chunk of ``path`` that holds ``line``, else the first of the file."""
    if line < 1:
        raise ValueError("lines count from 1")
    holds = (F.col("start_line") <= line) & (F.col("end_line") >= line)
    return chunks.where(F.col("file_path") == path).orderBy(holds.desc(), "chunk_id").limit(1)
