"""Lexical index and BM25 ranking.

Index tables: ``postings`` (term, chunk_id, tf) and ``lengths`` (chunk_id, dl). Document
frequency, count and mean length always come from the whole index; selections of chunks only
restrict which chunks are scored. ``None`` selects everything, an empty selection nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from stratalith.functions import paths
from stratalith.functions.text import tokenize, tokenize_str
from stratalith.operators.scale import lookup_join, materialise

K1, B = 1.5, 0.75


def indexed_terms(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term), one row per token: content, stem twice, the last three folders."""
    stem = tokenize(paths.stem(F.col("file_path")))
    dirs = F.flatten(F.transform(paths.last_dirs(F.col("file_path")), tokenize))
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(p, empty) for p in (tokenize(F.col("content")), stem, stem, dirs)]
    # texts move once, whole, to their chunk; the counts per (term, chunk) then stay in place
    return chunks.select("chunk_id", "file_path", "content").repartition("chunk_id").select("chunk_id", F.explode(F.concat(*parts)).alias("term"))


def build_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths)."""
    postings = indexed_terms(chunks).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    return postings, postings.groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _weight(n, avgdl):
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.lit(K1) * (1 - B + B * F.col("dl") / F.lit(max(float(avgdl or 0), 1.0)))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)


def scores(postings: DataFrame, lengths: DataFrame, query: str, selection: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) of all matching chunks.

    The distinct query terms reach the scan as literals; the postings of at most a handful of
    terms are joined with the lengths, and the selection prunes before that join but after the
    frequencies are taken."""
    terms = list(dict.fromkeys(tokenize_str(query)))
    if not terms:
        raise ValueError("the query has no terms")
    stats = corpus_stats(lengths).first()
    hit = postings.where(F.col("term").isin(terms))
    df = {r["term"]: r["df"] for r in hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # <= query terms
    if not df:
        return hit.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    table = F.create_map(*[F.lit(x) for kv in df.items() for x in kv])
    hit = hit.withColumn("df", table[F.col("term")])
    if selection is not None:
        hit = hit.join(selection.select("chunk_id").distinct(), "chunk_id", "left_semi")
    joined = hit.join(lengths, "chunk_id")
    out = joined.groupBy("chunk_id").agg(F.sum(_weight(stats["n"], stats["avgdl"])).alias("score"))
    return out.where(F.col("score") > 0)


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(rank, chunk_id, score): a partial top-k per task, then one small window."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = scored.select("chunk_id", F.round("score", digits).alias("score")).orderBy(F.col("score").desc(), "chunk_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id"))
    return best.select(place.alias("rank"), "chunk_id", "score")


FEW_TERMS = 500_000  # (query, term) rows, of some 40 bytes, up to which these go to all executors
TILE_CHUNKS, TILE_POSTINGS = 65_536, 2_000_000  # a task of ``batch`` scores so many chunks, with so many postings,
TILE_QUERIES, TILE_TERMS = 65_536, 1_000_000  # for so many queries, with so many terms; a chunk or query is not cut
TILE_CELLS = 4_000_000  # (query, chunk) pairs below which a task isn't worth its start
BLOCK = 8_192  # chunks whose scores are summed at once, within a core's cache
DENSE = 16  # a term in one of so many chunks of a block has a full row of weights there


def batch(postings: DataFrame, lengths: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_text, rank, chunk_id, score) for every distinct text of ``queries`` at once.

    A posting's weight is found once, before it meets the queries; queries and terms are numbers
    until the end. Few (query, term) rows (counted) are sent to all executors; many are joined on
    the term by a shuffle whose hot terms Spark splits. Groups of chunks then meet groups of
    queries: a task scores all its chunks for all its queries and lets out k per query, so no row
    per matching (query, chunk) is ever written. A last window merges the groups of chunks."""
    spark = postings.sparkSession
    stats = corpus_stats(lengths).first()
    texts = materialise(queries.select("query_text").where(F.col("query_text").isNotNull()).distinct().withColumn("q", F.monotonically_increasing_id()))
    wanted = materialise(texts.select("q", F.explode(F.array_distinct(tokenize(F.col("query_text")))).alias("term")))
    asking = wanted.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("q").alias("queries")).first()
    few = asking["terms"] <= FEW_TERMS
    known = wanted.select("term").distinct()
    used = materialise(postings.join(F.broadcast(known) if few else known, "term", "left_semi").select("term", "chunk_id", "tf"))
    df = materialise(used.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("t", F.monotonically_increasing_id()))
    found = used.join(F.broadcast(df), "term") if few else lookup_join(used, df, ["term"], "df")
    weighed = found.join(lengths, "chunk_id").select("chunk_id", "t", _weight(stats["n"], stats["avgdl"]).alias("w")).where(F.col("w").isNotNull())
    chunks = weighed.groupBy("chunk_id").agg(F.collect_list(F.struct("t", "w")).alias("x")).select("chunk_id", F.col("x.t").alias("ts"), F.col("x.w").alias("ws"))
    asked = wanted.join(F.broadcast(df) if few else df, "term").select("q", "t")

    n = df.agg(F.sum("df")).first()[0] or 0
    parts = max(1, -(-stats["n"] // TILE_CHUNKS), -(-n // TILE_POSTINGS))
    spread = min(2 * spark.sparkContext.defaultParallelism, asking["queries"] * stats["n"] // TILE_CELLS)
    sides = max(1, -(-asking["queries"] // TILE_QUERIES), -(-asking["terms"] // TILE_TERMS), -(-spread // parts))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    chunks = chunks.select(own("chunk_id", parts).alias("cp"), each(sides).alias("cs"), "chunk_id", "ts", "ws")
    asked = asked.select(each(parts).alias("qp"), own("q", sides).alias("qs"), "q", "t")
    schema = StructType([StructField("q", LongType()), StructField("chunk_id", postings.schema["chunk_id"].dataType), StructField("score", DoubleType())])
    scored = chunks.groupBy("cp", "cs").cogroup(asked.groupBy("qp", "qs")).applyInArrow(lambda c, a: best_of_tile(c, a, k), schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "chunk_id"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(texts, "q").select("query_text", "rank", "chunk_id", "score")


def best_of_tile(chunks: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(q, chunk_id, score): the ``k`` chunks of highest score above 0, to six digits, of each query.

    ``chunks`` has chunk_id, ts and ws (its terms and their weights; what comes twice counts
    twice), ``asked`` q and t. Chunks are numbered in their order and visited block by block, so of
    equal scores the first found stays."""
    docs = _array(chunks["chunk_id"]).dictionary_encode()
    order = pc.sort_indices(docs.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lists = _array(chunks["ts"])
    d = np.repeat(place[docs.indices.to_numpy()], pc.list_value_length(lists).to_numpy())
    terms, t = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    w = _array(chunks["ws"]).flatten().to_numpy()

    q, term = asked["q"].to_numpy(), asked["t"].to_numpy()
    at = np.searchsorted(terms, term)
    here = np.isin(term, terms)
    by = np.argsort(q[here], kind="stable")
    names, first = np.unique(q[here][by], return_index=True)
    words = [x.tolist() for x in np.split(at[here][by], first[1:])] if len(names) else []

    # postings in the order of block, term and chunk; weights of one term and chunk added up
    key = (d // BLOCK * len(terms) + t) * BLOCK + d % BLOCK
    key, of = np.unique(key, return_inverse=True)
    w = np.bincount(of, weights=w, minlength=len(key))
    row, d = key // BLOCK, key % BLOCK
    best = [(np.empty(0), np.empty(0, np.int64))] * len(names)
    least = [1.0] * len(names)  # in millionths, what a chunk must reach
    for b in range(0, len(order), BLOCK):
        size = min(BLOCK, len(order) - b)
        lo, hi = np.searchsorted(row, [b // BLOCK * len(terms), (b // BLOCK + 1) * len(terms)])
        cuts = np.flatnonzero(np.diff(row[lo:hi], prepend=-1)) + lo
        full, thin = {}, {}
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), hi]):
            if (j - i) * DENSE >= size:
                full[int(row[i]) % len(terms)] = np.bincount(d[i:j], weights=w[i:j], minlength=size)
            else:
                thin[int(row[i]) % len(terms)] = d[i:j], w[i:j]
        total = np.empty(size)
        for i, own in enumerate(words):
            rows, rare = [full[x] for x in own if x in full], [thin[x] for x in own if x in thin]
            if len(rows) > 1:
                np.add(rows[0], rows[1], out=total)
                for x in rows[2:]:
                    total += x
            elif rows:
                total[:] = rows[0]
            elif rare:
                total.fill(0.0)
            else:
                continue
            for x, y in rare:
                total[x] += y
            score, chunk = best[i]
            need = least[i]
            if len(score) < k and size >= 128 * k:
                # the k-th highest of the maxima of 64 chunks each is reached by k chunks
                tops = total[: size - size % 64].reshape(-1, 64).max(axis=1)
                need = max(need, _millionths(np.partition(tops, len(tops) - k)[len(tops) - k]))
            hits = np.flatnonzero(total > (need - 0.5) / 1e6 * (1 - 1e-9))
            if not len(hits):
                continue
            value = _millionths(total[hits])
            hits, value = hits[value >= need], value[value >= need]
            value, hits = np.concatenate([score, value]), np.concatenate([chunk, hits + b])
            top = np.argsort(-value, kind="stable")[:k]
            best[i] = value[top], hits[top]
            if len(top) == k > 0:
                least[i] = value[top[-1]] + 1
    counts = [len(x) for x, _ in best]
    scores, found = (np.concatenate(x) for x in zip(*best)) if best else (np.empty(0), np.empty(0, np.int64))
    return pa.table({"q": np.repeat(names, counts), "chunk_id": docs.dictionary.take(pa.array(order[found])), "score": scores / 1e6})


def _array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _millionths(score):
    return np.floor(score * 1e6 + 0.5)


def select_chunks(
    chunks: DataFrame, languages: Sequence[str] | None = None, prefixes: Sequence[str] | None = None, excludes: Sequence[str] | None = None
) -> DataFrame | None:
    """Chunks in one of ``languages`` (exact), below one of ``prefixes`` and outside ``excludes``;
    None where nothing restricts."""
    if languages is None and prefixes is None and not excludes:
        return None
    cond = F.lit(True)
    if languages is not None:
        cond = cond & F.col("language").isin(list(languages))
    if prefixes is not None:
        cond = cond & paths.under(F.col("file_path"), list(prefixes))
    if excludes:
        cond = cond & paths.exclude(F.col("file_path"), list(excludes))
    return chunks.where(cond).select("chunk_id")
