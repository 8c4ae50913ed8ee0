"""One ranking from several differently-scaled scores: a rank-walk Markov chain.

From an item the walker picks a source by its weight and jumps uniformly to an item ranked at
least as high there, so only ranks matter and no scale can dominate. An item that a source does
not rank stands behind all it ranks. With damping d the chain restarts uniformly with
probability 1 - d; stationary mass orders the items.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.operators.scale import heavy_keys, key_counts, materialise, rank_in_groups, release, shuffle_partitions, split_heavy

BLOCK = 4096
BUCKET_ROWS = 200_000
SOURCES = ("bm25", "semantic")
SETTLED = 1e-12  # the walk stops when no mass moves more in a step


def stationary(group: np.ndarray, ranks: np.ndarray, weights: np.ndarray, damping: float, steps: int) -> np.ndarray:
    """Stationary mass of many groups at once, one sum of 1 per group.

    ``group`` is sorted; ``ranks`` and ``weights`` are items x sources, rank 1 is best, 0 missing.
    One step costs a suffix sum per source: mass x_i / r_i reaches every item ranked at or above
    i, so an item receives the sum over its own and all worse ranks of its group."""
    items, m = ranks.shape
    if not items:
        return np.empty(0)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    seg = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, items]))
    n = np.diff(np.r_[starts, items])[seg].astype(float)
    ends = np.r_[starts[1:], items][seg]
    plans = []
    for s in range(m):
        top = np.maximum.reduceat(ranks[:, s], starts)[seg]
        r = np.where(ranks[:, s] > 0, ranks[:, s], top + 1)  # the missing share the place behind the last
        reach = np.where(ranks[:, s] > 0, ranks[:, s], n)  # from there every item can be reached
        o = np.lexsort((r, seg))
        same = np.r_[True, (seg[o][1:] != seg[o][:-1]) | (r[o][1:] != r[o][:-1])]
        first = np.maximum.accumulate(np.where(same, np.arange(items), 0))
        plans.append((o, reach, first))
    x = 1.0 / n
    for _ in range(steps):
        nxt = (1.0 - damping) / n
        for s, (o, reach, first) in enumerate(plans):
            tail = np.r_[np.cumsum((x / reach)[o][::-1])[::-1], 0.0]
            got = np.empty(items)
            got[o] = tail[first] - tail[ends[o]]
            nxt = nxt + damping * weights[:, s] * got
        moved = np.abs(nxt - x).max()
        x = nxt
        if moved < SETTLED:
            break
    return x / np.add.reduceat(x, starts)[seg]


def ranked_sources(
    hits: DataFrame, group: str, item: str, source: str, score: str, sources: Sequence[str], heavy_floor: int = 100_000
) -> DataFrame:
    """(group, item, rank_<source>...) from long rows; rank 1 is the highest score.

    Sources are compared trimmed and lower-case; null or NaN scores do not take part; exact
    repeats count once, and of several scores of an item in a source the best one counts."""
    rows = (
        hits.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.lower(F.trim(F.col(source))).alias("_s"), F.col(score).alias("_v"))
        .where(F.col("_s").isin(*sources) & F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_g").isNotNull() & F.col("_i").isNotNull())
        .groupBy("_g", "_s", "_i").agg(F.max("_v").alias("_v"))
    )
    placed = rank_in_groups(rows, ["_g", "_s"], [F.col("_v").desc(), F.col("_i").asc()], "_r", heavy_floor)
    wide = placed.groupBy("_g", "_i").agg(*[F.max(F.when(F.col("_s") == s, F.col("_r"))).alias(f"rank_{s}") for s in sources])
    return wide.withColumnsRenamed({"_g": group, "_i": item})


def rank_walk(
    ranks: DataFrame, weights: DataFrame, group: str, item: str, sources: Sequence[str],
    damping: float = 0.85, steps: int = 60, heavy_floor: int = 100_000,
) -> DataFrame:
    """``ranks`` (see ``ranked_sources``) with ``walk``, the stationary mass within its group.

    ``weights`` has one row per group and a column ``w_<source>`` each; null weights share what
    the others leave equally, and a group without a row weighs all sources alike. Groups below
    the heavy bound are solved by one task each; larger ones by ``_heavy_walk``, whose tasks hold
    blocks of BLOCK ranks.
    """
    cols = [f"rank_{s}" for s in sources]
    names = [f"w_{s}" for s in sources]
    w = weights.select(F.col(group).alias("_wg"), *names)
    even = 1.0 / len(sources)
    rows = ranks.join(w, ranks[group] == w["_wg"], "left").select(
        ranks[group].alias("g"), ranks[item].alias("i"), *[F.col(c).cast("long") for c in cols],
        *[F.coalesce(F.col(x), F.lit(even)).alias(x) for x in names],
    )
    counts = key_counts(rows, ["g"])
    total = counts.agg(F.sum("_n")).first()[0] or 0
    light, heavy = split_heavy(rows, ["g"], heavy_keys(counts, ["g"], heavy_floor))
    counts.unpersist()
    buckets = max(shuffle_partitions(ranks.sparkSession), total // BUCKET_ROWS + 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", kind="stable")
        code = pdf["g"].factorize()[0]
        r = pdf[cols].fillna(0).to_numpy(np.int64)
        return pdf.assign(walk=stationary(code, r, pdf[names].to_numpy(float), damping, steps))[["g", "i", *cols, "walk"]]

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"g {kind['g']}, i {kind['i']}, " + ", ".join(f"{c} long" for c in cols) + ", walk double"
    # a task solves a bucket of many whole groups at once: BUCKET_ROWS rows on average
    bucket = F.pmod(F.xxhash64("g"), F.lit(buckets))
    out = light.groupBy(bucket.alias("bucket")).applyInPandas(solve, schema)
    if heavy is not None:
        out = out.unionByName(_heavy_walk(heavy, cols, names, damping, steps).select(out.columns))
    return out.withColumnsRenamed({"g": group, "i": item})


def _heavy_walk(heavy: DataFrame, cols: list[str], names: list[str], damping: float, steps: int) -> DataFrame:
    """The same iteration on a cluster: suffix sums within rank blocks plus sums of whole blocks."""
    state = heavy.withColumn("x", 1.0 / F.col("_n"))
    tops = heavy.groupBy("g").agg(*[F.max(c).alias(f"top_{c}") for c in cols])
    written = state = materialise(state.join(F.broadcast(tops), "g"))
    for _ in range(steps):
        nxt = state
        total = F.lit(0.0)
        for k, (c, wname) in enumerate(zip(cols, names)):
            r = F.coalesce(F.col(c), F.col(f"top_{c}") + 1)
            reach = F.coalesce(F.col(c), F.col("_n"))
            nxt = nxt.withColumn(f"b{k}", (r / BLOCK).cast("long")).withColumn(f"f{k}", F.col("x") / reach).withColumn(f"r{k}", r)
            # missing items share one place: their flow counts only through the block's sum
            blocks = nxt.groupBy("g", f"b{k}").agg(F.sum(F.when(F.col(c).isNotNull(), F.col(f"f{k}"))).alias(f"bs{k}"))
            lost = nxt.groupBy("g").agg(F.sum(F.when(F.col(c).isNull(), F.col(f"f{k}"))).alias(f"lost{k}"))
            below = Window.partitionBy("g").orderBy(F.col(f"b{k}").desc()).rowsBetween(Window.unboundedPreceding, -1)
            blocks = blocks.withColumn(f"below{k}", F.coalesce(F.sum(f"bs{k}").over(below), F.lit(0.0))).drop(f"bs{k}")
            inside = Window.partitionBy("g", f"b{k}").orderBy(F.col(f"r{k}").desc()).rowsBetween(Window.unboundedPreceding, 0)
            held = nxt.where(F.col(c).isNotNull()).withColumn(f"in{k}", F.sum(f"f{k}").over(inside))
            free = nxt.where(F.col(c).isNull()).withColumn(f"in{k}", F.lit(0.0))
            nxt = held.unionByName(free).join(blocks, ["g", f"b{k}"]).join(F.broadcast(lost), "g")
            got = F.when(F.col(c).isNotNull(), F.col(f"in{k}") + F.col(f"below{k}")).otherwise(0.0) + F.coalesce(F.col(f"lost{k}"), F.lit(0.0))
            nxt = nxt.withColumn(f"got{k}", got * F.col(wname)).drop(f"in{k}", f"below{k}", f"lost{k}", f"b{k}", f"f{k}", f"r{k}")
            total = total + F.col(f"got{k}")
        nxt = nxt.withColumn("_x", (1 - damping) / F.col("_n") + damping * total).drop(*[f"got{k}" for k in range(len(cols))])
        nxt = materialise(nxt.withColumn("_moved", F.abs(F.col("_x") - F.col("x"))).drop("x").withColumnRenamed("_x", "x"))
        settled = nxt.agg(F.max("_moved")).first()[0] < SETTLED
        release(written)  # the step before
        written, state = nxt, nxt.drop("_moved")
        if settled:
            break
    mass = state.groupBy("g").agg(F.sum("x").alias("_mass"))
    return state.join(F.broadcast(mass), "g").withColumn("walk", F.col("x") / F.col("_mass"))


def _both_sources(hits: DataFrame, queries: DataFrame, heavy_floor: int) -> tuple[DataFrame, DataFrame]:
    """(ranks, weights) of the queries with usable hits in both bm25 and semantic; null alpha is 0.5."""
    ranks = ranked_sources(hits, "query_id", "chunk_id", "source", "score", SOURCES, heavy_floor)
    both = ranks.groupBy("query_id").agg(F.max("rank_bm25").alias("a"), F.max("rank_semantic").alias("b"))
    both = both.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("query_id")
    alphas = queries.select("query_id", "alpha").groupBy("query_id").agg(F.max("alpha").alias("alpha"))
    weights = both.join(alphas, "query_id", "left").select(
        "query_id", F.coalesce("alpha", F.lit(0.5)).alias("w_semantic")
    ).withColumn("w_bm25", 1 - F.col("w_semantic"))
    return ranks.join(both, "query_id", "left_semi"), weights


def _places(scored: DataFrame, order: Column, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(order.desc(), F.col("chunk_id").asc())
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def walk_top(hits: DataFrame, queries: DataFrame, k: int = 5, heavy_floor: int = 100_000) -> DataFrame:
    """(query_id, chunk_id, walk, place): the ``k`` chunks of greatest stationary mass per query with
    both sources, to 9 decimals; ties go to the smaller chunk_id."""
    ranks, weights = _both_sources(hits, queries, heavy_floor)
    walked = rank_walk(ranks, weights, "query_id", "chunk_id", SOURCES, heavy_floor=heavy_floor)
    return _places(walked, F.round("walk", 9), k).select("query_id", "chunk_id", "walk", "place")


def fused_top(hits: DataFrame, queries: DataFrame, k: int = 5, constant: int = 60, heavy_floor: int = 100_000) -> DataFrame:
    """(query_id, chunk_id, rrf, place) of the ``k`` best chunks per query with both sources.

    The order is the weighted reciprocal-rank sum over the same ranks that the walk takes, rounded
    to 12 decimals, ties to the smaller chunk_id. No stationary order gives this one (README)."""
    ranks, weights = _both_sources(hits, queries, heavy_floor)
    part = lambda s: F.coalesce(F.col(f"w_{s}") / (constant + F.col(f"rank_{s}")), F.lit(0.0))
    scored = ranks.join(weights, "query_id").withColumn("rrf", F.round(part("semantic") + part("bm25"), 12))
    return _places(scored, F.col("rrf"), k).select("query_id", "chunk_id", "rrf", "place")
