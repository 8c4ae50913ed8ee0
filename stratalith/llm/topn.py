"""Top N rows of every group, by a hot-cold split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.operators.scale import heavy_keys, key_counts, materialise, small_join, split_heavy

RANGES = 64
SUBSALTS = 4


def top_n(
    df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], n: int, heavy_floor: int = 100_000
) -> DataFrame:
    """The first ``n`` distinct rows per group by ``score`` descending, then ``ties`` ascending.

    Exact repeats of a row count once. Null and NaN scores do not take part; null keys form a
    group like any other; ``ties`` must make the order total over distinct rows (nulls first).
    An empty table gives an empty one; all columns of ``df`` are kept, and a column called
    ``rank`` is replaced by the row's number. Rows that agree in score and ties but differ
    elsewhere are ordered by those other columns.

    Exact counts per group decide: light groups take one window, whose group limit Spark applies
    before the shuffle. A heavy group is cut into score ranges at its approximate quantiles,
    exact counts of the ranges from the top tell which can hold the first ``n``, those are salted
    and sorted apart, and a last window orders the at most ``n`` winners of each salt.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    df = df.drop("rank") if "rank" not in (*keys, score, *ties) else df
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    rest = [c for c in df.columns if c not in (*keys, score, *ties)]
    order = [F.col(score).desc(), *[F.col(c).asc_nulls_first() for c in ties]] + [F.col(c).asc_nulls_first() for c in rest]

    def first(rows: DataFrame, part: Sequence[str]) -> DataFrame:
        # repeats of a row share their dense rank, so they neither use up places nor survive
        w = Window.partitionBy(*part).orderBy(*order)
        return rows.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n)

    counts = key_counts(usable, keys)
    light, heavy = split_heavy(usable, keys, heavy_keys(counts, keys, heavy_floor))
    counts.unpersist()
    out = first(light, keys)
    if heavy is not None:
        # written once: quantiles, counts and winners read these rows, and not the whole input
        heavy = materialise(heavy.drop("_n"))
        out = out.unionByName(first(_range_winners(heavy, keys, score, n, first, order), keys))
    return out.dropDuplicates([*keys, "rank"])


def _range_winners(heavy: DataFrame, keys: Sequence[str], score: str, n: int, first, order: list[Column]) -> DataFrame:
    """At most ``n`` rows of each salt of the score ranges that can hold the group's first ``n``."""
    marks = [i / RANGES for i in range(1, RANGES)]
    cuts = heavy.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(score, marks))).alias("_cuts"))
    # one row per heavy group, and heavy groups are bounded (operators/scale.py)
    placed = small_join(heavy, cuts, keys).select(*heavy.columns, F.size(F.filter("_cuts", lambda c: c <= F.col(score))).alias("_range"))
    # repeats must not count as places; equal hashes can only make a count too small, which keeps more
    sizes = placed.groupBy(*keys, "_range").agg(F.count_distinct(F.xxhash64(*[F.col(c) for c in heavy.columns])).alias("_rows"))
    above = Window.partitionBy(*keys).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # at most RANGES rows per heavy group
    needed = sizes.withColumn("_above", F.coalesce(F.sum("_rows").over(above), F.lit(0))).where(F.col("_above") < n)
    kept = small_join(placed, needed.drop("_rows", "_above"), [*keys, "_range"], "left_semi")
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in heavy.columns]), F.lit(SUBSALTS)))
    winners = first(salted, [*keys, "_range", "_salt"])
    return winners.drop("_range", "_salt", "rank").select(*heavy.columns)
