"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators.scale import materialise

WINDOW_ITEMS = 1_000  # items differenced together; the rest of a window's last container is the loss


def difference(sizes: Sequence[int], ways: int) -> list[list[int]]:
    """Indices in ``ways`` groups of nearly equal sums.

    Each item starts as a partial partition with one filled group. The two partitions of largest
    imbalance are merged, the heaviest group of one with the lightest of the other, until one
    is left."""
    if ways <= 1:
        return [list(range(len(sizes)))]
    # groups are chains (sum, tree) and only filled groups are stored, lightest last
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [(s, i)]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = ways - len(a)
        if len(b) <= free:
            merged = a + b
        else:
            # empty groups of a take the heaviest of b; the others pair up against each other
            merged = b[:free]
            rest = b[free:]
            over = len(rest)
            merged += a[: len(a) - over]
            for (x, left), (y, right) in zip(a[len(a) - over :], reversed(rest)):
                merged.append((x + y, (left, right)))
        merged.sort(key=itemgetter(0), reverse=True)
        low = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (-(merged[0][0] - low), tick, merged))
        tick += 1
    groups = []
    for _, tree in heap[0][2] if heap else []:
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack.extend(t)
            else:
                out.append(t)
        groups.append(out)
    return groups


def pack(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Groups within ``capacity``: differencing into the fewest containers that could do, one more
    whenever a group overflows. Items larger than half the capacity bound the number as well."""
    total, halves = sum(sizes), sum(2 * s > capacity for s in sizes)
    ways = max(1, -(-total // capacity), halves)
    while True:
        groups = difference(sizes, ways)
        heaviest = max((sum(sizes[i] for i in g) for g in groups), default=0)
        if heaviest <= capacity:
            return _close(groups, sizes, capacity)
        ways += max(1, min(len(sizes) - ways, (heaviest - capacity) * ways // (4 * capacity)))


def _close(groups: list[list[int]], sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Dissolve the lightest groups into the room of the others, as long as one fits whole."""
    groups = sorted(groups, key=lambda g: -sum(sizes[i] for i in g))
    while len(groups) > 1:
        last, room = groups[-1], [capacity - sum(sizes[i] for i in g) for g in groups[:-1]]
        moves = []
        for i in sorted(last, key=lambda i: -sizes[i]):
            fits = [k for k, r in enumerate(room) if r >= sizes[i]]
            if not fits:
                return groups
            k = min(fits, key=lambda k: room[k])
            room[k] -= sizes[i]
            moves.append((i, k))
        groups.pop()
        for i, k in moves:
            groups[k].append(i)
    return groups


def fill_containers(items: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(spec_name, capacity, container, doc_id, part, tokens): where every item goes, per capacity.

    An item larger than the capacity is cut into full parts, each a container of its own, and a
    remainder that is packed like an item; no other item is cut. Items without size (null or 0) go
    nowhere, repeated rows count once, specs without a positive capacity are ignored, an empty
    table gives an empty one. ``specs`` is small by contract.

    Items are dealt by hash into windows of about WINDOW_ITEMS, whatever their key, so no task
    grows with the data; each window is packed apart and loses at most the rest of one container.
    The sizes are written once: counting, cutting and packing all read them. Specs of one name and
    two capacities are two specs.
    """
    rows = items.select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("s")).where(F.col("k").isNotNull() & (F.col("s") > 0)).distinct()
    rows = materialise(rows)
    caps = specs.select("spec_name", F.col("capacity").cast("bigint").alias("capacity")).where(F.col("capacity") > 0).distinct()
    each = rows.crossJoin(F.broadcast(caps))  # a handful of capacities, stated as parameters
    cut = each.withColumn("full", F.floor(F.col("s") / F.col("capacity")))
    whole = cut.where(F.col("s") >= F.col("capacity")).select(
        "spec_name", "capacity", "k", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"), F.col("capacity").alias("tokens")
    ).withColumn("container", F.concat_ws("-", F.lit("f"), F.col("k"), F.col("part")))
    rest = cut.select("spec_name", "capacity", "k", F.col("full").alias("part"), (F.col("s") % F.col("capacity")).alias("tokens")).where(F.col("tokens") > 0)
    count = rows.count()
    windows = max(1, round(count / WINDOW_ITEMS))
    dealt = rest.withColumn("w", F.pmod(F.xxhash64("k", "part"), F.lit(windows)))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}["k"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "k", "part"], ascending=[False, True, True]).reset_index(drop=True)
        sizes = pdf["tokens"].tolist()
        names = np.empty(len(pdf), object)
        for n, group in enumerate(pack(sizes, int(pdf["capacity"].iloc[0]))):
            names[group] = f"w-{pdf['w'].iloc[0]}-{n}"
        return pd.DataFrame({"spec_name": pdf["spec_name"], "capacity": pdf["capacity"], "k": pdf["k"], "part": pdf["part"], "tokens": pdf["tokens"], "container": names})

    schema = f"spec_name string, capacity bigint, k {kind}, part bigint, tokens bigint, container string"
    packed = dealt.groupBy("spec_name", "capacity", "w").applyInPandas(solve, schema)
    both = packed.unionByName(whole.select(packed.columns))
    return both.select("spec_name", "capacity", "container", F.col("k").alias(key), "part", F.col("tokens").alias(size))


def container_use(filled: DataFrame, size: str = "tokens") -> DataFrame:
    """(spec_name, capacity, containers, items, used) where used is the share of capacity filled."""
    per = filled.groupBy("spec_name", "capacity", "container").agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("i"))
    return per.groupBy("spec_name", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("i").alias("items"), F.max("t").alias("fullest"),
        F.round(F.sum("t") / (F.count(F.lit(1)) * F.col("capacity")), 6).alias("used"),
    )
