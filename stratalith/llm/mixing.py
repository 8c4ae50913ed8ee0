"""Mixing sources to target shares: iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.operators.scale import lookup_join, materialise

BIG = 0.005  # texts above this part of their source's target are drawn first
BLOCK_ROWS = 100_000  # rows of a block, on average
CELLS = 1_000_000  # cells up to which the driver solves the cell table; larger tables are solved by the cluster


def rake(tokens: np.ndarray, most: np.ndarray, source: np.ndarray, targets: np.ndarray, others: list[np.ndarray], steps: int = 200) -> np.ndarray:
    """Copies per token of each cell, so that sources meet their targets.

    ``targets`` is tokens wanted per source, ``most`` the cap of copies per cell. Each step scales
    cells to the marginals of the ``others`` (labelings whose shares in the supply are to be kept)
    and then to the sources, within the caps; the sources come last and so hold exactly where the
    caps leave room."""
    x = np.ones(len(tokens))
    k = len(targets)
    want = [np.bincount(o, tokens) / max(tokens.sum(), 1) for o in others]
    for _ in range(steps):
        old = x.copy()
        for o, share in zip(others, want):
            have = np.bincount(o, x * tokens, len(share))
            goal = share * have.sum()
            x = x * np.divide(goal, have, out=np.ones_like(goal), where=have > 0)[o]
            x = np.minimum(x, most)
        for _ in range(50):
            have = np.bincount(source, x * tokens, k)
            x = np.minimum(x * np.divide(targets, have, out=np.ones(k), where=have > 0)[source], most)
            now = np.bincount(source, x * tokens, k)
            free = np.bincount(source, (x < most) * tokens, k) > 0
            if np.all((np.abs(now - targets) <= 1e-9 * np.maximum(targets, 1)) | ~free):
                break
        if np.abs(x - old).max(initial=0) < 1e-10:
            break
    return x


def rake_cluster(cells: DataFrame, share: dict[str, float], caps: dict[str, float], steps: int = 40) -> DataFrame:
    """``rake`` for a cell table of any size: (source, lang, topic, tok, rate) with one aggregation
    and one join per marginal and step. ``share`` is tokens wanted per source."""
    cap = F.create_map(*[F.lit(v) for kv in caps.items() for v in kv])
    state = materialise(cells.withColumn("cap", cap[F.col("source")].cast("double")).withColumn("rate", F.lit(1.0)))
    total = state.agg(F.sum("tok")).first()[0]
    for _ in range(steps):
        nxt = state.withColumn("old", F.col("rate"))
        for label in ("lang", "topic"):
            have = nxt.groupBy(label).agg(F.sum(F.col("rate") * F.col("tok")).alias("h"), F.sum("tok").alias("s"), F.count(F.lit(1)).alias("n"))
            have = materialise(have)
            mixed = have.agg(F.sum("h")).first()[0]
            goal = F.col("s") / F.lit(float(total)) * F.lit(float(mixed))
            nxt = lookup_join(nxt, have, [label], "n").withColumn("rate", F.least("cap", F.col("rate") * F.when(F.col("h") > 0, goal / F.col("h")).otherwise(1.0))).drop("h", "s", "n")
            nxt = materialise(nxt)
        for _ in range(50):  # one row per source comes to the driver
            rows = nxt.groupBy("source").agg(F.sum(F.col("rate") * F.col("tok")).alias("h"), F.max(F.col("rate") < F.col("cap")).alias("free")).collect()
            if all(not r["free"] or abs(r["h"] - share[r["source"]]) <= 1e-9 * max(share[r["source"]], 1) for r in rows):
                break
            up = {r["source"]: share[r["source"]] / r["h"] if r["h"] > 0 else 1.0 for r in rows}
            factor = F.create_map(*[F.lit(v) for kv in up.items() for v in kv])
            nxt = nxt.withColumn("rate", F.least("cap", F.col("rate") * factor[F.col("source")]))
        state = materialise(nxt)
        if (state.agg(F.max(F.abs(F.col("rate") - F.col("old")))).first()[0] or 0) < 1e-6:
            break
        state = state.drop("old")
    return state.select("source", "lang", "topic", "tok", "rate")


def feasible_total(supply: np.ndarray, shares: np.ndarray, repeats: np.ndarray) -> float:
    """Largest total at which every source with supply still meets its share."""
    usable = (supply > 0) & (shares > 0)
    if not usable.any():
        return 0.0
    share = shares[usable] / shares[usable].sum()
    return float((supply[usable] * repeats[usable] / share).min())


def mix(documents: DataFrame, targets: DataFrame, total: float | str | None = None, size: str = "tokens") -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents in the mix; copies >= 1.

    ``documents`` has doc_id, source, lang, doc_path and ``size``; sources are compared trimmed and
    lower-case. Documents without a listed source or without size do not take part; a target whose
    source has no documents gives its share to the others in proportion; null or non-positive
    shares and caps count as 0. ``total`` is the size wanted; by default the largest at which every
    share can be met within max_repeats, so that no source falls short. With a larger total,
    capped sources fall short and ``shares`` reports it. "supply" is all there is of the listed
    sources. Repeated rows count once. An empty table
    or no usable target gives an empty result.

    Tokens are raked over cells of source, language (the primary subtag, so en-GB is en) and topic
    (the folder after the source in doc_path); every language and topic keeps its share of the
    supply as far as the sources allow.
    Copies are drawn systematically by size within blocks cut by hash, large texts first; the rates
    of the small ones are then calibrated to what remains of the source's target.
    """
    spark = documents.sparkSession
    out = f"doc_id bigint, source string, {size} bigint, copies int"
    wanted = (
        targets.select(F.lower(F.trim("source")).alias("s"), F.col("target_share").alias("t"), F.col("max_repeats").alias("m"))
        .groupBy("s").agg(F.max("t").alias("t"), F.max("m").alias("m")).where((F.col("t") > 0) & (F.col("m") > 0) & F.col("s").isNotNull())
        .orderBy("s").collect()  # small by contract: one row per source
    )
    if not wanted:
        return spark.createDataFrame([], out)
    names = [r["s"] for r in wanted]
    topic = F.regexp_extract(F.coalesce("doc_path", F.lit("")), r"^[^/]*/([^/]+)/", 1)
    docs = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.lower(F.split(F.trim(F.coalesce("lang", F.lit(""))), "[-_]")[0]).alias("lang"),
        topic.alias("topic"), F.col(size).cast("bigint").alias("tok"),
    ).where(F.col("source").isin(names) & (F.col("tok") > 0) & F.col("doc_id").isNotNull()).distinct()
    docs = materialise(docs)
    table = materialise(docs.groupBy("source", "lang", "topic").agg(F.sum("tok").alias("tok"), F.count(F.lit(1)).alias("_docs")))
    number = table.count()
    if not number:
        return spark.createDataFrame([], out)
    share = np.array([float(r["t"]) for r in wanted])
    caps = np.array([float(r["m"]) for r in wanted])
    had = {r["source"]: r["t"] for r in table.groupBy("source").agg(F.sum("tok").alias("t")).collect()}
    supply = np.array([float(had.get(name, 0)) for name in names])
    share = np.where(supply > 0, share, 0)
    share = share / share.sum()
    size_wanted = feasible_total(supply, share, caps) if total is None else supply.sum() if total == "supply" else float(total)
    goal = dict(zip(names, (share * size_wanted).tolist()))
    cap = F.create_map(*[F.lit(v) for kv in zip(names, caps.astype(int).tolist()) for v in kv])
    keys = ["source", "lang", "topic"]
    if number <= CELLS:
        cells = table.toPandas().sort_values(keys).reset_index(drop=True)
        code = cells["source"].map({s: i for i, s in enumerate(names)}).to_numpy()
        cells["rate"] = rake(cells["tok"].to_numpy(float), caps[code], code, share * size_wanted, [cells["lang"].factorize()[0], cells["topic"].factorize()[0]])
        rates = spark.createDataFrame(cells[[*keys, "_docs", "rate"]])
    else:
        rates = rake_cluster(table.select(*keys, "tok"), goal, dict(zip(names, caps.tolist()))).drop("tok").join(table.drop("tok"), keys)
    rates = materialise(rates)
    # a cell may hold a third of all documents
    drawn = lookup_join(docs, rates, keys, "_docs").withColumn("cap", cap[F.col("source")])
    big = F.lit(False)
    for name in names:
        big = big | ((F.col("source") == name) & (F.col("tok") > goal[name] * BIG))
    drawn = materialise(drawn.withColumn("big", big))
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    # large texts first: what they add too much or too little, the small ones make up for
    large = materialise(_draw(drawn.where("big"), F.col("rate"), blocks))
    got = {r["source"]: r["t"] for r in large.groupBy("source").agg(F.sum(F.col("tok") * F.col("copies")).alias("t")).collect()}
    rest = {r["source"]: r["t"] for r in drawn.where("NOT big").groupBy("source").agg(F.sum(F.col("tok") * F.col("rate")).alias("t")).collect()}
    factor = F.lit(1.0)
    for name in names:
        left = max(0.0, goal[name] - got.get(name, 0)) / rest[name] if rest.get(name) else 1.0
        factor = F.when(F.col("source") == name, F.lit(float(left))).otherwise(factor)
    small = _draw(drawn.where("NOT big"), F.least(F.col("rate") * factor, F.col("cap").cast("double")), blocks)
    return large.unionByName(small).where(F.col("copies") > 0).select("doc_id", "source", F.col("tok").alias(size), "copies")


def _draw(docs: DataFrame, rate: Column, blocks: int) -> DataFrame:
    """Systematic sampling of copies by size within blocks of a source: the running sum of rates is
    rounded, so any run of texts of like size gets its share to within one copy."""
    stratum = ["source", "block"]
    laid = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(blocks))).withColumn("rate", rate)
    run = Window.partitionBy(*stratum).orderBy(F.col("tok").desc(), F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(*stratum), F.lit(1_000_003)) / F.lit(1_000_003.0)
    laid = laid.withColumn("c", F.sum("rate").over(run)).withColumn("u", start)
    copies = F.floor(F.col("c") + F.col("u") + 1e-9) - F.floor(F.col("c") - F.col("rate") + F.col("u") + 1e-9)
    return laid.withColumn("copies", F.least(F.col("cap").cast("bigint"), copies).cast("int")).select("doc_id", "source", "tok", "copies")


def shares(mixed: DataFrame, targets: DataFrame, size: str = "tokens") -> DataFrame:
    """(source, target_share, documents, tokens, share) reached, also for targets without any."""
    have = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(size) * F.col("copies")).alias("tokens"))
    total = Window.partitionBy()
    want = targets.select(F.lower(F.trim("source")).alias("source"), "target_share").groupBy("source").agg(F.max("target_share").alias("target_share"))
    # one row per source
    return (
        want.join(have, "source", "left").na.fill(0, ["documents", "tokens"])
        .withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(total), 6))
    )
