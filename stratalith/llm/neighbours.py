"""Most similar vectors for every vector: inverted cells, additive codes, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.llm.quantise import Quantiser, fit
from stratalith.operators.scale import HEAVY_PER_PARTITION, lookup_join, materialise, shuffle_partitions

FIT_ROWS = 20_000  # vectors the codebooks and cells are fitted on, at most
CELL_ROWS = 256  # vectors per cell aimed at, whatever their number
PROBES = 16  # cells searched per vector
MEMBER_BLOCK = 4_096  # a task compares so many vectors of one cell at once
QUERY_BLOCK = 16_384  # with so many
SLACK = 1e-4  # what rounding may add to a distance from codes


def usable_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_id, embedding) once per id: exactly ``dim`` finite values and a length above 1e-8."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    # the size comes first in each test: rows may be null or short
    return (
        vectors.select("vec_id", "embedding")
        .where(F.col("vec_id").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(-1)) == dim) & finite)
        .where(F.sqrt(norm) > 1e-8)
        .distinct()
    )


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, k: int = 5, min_cosine: float = -1.0, dim: int = 64, probes: int | None = PROBES) -> DataFrame:
    """(vec_id, neighbour, cosine, rank): for every usable row the ``k`` others of greatest cosine.

    Ties go to the smaller vec_id; pairs below ``min_cosine`` do not come out. Null, short, NaN,
    infinite and all-zero vectors are no rows of the collection; repeated rows count once; a
    table without two usable rows gives none; extra columns are ignored.

    Rows with one vector form a class of which only the smallest ids are needed as neighbours
    (``k`` + 1 cover every member), so a vector shared by a third of all rows costs one entry.
    Codebooks and cells are fitted on the FIT_ROWS classes of smallest hash; every class is
    encoded and indexed. A query visits its ``probes`` nearest cells. There the distance from its
    additive code, less the stored error of that code, bounds a member's true distance from
    below; members whose bound exceeds ``min_cosine`` or the k-th smallest upper bound cannot
    come out, all others are compared exactly. So only unvisited cells can hold a lost neighbour,
    and ``probes=None`` visits all: the exact answer. What one side finds serves both.
    Cells hold CELL_ROWS vectors on average at every size; larger ones are cut into blocks. The
    loss is measured against brute force in the tests (recall at least 0.9 is required there).
    """
    spark = vectors.sparkSession
    out = "vec_id bigint, neighbour bigint, cosine double, rank int"
    rows = usable_vectors(vectors, dim).withColumn(
        "ck", F.concat_ws("-", F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))
    )
    first = Window.partitionBy("ck").orderBy("vec_id")
    heads = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    sizes = rows.groupBy("ck").agg(F.count(F.lit(1)).alias("n"))
    classes = (
        heads.groupBy("ck").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
        .join(sizes, "ck")
    )
    classes = materialise(classes.withColumn("rep", F.col("ids")[0]))
    count = classes.count()
    if not count:
        return spark.createDataFrame([], out)
    # the FIT_ROWS smallest hashes lie below this bound, but for chance; only these rows are sorted
    share = min(1.0, 1.25 * FIT_ROWS / count + 1e-3)
    hashed = classes.select("rep", "embedding", F.xxhash64("rep").alias("h")).where(F.col("h") <= int(share * 2**64) - 2**63 - (share == 1.0))
    sample = hashed.orderBy("h", "rep").limit(FIT_ROWS).select("embedding").toPandas()["embedding"]
    q = fit(_unit(np.array(sample.tolist(), np.float32)), max(1, count // CELL_ROWS))
    pairs = _search(classes, q, k, min_cosine, len(q.cells) if probes is None else probes)

    both = pairs.union(pairs.select("b", "a", "cosine")).toDF("rep", "b", "cosine").groupBy("rep", "b").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("rep").orderBy(F.col("cosine").desc(), "b")
    # written once: the join below reads it more than once, and the search must not run again
    best = materialise(both.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k))
    other = classes.select(F.col("rep").alias("b"), "ids")
    # a class may be near to very many; its ids are joined by their weight
    degree = best.groupBy("b").agg(F.count(F.lit(1)).alias("deg"))
    near = lookup_join(best, other.join(degree, "b"), ["b"], "deg").select(
        "rep", F.explode(F.transform("ids", lambda i: F.struct((-F.col("cosine")).alias("d"), i.alias("id")))).alias("x")
    )
    near = near.groupBy("rep").agg(F.collect_list("x").alias("others"))  # at most k * (k + 1)
    own = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id")))
    lists = classes.join(near, "rep", "left").select(
        "ck", "n", F.array_sort(F.concat(own, F.coalesce("others", F.array().cast("array<struct<d:double,id:bigint>>")))).alias("pool")
    )
    members = lookup_join(rows.select("vec_id", "ck"), lists, ["ck"], "n")
    chosen = F.slice(F.filter("pool", lambda x: (x["id"] != F.col("vec_id")) & (-x["d"] >= min_cosine)), 1, k)
    return members.select("vec_id", F.posexplode(chosen).alias("p", "x")).select(
        "vec_id", F.col("x.id").alias("neighbour"), (-F.col("x.d")).alias("cosine"), (F.col("p") + 1).alias("rank")
    )


def _search(classes: DataFrame, q: Quantiser, k: int, min_cosine: float, probes: int) -> DataFrame:
    """(a, b, cosine) between class representatives, at most ``k`` per query and visited block."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(q)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = shared.value
        for whole in batches:
            for i in range(0, len(whole), 2_000):
                pdf = whole.iloc[i : i + 2_000]
                raw = np.array(pdf["embedding"].tolist(), np.float32)
                x = _unit(raw).astype(np.float32)
                codes, lengths = z.encode(x)
                off = np.linalg.norm(x - z.decode(codes), axis=1)
                yield pd.DataFrame({
                    "rep": pdf["rep"].to_numpy(), "raw": [r.tobytes() for r in raw], "code": [c.tobytes() for c in codes],
                    "len2": lengths.astype(np.float32), "off": off.astype(np.float32), "near": list(z.cells.nearest(x, probes)),
                })

    coded = materialise(
        classes.select("rep", "embedding").mapInPandas(encode, "rep bigint, raw binary, code binary, len2 float, off float, near array<bigint>")
    )
    visits = coded.select("rep", "raw", F.posexplode("near").alias("place", "cell"))
    counts = visits.groupBy("cell").agg(F.count_if(F.col("place") == 0).alias("m"), F.count(F.lit(1)).alias("q"))
    blocks = _blocks(counts)
    cut = lambda df: df if blocks is None else df.join(F.broadcast(blocks), "cell", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(1)) if blocks is not None else F.lit(1)
    mine = lambda c: F.pmod(F.xxhash64("rep"), number(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), (number(c) - 1).cast("int")))
    members = cut(coded.select("rep", "raw", "code", "len2", "off", F.col("near")[0].alias("cell"))).withColumn("mb", mine("mbs")).withColumn("qb", each("qbs"))
    asked = cut(visits).withColumn("qb", mine("qbs")).withColumn("mb", each("mbs"))
    most = float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) + SLACK

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64), "cosine": np.array([], float)})
        if mine.empty or theirs.empty:
            return none
        z = shared.value
        codes = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), -1)
        lengths, off = mine["len2"].to_numpy(np.float32), mine["off"].to_numpy(np.float32) + np.float32(SLACK)
        reach = (off + np.float32(most)) ** 2 - 1
        ids, x = mine["mrep"].to_numpy(), _unit(_matrix(mine["mraw"]))
        found = []
        for i in range(0, len(theirs), 512):
            part = theirs.iloc[i : i + 512]
            names, y = part["qrep"].to_numpy(), _unit(_matrix(part["qraw"]))
            d2 = z.distances(y.astype(np.float32), codes, lengths)  # less 1, the query's own square
            near = d2 <= reach[None, :]
            many = np.flatnonzero(near.sum(1) > 4 * k) if len(ids) > k else []
            if len(many):  # these have members enough for the k-th smallest upper bound to tell some apart
                d = np.sqrt(np.maximum(1 + d2[many], 0))
                upper = d + off
                upper[ids[None, :] == names[many, None]] = 9.0  # not its own neighbour
                near[many] &= d - off <= np.partition(upper, k - 1, axis=1)[:, k - 1 : k]
            row, col = np.nonzero(near)
            if len(row) > 0.05 * d2.size:
                cosine = (y @ x.T)[row, col]
            else:
                cosine = np.einsum("pd,pd->p", y[row], x[col])
            cosine, other = np.minimum(cosine, 1.0), ids[col]
            good = (cosine >= min_cosine) & (other != names[row])
            row, other, cosine = row[good], other[good], cosine[good]
            o = np.lexsort((other, -cosine, row))
            row, other, cosine = row[o], other[o], cosine[o]
            first = np.searchsorted(row, row)
            best = np.arange(len(row)) - first < k
            found.append(pd.DataFrame({"a": names[row[best]], "b": other[best], "cosine": cosine[best]}))
        return pd.concat(found) if found else none

    # new names on both sides: they come from one table
    members = members.select("cell", "mb", "qb", "rep", "raw", "code", "len2", "off").toDF("mc", "mm", "mq", "mrep", "mraw", "code", "len2", "off")
    asked = asked.select("cell", "mb", "qb", "rep", "raw").toDF("qc", "qm", "qq", "qrep", "qraw")
    return members.groupBy("mc", "mm", "mq").cogroup(asked.groupBy("qc", "qm", "qq")).applyInPandas(
        compare, "a bigint, b bigint, cosine double"
    )


def _blocks(counts: DataFrame) -> DataFrame | None:
    """(cell, mbs, qbs) of the cells that are cut into blocks of members and of queries, or None.

    A cell is cut above MEMBER_BLOCK or QUERY_BLOCK rows, but never below the heavy bound of
    ``operators.scale``: at most HEAVY_PER_PARTITION cells per shuffle partition are cut by either
    count, so the list is bounded."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("m").alias("m"), F.sum("q").alias("q")).first()
    share = HEAVY_PER_PARTITION * shuffle_partitions(spark)
    mb, qb = max(MEMBER_BLOCK, (total["m"] or 0) // share), max(QUERY_BLOCK, (total["q"] or 0) // share)
    rows = counts.where((F.col("m") > mb) | (F.col("q") > qb)).select(
        "cell", F.greatest(F.ceil(F.col("m") / mb), F.lit(1)).alias("mbs"), F.greatest(F.ceil(F.col("q") / qb), F.lit(1)).alias("qbs")
    ).collect()
    return spark.createDataFrame(rows, "cell bigint, mbs bigint, qbs bigint") if rows else None


def similar_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.85, dim: int = 64) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: one is among the ``k`` nearest of the other, from ``min_cosine``."""
    found = nearest(vectors, k, min_cosine, dim)
    return found.select(
        F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")
    ).distinct()
