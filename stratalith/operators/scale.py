"""Skew-safe building blocks shared by all operators.

Every helper rests on one bound: with ``P`` shuffle partitions, a key is *heavy* when it
holds more than ``rows / (HEAVY_PER_PARTITION * P)`` rows, so there are at most
``HEAVY_PER_PARTITION * P`` heavy keys, however large the data. Only that bounded list is
ever collected or broadcast.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

HEAVY_PER_PARTITION = 4


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors can reach.

    It lies under ``spark.checkpoint.dir``; only where that is unset (a single machine, as in
    tests) a local temporary folder is used."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = _local_root()
    return os.path.join(root, uuid.uuid4().hex)


@cache
def _local_root() -> str:
    path = tempfile.mkdtemp(prefix="stratalith-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


_written: list[tuple[str, str]] = []  # (application, folder) of what this process materialised


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    _written.append((df.sparkSession.sparkContext.applicationId, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stratalith_folder = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_small(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver without a job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """``folder/name`` with ``text``, by one rename; fails where it exists, so one writer wins."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    staged = hadoop.Path(f"{folder}/{name}-{uuid.uuid4().hex[:8]}.tmp")
    fs = staged.getFileSystem(conf)
    out = fs.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(staged, hadoop.Path(f"{folder}/{name}"), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))


def release(df: DataFrame) -> None:
    """Delete the files of a materialised DataFrame that nothing reads any more."""
    folder = getattr(df, "_stratalith_folder", None)
    if folder:
        _delete(df.sparkSession, folder)


def purge(spark: SparkSession) -> int:
    """Delete all that this application materialised; for the time when its results are written or
    collected. Returns the number of folders."""
    mine = [x for x in _written if x[0] == spark.sparkContext.applicationId]
    for entry in mine:
        _delete(spark, entry[1])
        _written.remove(entry)
    return len(mine)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than cores dealt out evenly, for steps that compute much per row.

    Only small inputs have so few splits; larger ones are read as they lie, without a shuffle. A
    plan that shuffles already stays as it is: counting its partitions would run it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "InMemoryTableScan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact rows per key, combined map-side and kept for the several readers."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)


def heavy_keys(counts: DataFrame, keys: Sequence[str], floor: int = 100_000) -> DataFrame | None:
    """The heavy keys of ``key_counts`` as a DataFrame made of a bounded local list, or None.

    ``floor`` is the number of rows below which one task handles a key with ease."""
    spark = counts.sparkSession
    row = counts.agg(F.sum("_n").alias("s"), F.max("_n").alias("m")).first()
    threshold = max(floor, (row["s"] or 0) // (HEAVY_PER_PARTITION * shuffle_partitions(spark)))
    if not row["m"] or row["m"] <= threshold:
        return None
    rows = counts.where(F.col("_n") > threshold).collect()
    return spark.createDataFrame(rows, counts.schema)


def small_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equal ``keys`` with ``small`` broadcast; the caller vouches for its bound."""
    renamed = F.broadcast(small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & big[k].eqNullSafe(renamed[f"_k{i}"])
    return big.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


def split_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of light keys, rows of heavy keys with their count ``_n``)."""
    if heavy is None:
        return df, None
    return small_join(df, heavy, keys, "left_anti"), small_join(df, heavy, keys)


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, floor: int = 100_000) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key) that survives hot keys in ``big``.

    ``weight`` is a column of ``small`` with the key's rows in ``big``. Rows of ``small`` above the
    heavy bound are few (see the module) and go by broadcast; the rest is an ordinary shuffle join.
    ``keys`` must not be null."""
    spark = big.sparkSession
    row = small.agg(F.sum(weight).alias("s"), F.max(weight).alias("m")).first()
    threshold = max(floor, (row["s"] or 0) // (HEAVY_PER_PARTITION * shuffle_partitions(spark)))
    if not row["m"] or row["m"] <= threshold:
        return big.join(small, list(keys))
    hot = spark.createDataFrame(small.where(F.col(weight) > threshold).collect(), small.schema)
    names = hot.select(*keys)
    return (
        big.join(F.broadcast(names), list(keys), "left_anti")
        .join(small.where(F.col(weight) <= threshold), list(keys))
        .unionByName(big.join(F.broadcast(hot), list(keys)))
    )


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, floor: int = 100_000) -> DataFrame:
    """``row_number`` per key that never puts a heavy key into one task.

    Light keys take an ordinary window. Rows of heavy keys are range-sorted on (key, order): a
    row's number is its place in its sorted partition plus the rows of its key in the partitions
    before, which a table of (partition, key) counts gives. The order must be total."""
    window = Window.partitionBy(*keys).orderBy(*order)
    counts = key_counts(df, keys)
    light, heavy = split_heavy(df, keys, heavy_keys(counts, keys, floor))
    counts.unpersist()
    ranked = light.withColumn(name, F.row_number().over(window).cast("long"))
    if heavy is None:
        return ranked
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    by_key = [F.col(k).asc_nulls_first() for k in keys]
    placed = materialise(
        heavy.drop("_n")
        .repartitionByRange(parts, *by_key, *order)
        .sortWithinPartitions(*by_key, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    spans = placed.groupBy("_part", *keys).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most heavy keys + partitions rows: a partition either starts a key or continues one
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    far = small_join(placed, spans, ["_part", *keys]).select(
        *df.columns, (F.col("_place") - F.col("_first") + F.col("_before") + 1).cast("long").alias(name)
    )
    return ranked.unionByName(far)
