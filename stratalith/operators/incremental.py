"""Processing only new or changed records.

The commit sequence is ``loaded_at``. A run reads the half-open interval (watermark of the last
successful run, its own upper limit], and the upper limit is fixed when the run starts, so rows
that arrive meanwhile wait for the next run. A failed run moves nothing: the next successful one
covers its interval too.

``IncrementalStore`` is one such step, committing output, state and watermark together; ``replay``
takes a log of runs through it, failed ones included. ``change_feed`` states the same result in one
plan without a store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.operators.scale import publish, read_small


def normal_path(path: Column) -> Column:
    """One spelling per path: forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def _versions(signatures: DataFrame) -> DataFrame:
    """Usable signature rows with the state and the order in which states supersede each other."""
    return signatures.where(
        F.col("len").isNotNull() & F.col("mtime_ns").isNotNull() & F.col("loaded_at").isNotNull()
        & F.col("walked_at").isNotNull() & F.col("rel_path").isNotNull()
    ).select(
        "repo",
        normal_path(F.col("rel_path")).alias("rel_path"),
        "loaded_at",
        # struct order: the last walk wins; equal walks are settled by arrival and id
        F.struct("walked_at", "loaded_at", "sig_id", "len", "mtime_ns").alias("v"),
    )


def _entries(parse_cache: DataFrame) -> DataFrame:
    return parse_cache.select(
        F.col("repo").alias("repo"),
        normal_path(F.col("rel_path")).alias("rel_path"),
        F.struct(F.col("size").alias("len"), (F.col("mtime_secs") * F.lit(10**9) + F.col("mtime_nanos")).alias("mtime_ns")).alias("entry"),
    ).groupBy("repo", "rel_path").agg(F.max("entry").alias("entry"))


def _limit(at) -> Column:
    """A timestamp literal without zone: a datetime literal would be read in the session's zone."""
    return F.lit(str(at)).cast("timestamp_ntz")


def run_intervals(runs: DataFrame) -> list[tuple[int, object]]:
    """(run_id, upper limit) of the successful runs in order; the run log is small by contract
    (one row per run) and is the only thing collected."""
    rows = runs.where((F.col("status") == "success") & F.col("started_at").isNotNull()).select("run_id", "started_at").distinct()
    return sorted((r["run_id"], r["started_at"]) for r in rows.orderBy("started_at", "run_id").collect())


def change_feed(signatures: DataFrame, runs: DataFrame, parse_cache: DataFrame) -> DataFrame:
    """(run_id, repo, rel_path) of every file each successful run must process, each once.

    Nulls: rows without len, mtime_ns, walked_at, loaded_at or rel_path are no observations; a
    null repo is a repo of its own. Repeated rows, re-deliveries and late rows change nothing
    unless they change the state. No runs, or no signatures, give no rows. Extra columns are
    ignored. A file's rows are reduced to one per run before any window, so a file with a third
    of all rows costs no more than others."""
    limits = run_intervals(runs)
    spark = signatures.sparkSession
    schema = "run_id bigint, repo string, rel_path string"
    if not limits:
        return spark.createDataFrame([], schema)
    kind = signatures.schema["loaded_at"].dataType
    uppers = F.array(*[_limit(at).cast(kind) for _, at in limits])
    ids = F.array(*[F.lit(int(run)).cast("long") for run, _ in limits])
    rows = _versions(signatures)
    # the first run whose upper limit covers the row
    position = F.size(F.filter(uppers, lambda u: u < F.col("loaded_at")))
    rows = rows.withColumn("pos", position).where(F.col("pos") < len(limits))
    latest = rows.groupBy("repo", "rel_path", "pos").agg(F.max("v").alias("v"))
    by_file = Window.partitionBy("repo", "rel_path").orderBy("pos")
    running = by_file.rowsBetween(Window.unboundedPreceding, 0)
    seen = latest.withColumn("now", F.max("v").over(running)).withColumn(
        "was", F.max("v").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    )
    entries = _entries(parse_cache)
    joined = seen.join(entries, seen["repo"].eqNullSafe(entries["repo"]) & (seen["rel_path"] == entries["rel_path"]), "left").select(
        seen["repo"], seen["rel_path"], "pos", "now", "was", "entry"
    )
    state = lambda s: F.struct(s["len"].alias("len"), s["mtime_ns"].alias("mtime_ns"))
    before = F.when(F.col("was").isNotNull(), state(F.col("was"))).otherwise(F.col("entry"))
    changed = joined.where(~state(F.col("now")).eqNullSafe(before))
    return changed.select(F.element_at(ids, F.col("pos") + 1).alias("run_id"), "repo", "rel_path")


FEW_KEYS = 200_000  # keys (of some 100 bytes) up to which a run's keys are sent to the readers of the state


@dataclass
class IncrementalStore:
    """State, outputs and watermark of a repeated run, under ``root`` in a shared filesystem.

    A run writes the keys it met to ``root/v=<n>-<random>/delta``, then renames
    ``root/commits/<n>-<random>.tmp`` to ``<n>``: output, state and watermark are published
    together. A run that dies before the rename leaves files nobody reads, and its interval is
    read again.

    The state is a short list of parts, each with the newest state of some keys. A run writes only
    the keys it met; it merges them with the last parts as long as these are not twice as large, so
    there are at most log2(keys) parts and a key is rewritten as often at most."""

    spark: SparkSession
    root: str

    def _fs(self):
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def changed(self, commit: dict) -> DataFrame:
        """The changed files of a commit."""
        return self.spark.read.parquet(commit["delta"]).where("changed").select("repo", "rel_path")

    def last_commit(self) -> dict | None:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [int(n) for n in names if n.isdigit()]
        if not done:
            return None
        return json.loads(read_small(self.spark, f"{self.root}/commits/{max(done)}"))

    def _write(self, df: DataFrame, path: str) -> tuple[DataFrame, int]:
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        return written, written.count()

    def state(self, commit: dict | None = None) -> DataFrame | None:
        """(repo, rel_path, v) with one row per key and part, or None without a commit."""
        commit = commit or self.last_commit()
        if commit is None:
            return None
        return self.spark.read.parquet(*[part["path"] for part in commit["parts"]]).select("repo", "rel_path", "v")

    def run(self, signatures: DataFrame, parse_cache: DataFrame, upper, fail_before_commit: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
        """Process what came after the watermark up to ``upper``; returns the changed files.

        ``parse_cache`` is the state before the first run and is read by that run only. With
        ``batch``, a stream and the number of its batch, every row is processed and the watermark
        stays: the batch, not ``loaded_at``, says what is new. A stream's last batch given again is
        not processed again; its committed files are returned."""
        last = self.last_commit()
        batches = last.get("batches", {}) if last else {}
        if batch is not None:
            done = batches.get(batch[0])
            if done and done["number"] == batch[1]:
                return self.changed(done)
        n = (last["n"] if last else 0) + 1
        watermark = last["watermark"] if last else None
        rows = _versions(signatures)
        if batch is None:
            rows = rows.where(F.col("loaded_at") <= _limit(upper))
            if watermark is not None:
                rows = rows.where(F.col("loaded_at") > _limit(watermark))
            watermark = str(upper)
        target = f"{self.root}/v={n}-{uuid.uuid4().hex[:8]}"
        new, count = self._write(rows.groupBy("repo", "rel_path").agg(F.max("v").alias("v")), f"{target}/new")
        parts = last["parts"] if last else []
        if not last:
            kind = new.schema["v"].dataType
            entry = F.struct(*[(F.col(f"entry.{f.name}") if f.name in ("len", "mtime_ns") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
            seed, seeded = self._write(_entries(parse_cache).select("repo", "rel_path", entry.alias("v")), f"{target}/seed")
            parts = [{"path": f"{target}/seed", "rows": seeded}]
            old = seed
        else:
            old = self.state(last)
        met = self._met(old, new, count)
        now = F.greatest("v", "was")  # nulls, as an entry's walked_at, come first
        pick = lambda s: F.struct(s["len"].alias("len"), s["mtime_ns"].alias("mtime_ns"))
        before = F.when(F.col("was").isNotNull(), pick(F.col("was")))
        delta = met.select("repo", "rel_path", now.alias("v"), (~pick(now).eqNullSafe(before)).alias("changed"), F.lit(n).alias("n"))
        _, size = self._write(delta, f"{target}/delta")
        if fail_before_commit:
            raise RuntimeError("stopped before the commit")
        parts = self._merged(parts, {"path": f"{target}/delta", "rows": size}, target)
        if batch is not None:
            batches = batches | {batch[0]: {"number": batch[1], "delta": f"{target}/delta"}}
        commit = {"n": n, "watermark": watermark, "delta": f"{target}/delta", "parts": parts, "batches": batches}
        publish(self.spark, f"{self.root}/commits", str(n), json.dumps(commit))
        jvm, fs = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{target}/new"), True)
        return self.changed(commit)

    @staticmethod
    def _met(old: DataFrame, new: DataFrame, count: int) -> DataFrame:
        """``new`` with ``was``, the newest former state of its keys. Few keys (counted) are sent to
        the readers of the state, which then is not shuffled."""
        keys = new.select(F.col("repo").alias("_r"), F.col("rel_path").alias("_p"))
        keys = F.broadcast(keys) if count <= FEW_KEYS else keys
        hit = old.join(keys, old["repo"].eqNullSafe(keys["_r"]) & (old["rel_path"] == keys["_p"]), "left_semi")
        both = new.select("repo", "rel_path", "v", F.lit(None).cast(new.schema["v"].dataType).alias("was")).unionAll(
            hit.select("repo", "rel_path", F.lit(None).cast(new.schema["v"].dataType).alias("v"), F.col("v").alias("was"))
        )
        return both.groupBy("repo", "rel_path").agg(F.max("v").alias("v"), F.max("was").alias("was"))

    def _merged(self, parts: list[dict], delta: dict, target: str) -> list[dict]:
        kept, taken, rows = list(parts), [delta], delta["rows"]
        while kept and kept[-1]["rows"] <= 2 * rows:
            taken.append(kept.pop())
            rows += taken[-1]["rows"]
        if len(taken) == 1:
            return [*kept, delta]
        whole = self.spark.read.parquet(*[p["path"] for p in taken]).groupBy("repo", "rel_path").agg(F.max("v").alias("v"))
        _, size = self._write(whole, f"{target}/merged")
        return [*kept, {"path": f"{target}/merged", "rows": size}]

    def vacuum(self) -> int:
        """Delete the folders that the last commit no longer needs, with those of runs that died;
        returns how many. Not to be called while a run is at work."""
        last = self.last_commit()
        jvm, fs = self._fs()
        if last is None:
            return 0
        used = " ".join([last["delta"], *(p["path"] for p in last["parts"]), *(b["delta"] for b in last["batches"].values())])
        gone = [s.getPath() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root)) if s.getPath().getName().startswith("v=") and s.getPath().getName() not in used]
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)


def replay(signatures: DataFrame, runs: DataFrame, parse_cache: DataFrame, root: str) -> DataFrame:
    """(run_id, repo, rel_path): what every successful run of the log committed.

    Each run of the log is one run of an ``IncrementalStore`` at ``root``, from the watermark to
    its own start; runs without success write their output and die before the commit, so the next
    successful one covers their interval too. The log is laid out by the run that first sees a row,
    so a run reads the rows of its own interval only. Cases as in ``change_feed``."""
    spark = signatures.sparkSession
    log = runs.where(F.col("started_at").isNotNull()).select("run_id", "started_at", "status").distinct().orderBy("started_at", "run_id").collect()  # small by contract
    if not any(r["status"] == "success" for r in log):
        return spark.createDataFrame([], "run_id bigint, repo string, rel_path string")
    kind = signatures.schema["loaded_at"].dataType
    uppers = F.array(*[_limit(r["started_at"]).cast(kind) for r in log])
    columns = ["repo", "rel_path", "len", "mtime_ns", "walked_at", "loaded_at", "sig_id"]
    first = F.size(F.filter(uppers, lambda u: u < F.col("loaded_at")))
    rows = signatures.where(F.col("loaded_at").isNotNull()).select(*columns, first.alias("first")).where(F.col("first") < len(log))
    rows.write.partitionBy("first").parquet(f"{root}/log")
    landed = spark.read.schema(rows.schema).parquet(f"{root}/log")
    store, at, outputs = IncrementalStore(spark, f"{root}/store"), 0, {}
    for k, run in enumerate(log):
        mine = landed.where(F.col("first").between(at, k))
        if run["status"] == "success":
            store.run(mine, parse_cache, run["started_at"])
            commit = store.last_commit()
            outputs[commit["n"]], at = (run["run_id"], commit["delta"]), k + 1
        else:
            try:
                store.run(mine, parse_cache, run["started_at"], fail_before_commit=True)
            except RuntimeError:
                pass
    ids = F.create_map(*[F.lit(x) for n, (run_id, _) in outputs.items() for x in (n, int(run_id))])
    written = spark.read.parquet(*[path for _, path in outputs.values()]).where("changed")
    return written.select(ids[F.col("n")].cast("bigint").alias("run_id"), "repo", "rel_path")
