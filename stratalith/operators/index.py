"""Materialised index: build, validate, reuse, update only what changed, inspect, drop.

Every table (chunks, symbols, postings, lengths, vectors, signatures) lies in BUCKETS folders by the
hash of the file, postings sorted by term within. A version is a small record that names the folder
of each bucket; renaming ``<n>.tmp`` to ``<n>`` below ``current`` publishes it. Readers use the
greatest published number, so a failed build leaves the old version in place. An update writes the
buckets of changed files, parses and tokenises these files only, and names the old folders of all
other buckets. Vectors are told apart by their encoder: another one rebuilds vectors alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.operators import bm25, symbols
from stratalith.operators.encoders import Encoder, HashingEncoder
from stratalith.operators.scale import publish, read_small

SCHEMA_VERSION = 2
MAX_BYTES = 1 << 20
BUCKETS = 32
TABLES = {
    "chunks": "chunk_id bigint, repo string, file_path string, language string, start_line int, end_line int, content string",
    "symbols": "repo string, rel_path string, language string, kind string, name string, qualname string, start_byte int, end_byte int, start_line int, end_line int",
    "postings": "term string, chunk_id bigint, tf int", "lengths": "chunk_id bigint, dl int", "vectors": "chunk_id bigint, idx int, value double",
    "signatures": "repo string, rel_path string, len bigint, mtime_ns bigint",
}
SORTED = {"postings": ["term", "chunk_id"], "vectors": ["idx", "chunk_id"], "symbols": ["repo", "rel_path", "start_byte"]}


def _bucket(repo: str, path: str):
    return F.pmod(F.xxhash64(repo, path), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    spark: SparkSession
    root: str
    dim: int = 256
    encoder: Encoder | None = field(default=None)

    def __post_init__(self):
        self.encoder = self.encoder or HashingEncoder(self.dim)

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def status(self) -> dict | None:
        """Metadata of the current version, or None without one of this schema."""
        path, fs = self._fs()
        if not fs.exists(path(f"{self.root}/current")):
            return None
        done = [int(s.getPath().getName()) for s in fs.listStatus(path(f"{self.root}/current")) if s.getPath().getName().isdigit()]
        if not done:
            return None
        meta = json.loads(read_small(self.spark, f"{self.root}/current/{max(done)}"))
        return meta if meta["schema"] == SCHEMA_VERSION else None

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        meta = self.status()
        if meta is None:
            raise ValueError("there is no index")
        folders = [f for b, f in meta["tables"][name].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*folders)

    def clean(self) -> bool:
        path, fs = self._fs()
        return fs.delete(path(self.root), True)

    @staticmethod
    def signatures(files: DataFrame) -> DataFrame:
        return files.select("repo", "rel_path", F.col("length").alias("len"), "mtime_ns").distinct()

    def changed(self, files: DataFrame) -> DataFrame:
        """(repo, rel_path, change) against the current version."""
        from stratalith.operators.changes import signature_diff

        return signature_diff(self.table("signatures"), self.signatures(files), ["repo", "rel_path"], ["len", "mtime_ns"])

    def ensure(self, files: DataFrame) -> str:
        """``reused`` when no signature differs, ``updated`` when some do, ``vectors`` when only the
        encoder does, ``built`` without an index. ``files``: repo, rel_path, language, length,
        mtime_ns, content."""
        files = files.where(F.col("length") <= MAX_BYTES)
        meta = self.status()
        if meta is None:
            self._write({"tables": {}, "n": 0}, files, None, None)
            return "built"
        same = meta["encoder"] == self.encoder.fingerprint()
        diff = self.changed(files).select("repo", "rel_path").persist()
        if diff.isEmpty() and same:
            return "reused"
        if not same:
            # vectors first, of the chunks as they are stored; changed files follow as an update
            self._vectors(meta)
            meta = self.status()
            if diff.isEmpty():
                return "vectors"
        touched = sorted(r["b"] for r in diff.select(_bucket("repo", "rel_path").alias("b")).distinct().collect())  # at most BUCKETS
        on = lambda a, p: a["repo"].eqNullSafe(diff["repo"]) & (a[p] == diff["rel_path"])
        fresh = files.join(diff, on(files, "rel_path"), "left_semi")
        chunks, parsed = self.table("chunks", touched), self.table("symbols", touched)
        kept = {"chunks": chunks.join(diff, on(chunks, "file_path"), "left_anti"), "symbols": parsed.join(diff, on(parsed, "rel_path"), "left_anti")}
        ids = kept["chunks"].select("chunk_id", "repo", "file_path")
        for name in ("postings", "vectors"):
            kept[name] = self.table(name, touched).join(ids, "chunk_id")
        self._write(meta, fresh, kept, (touched, files.where(_bucket("repo", "rel_path").isin(touched))))
        diff.unpersist()
        return "updated"

    def _write(self, last: dict, files: DataFrame, kept: dict | None, part: tuple | None) -> None:
        """Publish the tables of ``files`` united with what is ``kept`` in the touched buckets."""
        data = f"{self.root}/v={last['n'] + 1}-{uuid.uuid4().hex[:8]}"
        and_kept = lambda df, name: df if kept is None else df.unionByName(kept[name].select(*df.columns))
        # ids stay with a chunk as long as its file, place and text do
        made = symbols.chunk_files(files).withColumn("chunk_id", F.xxhash64("repo", "file_path", "start_line", "end_line", "content"))
        made.write.parquet(f"{data}/fresh")
        made = self.spark.read.schema(TABLES["chunks"]).parquet(f"{data}/fresh")
        keys = made.select("chunk_id", "repo", "file_path")
        self._store(and_kept(made, "chunks"), data, "chunks")
        self._store(and_kept(symbols.symbols(files), "symbols"), data, "symbols", "rel_path")
        postings, _ = bm25.build_index(made.withColumn("file_path", F.concat_ws("/", "repo", "file_path")))
        self._store(and_kept(postings.join(keys, "chunk_id"), "postings"), data, "postings")
        self._store(and_kept(self.encoder.encode(made, "chunk_id", F.col("content")).join(keys, "chunk_id"), "vectors"), data, "vectors")
        stored = self._folders(data, "chunks")
        home = self.spark.read.schema(TABLES["chunks"]).parquet(*stored.values()).select("chunk_id", "repo", "file_path") if stored else keys
        sums = self._folders(data, "postings")
        lengths = (self.spark.read.schema(TABLES["postings"]).parquet(*sums.values()) if sums else postings).groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("dl"))
        self._store(lengths.join(home, "chunk_id"), data, "lengths")
        self._store(self.signatures(files if part is None else part[1]), data, "signatures", "rel_path")
        path, fs = self._fs()
        fs.delete(path(f"{data}/fresh"), True)
        tables = {}
        for name in TABLES:
            old = {b: f for b, f in last["tables"].get(name, {}).items() if part is not None and int(b) not in part[0]}
            tables[name] = old | self._folders(data, name)
        self._publish(last["n"] + 1, tables)

    def _vectors(self, last: dict) -> None:
        data = f"{self.root}/v={last['n'] + 1}-{uuid.uuid4().hex[:8]}"
        stored = self.table("chunks")
        coded = self.encoder.encode(stored, "chunk_id", F.col("content")).join(stored.select("chunk_id", "repo", "file_path"), "chunk_id")
        self._store(coded, data, "vectors")
        self._publish(last["n"] + 1, last["tables"] | {"vectors": self._folders(data, "vectors")})

    def _store(self, df: DataFrame, data: str, name: str, path: str = "file_path") -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = df.select(*columns, _bucket("repo", path).alias("bucket"))
        rows = rows.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in TABLES[name].split(", "))], "bucket").repartition("bucket")
        # sorted, so that a query's terms prune row groups
        rows.sortWithinPartitions("bucket", *SORTED.get(name, columns[:1])).write.partitionBy("bucket").parquet(f"{data}/{name}")

    def _folders(self, data: str, name: str) -> dict[str, str]:
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{data}/{name}"))]
        return {n.removeprefix("bucket="): f"{data}/{name}/{n}" for n in names if n.startswith("bucket=")}

    def _publish(self, n: int, tables: dict) -> None:
        meta = {"n": n, "schema": SCHEMA_VERSION, "encoder": self.encoder.fingerprint(), "tables": tables}
        publish(self.spark, f"{self.root}/current", str(n), json.dumps(meta))

    def vacuum(self) -> int:
        """Delete version folders that the current version no longer names; returns how many. Not to
        be called while a build is at work."""
        meta = self.status()
        if meta is None:
            return 0
        path, fs = self._fs()
        used = {f.split("/v=")[1].split("/")[0] for t in meta["tables"].values() for f in t.values()}
        gone = [s.getPath() for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("v=") and s.getPath().getName()[2:] not in used]
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)


def cache_languages(cache: DataFrame) -> DataFrame:
    """(language, entries, parsed) of the parse cache; entries without a language count as null."""
    return cache.groupBy("language").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("parsed_for_symbols")).alias("parsed"))


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """Cached rows not in ``fresh``, and ``fresh``; with ``seen`` (after a full walk) rows of files
    that no longer exist drop out."""
    kept = cache.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
    return kept if seen is None else kept.join(seen.select(*keys).distinct(), keys, "left_semi")


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) has no entry in the cache and that must be parsed again."""
    entry = cache.select(
        F.col("repo").alias("_r"), F.col("rel_path").alias("_p"), F.col("size").alias("_s"), (F.col("mtime_secs") * F.lit(10**9) + F.col("mtime_nanos")).alias("_m")
    ).distinct()
    cond = files["repo"].eqNullSafe(entry["_r"]) & (files["rel_path"] == entry["_p"]) & (files["length"] == entry["_s"]) & (files["mtime_ns"] == entry["_m"])
    return files.join(entry, cond, "left_anti")
