"""One object for every command over a source tree or a table of files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import intent as intents
from stratalith.functions import lines, paths
from stratalith.operators import bm25, changes, dense, framework, fusion, structure, symbols
from stratalith.operators.index import Index
from stratalith.operators.scale import materialise, rank_in_groups
from stratalith.session import ship
from stratalith.sources import repo as trees

MODES = ("hybrid", "bm25", "semantic")
MAX_BYTES = 1 << 20
MAX_ANSWER = 256 << 10


class Engine:
    """Commands over ``files`` (repo, rel_path, language, length, mtime_ns, content).

    Tables derive lazily; with an ``Index`` search reads the stored one, after ``ensure``."""

    def __init__(self, spark: SparkSession, files: DataFrame, root: str | None = None, index: Index | None = None):
        self.spark, self.root, self.index, self._checked = ship(spark), root, index, False
        self.raw = files.dropDuplicates(["repo", "rel_path"]).withColumn("language", F.coalesce("language", lines.detect(F.col("rel_path"))))

    @classmethod
    def open(cls, spark: SparkSession, root: str, index: Index | None = None) -> Engine:
        return cls(spark, trees.files(spark, root), root, index)

    # ---- derived tables -----------------------------------------------
    @cached_property
    def texts(self) -> DataFrame:
        """(path, language, text): readable files only."""
        text, problem = trees.guarded_text(F.col("content"))
        rows = self.raw.select(F.col("rel_path").alias("path"), "language", text.alias("text"), problem.alias("problem"), "content")
        return rows.where(F.col("problem").isNull()).drop("problem")

    @cached_property
    def symbols(self) -> DataFrame:
        if self.index is not None:
            self._ready()
            return self.index.table("symbols").withColumnRenamed("rel_path", "path")
        return materialise(symbols.symbols(self.raw).withColumnRenamed("rel_path", "path"))

    @cached_property
    def chunks(self) -> DataFrame:
        if self.index is not None:
            self._ready()
            return self.index.table("chunks")
        order = [F.col("repo").asc_nulls_first(), F.col("file_path").asc(), F.col("start_line").asc(), F.col("end_line").asc(), F.col("content").asc()]
        # written once: ranking, selection and display all read them
        return materialise(rank_in_groups(symbols.chunk_files(self.raw).withColumn("_g", F.lit(0)), ["_g"], order, "chunk_id").drop("_g"))

    @cached_property
    def stats(self) -> DataFrame:
        """(path, language, total, blank, comment) of readable files."""
        s = lines.line_stats(F.col("content"), F.col("language")).alias("s")
        return self.texts.select("path", "language", s).select("path", "language", "s.*")

    def _ready(self) -> None:
        """The index brought up to date, once per engine."""
        if not self._checked:
            self.index.ensure(self.raw)
            self._checked = True

    @cached_property
    def _lexical(self) -> tuple[DataFrame, DataFrame]:
        if self.index is not None:
            self._ready()
            return self.index.table("postings"), self.index.table("lengths")
        postings = materialise(bm25.build_index(self.chunks)[0])
        return postings, postings.groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("dl"))

    @cached_property
    def _vectors(self) -> DataFrame:
        if self.index is not None:
            self._ready()
            return self.index.table("vectors")
        return materialise(dense.hash_vectors(self.chunks, "chunk_id", F.col("content")))

    def _one(self, wanted: str) -> str:
        found = [r["path"] for r in structure.resolve_path(self.raw.select(F.col("rel_path").alias("path")), wanted).orderBy("path").limit(51).collect()]
        if not found:
            raise ValueError(f"no file {wanted!r}")
        if len(found) > 1:
            raise ValueError(f"{wanted!r} is ambiguous: " + ", ".join(found[:10]) + (f" and {len(found) - 10} more" if len(found) > 10 else ""))
        return found[0]

    def _guarded(self, path: str) -> DataFrame:
        text, problem = trees.guarded_text(F.col("content"))
        row = self.raw.where(F.col("rel_path") == path).select(problem.alias("p")).first()
        if row["p"]:
            raise ValueError(f"{path} is {row['p']}")
        return self.raw.where(F.col("rel_path") == path).select(F.col("rel_path").alias("path"), "language", text.alias("text"), "content")

    # ---- commands -----------------------------------------------------
    def files(self, globs: Sequence[str] = (), exclude: Sequence[str] = (), limit: int = 2000) -> dict:
        listed = structure.list_files(self.raw.select(F.col("rel_path").alias("path")), globs, exclude, "path")
        total = listed.count()
        out = {"files": listed.limit(limit), "total": total, "truncated": total > limit}
        return out | ({"groups": structure.file_groups(listed)} if total > limit else {})

    def langs(self) -> DataFrame:
        return structure.languages(self.stats)

    def loc_files(self, globs: Sequence[str] = (), exclude: Sequence[str] = (), **options) -> DataFrame:
        rows = self.stats.where(F.col("language").isNotNull() & paths.include(F.col("path"), list(globs)) & paths.exclude(F.col("path"), list(exclude)))
        return structure.loc(rows, **options)

    def loc_symbols(self, prefixes: Sequence[str] = (), kinds: Sequence[str] = ("callable",), exclude: Sequence[str] = (), **options) -> DataFrame:
        """Code lines of symbols, counted over each symbol's own bytes."""
        rows = self.symbols.where(structure.kinds_filter(kinds) & paths.exclude(F.col("path"), list(exclude)))
        if prefixes:
            rows = rows.where(paths.under(F.col("path"), [paths.valid_relative(p) for p in prefixes]))
        body = self.texts.select("path", "content")
        part = F.substring(F.col("content"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
        counted = rows.join(body, "path").withColumn("s", lines.line_stats(part, F.col("language"))).select("path", "language", "kind", "qualname", "start_line", "end_line", "s.*")
        return structure.loc(counted, ties=("path", "start_line", "qualname"), **options)

    def outline(self, path: str, kinds: Sequence[str] = (), depth: int | None = None) -> dict:
        path = self._one(path)
        self._guarded(path)
        mine = self.symbols.where(F.col("path") == path)
        return {"path": path, "symbols": structure.outline(mine, kinds, depth), "kinds": structure.kind_counts(mine)}

    def symbol(self, path: str, qualname: str) -> dict:
        """A symbol's text; the name may be the end of the qualified one."""
        path = self._one(path)
        mine = self.symbols.where(F.col("path") == path)
        hits = symbols.resolve_qualname(mine, qualname).orderBy("start_byte").limit(11).collect()
        if not hits:
            near = [r["name"] for r in symbols.suggest(mine, qualname).orderBy("rank").collect()]
            raise ValueError(f"no symbol {qualname!r} in {path}" + (f"; did you mean {', '.join(near)}" if near else ""))
        if len(hits) > 1:
            raise ValueError(f"{qualname!r} is ambiguous: " + ", ".join(h["qualname"] for h in hits[:10]))
        h = hits[0]
        if h["end_byte"] - h["start_byte"] > MAX_ANSWER:
            raise ValueError(f"{qualname} is larger than {MAX_ANSWER} bytes")
        raw = self._guarded(path).first()["content"]
        return h.asDict() | {"text": bytes(raw[h["start_byte"] : h["end_byte"]]).decode("utf-8", "replace")}

    def read(self, path: str, first: int = 1, last: int = 2**31 - 1) -> str:
        path = self._one(path)
        row = structure.read_lines(self._guarded(path), first, last).first()
        if row is None:
            raise ValueError(f"{path} has no line {first}")
        if len(row["slice"].encode()) > MAX_ANSWER:
            raise ValueError(f"the answer is larger than {MAX_ANSWER} bytes; ask for fewer lines")
        return row["slice"]

    def read_summary(self, path: str) -> dict:
        path = self._one(path)
        self._guarded(path)
        stats = self.stats.where(F.col("path") == path).first()
        return {"path": path, "stats": stats.asDict(), "kinds": structure.kind_counts(self.symbols.where(F.col("path") == path))}

    def find(self, query: str, prefixes: Sequence[str] = (), kinds: Sequence[str] = (), limit: int = 50, per_file: int = 5, exclude: Sequence[str] = ()) -> dict:
        keep = paths.exclude(F.col("path"), list(exclude))
        if prefixes:
            keep = keep & paths.under(F.col("path"), [paths.valid_relative(p) for p in prefixes])
        found = self.symbols.where(keep)
        matches, summary = structure.find(found, self.raw.select(F.col("rel_path").alias("path")).where(keep), query, kinds, limit, per_file)
        out = {"matches": matches, "summary": summary}
        if kinds and matches.isEmpty():
            of = found.where(structure.contains_text(F.col("qualname"), query)).agg(F.array_sort(F.collect_set("kind")).alias("k")).first()
            out["available_kinds"] = of["k"]
        return out

    def search(
        self, query: str, prefixes: Sequence[str] | None = None, k: int = 10, mode: str = "hybrid", languages: Sequence[str] | None = None,
        exclude: Sequence[str] | None = None, alpha: float | None = None,
    ) -> DataFrame:
        """(rank, chunk_id, score, file_path, start_line, end_line, language, snippet, source)."""
        if not query.strip():
            raise ValueError("the query is empty")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if k < 1:
            raise ValueError("k must be at least 1")
        c = self.chunks
        selection = bm25.select_chunks(c, languages, prefixes, exclude)
        wide = fusion.WIDTH * k
        if mode == "bm25":
            ranked = bm25.top_k(bm25.scores(*self._lexical, query, selection), k)
        elif mode == "semantic":
            ranked = bm25.top_k(dense.semantic_scores(self._vectors, query, selection=selection), k)
        else:
            lexical = bm25.top_k(bm25.scores(*self._lexical, query, selection), wide, 9)
            semantic = bm25.top_k(dense.semantic_scores(self._vectors, query, selection=selection), wide, 9)
            ranked = fusion.hybrid(semantic, lexical, c, query, k, alpha, selection)
        return self._show(ranked, mode)

    def _show(self, ranked: DataFrame, mode: str) -> DataFrame:
        """Contents join the few ranked rows last."""
        shown = F.broadcast(ranked).join(self.chunks, "chunk_id")
        return shown.select("rank", "chunk_id", "score", "file_path", "start_line", "end_line", "language", structure.snippet(F.col("content")).alias("snippet"), F.lit(mode).alias("source")).orderBy("rank")

    def find_related(self, path: str, line: int, k: int = 10) -> DataFrame:
        """Chunks like the one that holds ``line``, without itself."""
        source = dense.chunk_at(self.chunks, self._one(path), line).first()
        if source is None:
            raise ValueError(f"{path} has no chunks")
        scored = dense.semantic_scores(self._vectors, source["content"]).where(F.col("chunk_id") != source["chunk_id"])
        return self._show(bm25.top_k(scored, k), "semantic")

    def weight(self, query: str) -> float:
        return intents.semantic_weight(query)

    # ---- changes ------------------------------------------------------
    def diff(self, scope: str = "all", against: str = "HEAD", exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
        """overview, hunks, pairs (hunk x symbol), touched symbols and totals of the working tree."""
        if self.root is None:
            raise ValueError("a diff needs a source tree")
        got = trees.change_set(self.spark, self.root, scope, against)
        staged = trees.change_set(self.spark, self.root, "staged", against)["name_status"]
        unstaged = trees.change_set(self.spark, self.root, "unstaged")["name_status"]
        keep = paths.exclude(F.col("path"), list(exclude))
        fresh = got["untracked"].join(self.texts.select("path", "text"), "path").where(keep & F.lit(scope != "staged"))
        new_hunks = changes.untracked_hunks(fresh)
        known = changes.overview(got["name_status"], got["numstat"], staged, unstaged).where(keep)
        untracked = new_hunks.select(F.lit("?").alias("status"), "path", F.lit(None).cast("string").alias("old_path"), "added", "removed", F.lit(False).alias("binary"), F.lit(False).alias("staged"), F.lit(False).alias("unstaged"))
        overview = known.unionByName(untracked)
        hunks = got["hunks"].where(keep)
        pairs = changes.hunk_symbols(hunks, self.symbols)
        state = changes.state_bucket(F.col("staged"), F.col("unstaged"), F.col("status"))
        return {
            "overview": overview.orderBy("path"), "hunks": hunks, "untracked": new_hunks, "pairs": pairs, "touched": changes.touched(pairs), "states": changes.totals(overview.withColumn("state", state), "state"),
            "folders": changes.totals(overview.withColumn("folder", changes.folder(F.col("path"))), "folder"),
        }

    def diff_names(self, scope: str = "all", against: str = "HEAD", exclude: Sequence[str] = ()) -> DataFrame:
        """Only the paths of the changes."""
        return self.diff(scope, against, exclude)["overview"].select("path").orderBy("path")

    def diff_summary(self, scope: str = "all", against: str = "HEAD", exclude: Sequence[str] = ()) -> dict:
        """Files and lines in all, per state and per folder, and the folder all changes lie in."""
        d = self.diff(scope, against, exclude)
        return {"total": changes.totals(d["overview"]).first().asDict(), "states": d["states"], "folders": d["folders"], "common": structure.common_prefix(d["overview"]).first()[0]}

    def diff_file(
        self, path: str, scope: str = "all", against: str = "HEAD", symbol: str | None = None, body: str = "full",
    ) -> dict:
        """One changed file (or all below a folder): its entry and its hunks with their symbols.

        Symbols of a deleted file come from ``against``, of others from the working tree. With
        ``symbol`` only the hunks that overlap it are kept. ``note`` says where bodies were dropped
        because a file's exceed MAX_BYTES."""
        d = self.diff(scope, against)
        paths_ = [r["path"] for r in changes.resolve_change(d["overview"], paths.valid_relative(path)).orderBy("path").limit(51).collect()]
        if not paths_:
            raise ValueError(f"no change of {path!r}")
        below = all(p.startswith(path.strip("/") + "/") for p in paths_)
        if len(paths_) > 1 and not below:
            raise ValueError(f"{path!r} is ambiguous: " + ", ".join(paths_[:10]) + (f" and {len(paths_) - 10} more" if len(paths_) > 10 else ""))
        base = path.strip("/") + "/"
        mine = F.startswith("path", F.lit(base)) if below else F.col("path") == paths_[0]
        entries = d["overview"].where(mine)
        gone = [r["path"] for r in entries.where("status = 'D'").collect()]  # of one file, or below one folder of a working tree
        syms = self.symbols.where(mine)
        if gone:
            old = trees.blobs(self.spark, self.root, against, gone)
            syms = syms.unionByName(symbols.symbols(old).withColumnRenamed("rel_path", "path"))
        fresh = d["untracked"].where(mine)
        hunks = d["hunks"].where(mine)
        hunks = hunks.unionByName(fresh.select(*fresh.columns, F.lit(None).cast("string").alias("old_path")))
        within = None
        if symbol is not None:
            within = symbols.resolve_qualname(syms, symbol)
            if within.isEmpty():
                near = [r["name"] for r in symbols.suggest(syms, symbol).orderBy("rank").collect()]
                raise ValueError(f"no symbol {symbol!r} in {path}" + (f"; did you mean {', '.join(near)}" if near else ""))
        shown = changes.drilldown(hunks, syms, body, within, MAX_BYTES).orderBy("path", "hunk")
        large = [r["path"] for r in shown.where(F.col("body_bytes") > MAX_BYTES).select("path").distinct().orderBy("path").limit(10).collect()]
        return {"entries": entries, "hunks": shown, "note": f"bodies above {MAX_BYTES} bytes are left out: {', '.join(large)}" if large else None}

    # ---- caches -------------------------------------------------------
    def index_status(self) -> DataFrame:
        """(name, folders, rows) of the stored index; no rows without one."""
        meta = self.index.status() if self.index else None
        rows = [(n, len(f), self.index.table(n).count()) for n, f in meta["tables"].items()] if meta else []
        return self.spark.createDataFrame(rows, "name string, folders int, rows bigint")

    def index_build(self) -> str:
        return self.index.ensure(self.raw)

    def index_clean(self) -> bool:
        return self.index.clean()

    # ---- framework ----------------------------------------------------
    def _paths(self) -> DataFrame:
        return self.raw.select(F.col("rel_path").alias("path"))

    def next_info(self, root: str = "") -> DataFrame:
        return framework.detect(self.texts, root)

    def next_routes(self, root: str = "") -> DataFrame:
        """Routes with the verbs that API files export."""
        found = framework.routes(self._paths(), root)
        verbs = self.texts.select(F.col("path").alias("file"), framework.methods(F.col("text")).alias("verbs"))
        with_verbs = found.join(verbs, "file", "left")
        return with_verbs.withColumn("methods", F.when((F.col("kind") == "api") & (F.col("router") == "app"), F.col("verbs"))).drop("verbs").orderBy("pattern", "file")

    def next_layouts(self, root: str = "") -> DataFrame:
        return framework.layouts(self._paths(), root)

    def next_server_actions(self) -> DataFrame:
        return framework.server_actions(self.texts)
