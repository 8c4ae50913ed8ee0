"""Queries of the catalogue, of structure and of change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import lines
from stratalith.operators import changes, structure, symbols
from stratalith.operators.incremental import normal_path
from stratalith.operators.scale import spread
from stratalith.plans.corpora import CHUNKS, chunks, docs
from stratalith.sources.tables import table
from stratalith.streaming.pipelines import event_windows as windows

GLOBS = ["**/*.rs", "*/*/tests/**"]
EXCLUDES = ["vendor", "third_party"]
FIND = "steel"
OLD, NEW = "2025-07-20 00:00:00", "2025-08-20 00:00:00"


def _paths(spark, d, *more):
    """Paths, with ``more`` columns only where a query needs them."""
    t = table(spark, d, "files")
    return t.select(F.concat_ws("/", "repo", "rel_path").alias("path"), *more).distinct()


def _cache(spark, d):
    t = table(spark, d, "parse_cache")
    return t.select(F.concat_ws("/", "repo", "rel_path").alias("path"), "language", F.col("line_total").alias("total"), F.col("line_blank").alias("blank"), F.col("line_comment").alias("comment"))


def langs_rollup(spark: SparkSession, d: str) -> DataFrame:
    return structure.languages(_cache(spark, d))


def loc_files_rank(spark: SparkSession, d: str) -> DataFrame:
    return structure.loc(_cache(spark, d).where("language IS NOT NULL AND total IS NOT NULL AND blank IS NOT NULL AND comment IS NOT NULL")).select("path", "language", "code", "matches")


def loc_files_range(spark: SparkSession, d: str) -> DataFrame:
    return structure.loc(_cache(spark, d), 10, 40, ["Rust", "PYTHON"], "code-asc", None).select("path", "language", "code")


def files_glob(spark: SparkSession, d: str) -> DataFrame:
    return structure.list_files(_paths(spark, d), GLOBS, EXCLUDES, "path")


def files_group_sample(spark: SparkSession, d: str) -> DataFrame:
    g = structure.file_groups(structure.list_files(_paths(spark, d), path="path"))
    return g.select("root", "files", F.array_join("first", "|").alias("first"), F.array_join("last", "|").alias("last"))


def read_slice(spark: SparkSession, d: str) -> DataFrame:
    return structure.read_lines(docs(spark, d), 2, 4, "content").select("chunk_id", "slice")


def line_stats_plain(spark: SparkSession, d: str) -> DataFrame:
    return structure.plain_line_stats(docs(spark, d).where("content IS NOT NULL"), "content").select("chunk_id", "total", "blank", "comment")


def line_stats_code(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every file by its language, by the scanner."""
    rows = _paths(spark, d, "language", "content").withColumn("language", F.coalesce("language", lines.detect(F.col("path"))))
    return spread(rows).select("path", "language", lines.line_stats("content", "language").alias("s")).select("path", "language", "s.*")


def _parts(spark, d):
    t = table(spark, d, "part")
    return t.select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_type").alias("kind"), F.concat_ws(".", "p_brand", "p_name").alias("qualname"), F.col("p_partkey").alias("start_byte"), (F.col("p_partkey") + 1).alias("end_byte"))


def _find(spark, d):
    s = _parts(spark, d)
    return structure.find(s, s.select("path").distinct(), "1", None, 50, 2)


def find_matches(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d)[0].select("place", "path", "qualname", "more_in_file")


def find_summary(spark: SparkSession, d: str) -> DataFrame:
    return _find(spark, d)[1].select("truncated", "searched", F.array_join("unsampled", "|").alias("unsampled"))


def find_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return structure.round_robin(_paths(spark, d).select("path"))


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("file_path", F.coalesce("language", F.lit("plaintext")).alias("kind"))
    k = structure.kind_counts(rows, "file_path")
    return k.select("file_path", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("kinds"))


def outline_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("chunk_id", F.regexp_replace("file_path", "[/]", ".").alias("qualname")).where("qualname IS NOT NULL")
    return rows.where(structure.depth_filter(4))


def symbol_resolve(spark: SparkSession, d: str) -> DataFrame:
    first = _parts(spark, d).agg(F.min("qualname")).first()[0]
    return symbols.resolve_qualname(_parts(spark, d), first.split(".", 1)[1]).select("path", "qualname")


def symbol_suggest(spark: SparkSession, d: str) -> DataFrame:
    return symbols.suggest(table(spark, d, "postings").where("term IS NOT NULL"), "registri", "term")


def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    return structure.common_prefix(_paths(spark, d).where(F.startswith("path", F.lit("quillmark/"))))


def dirs(spark: SparkSession, d: str) -> DataFrame:
    return structure.dirs(_paths(spark, d))


def resolve_path(spark: SparkSession, d: str) -> DataFrame:
    return structure.resolve_path(_paths(spark, d), "src/lib.rs")


def _snapshot(spark, d, at):
    s = table(spark, d, "signatures").where(F.col("len").isNotNull() & F.col("mtime_ns").isNotNull() & (F.col("loaded_at") <= F.lit(at).cast("timestamp_ntz")))
    s = s.select("repo", normal_path(F.col("rel_path")).alias("rel_path"), F.struct("walked_at", "loaded_at", "sig_id", "len", "mtime_ns").alias("v"))
    return s.groupBy("repo", "rel_path").agg(F.max("v").alias("v")).select("repo", "rel_path", F.col("v.len").alias("len"), F.col("v.mtime_ns").alias("mtime_ns"))


def signature_diff(spark: SparkSession, d: str) -> DataFrame:
    return changes.signature_diff(_snapshot(spark, d, OLD), _snapshot(spark, d, NEW), ["repo", "rel_path"], ["len", "mtime_ns"])


def _entries(spark, d):
    diff = signature_diff(spark, d).select(F.upper(F.substring("change", 1, 1)).alias("s"), F.concat_ws("/", "repo", "rel_path").alias("path"))
    names = diff.select(F.when(F.col("s") == "C", "M").when(F.col("s") == "R", "D").otherwise("A").alias("status"), "path", F.lit(None).cast("string").alias("old_path"))
    counts = _cache(spark, d).select((F.col("total") - F.col("blank")).alias("added"), F.col("comment").alias("removed"), "path")
    marks = _cache(spark, d).select("path", F.lit(None).cast("string").alias("old_path"), "language")
    return changes.overview(names, counts, marks.where("language = 'rust' OR language = 'python'"), marks.where("language <> 'python'"))


def overview_join(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).drop("old_path")


def state_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).withColumn("state", changes.state_bucket(F.col("staged"), F.col("unstaged"), F.col("status")))
    return changes.totals(e, "state")


def folder_totals(spark: SparkSession, d: str) -> DataFrame:
    return changes.totals(_entries(spark, d).withColumn("folder", changes.folder(F.col("path"))), "folder")


def _overlaps(spark, d):
    c = chunks(spark, d).where("file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    hunks = c.select(F.col("file_path").alias("path"), F.col("chunk_id").alias("hunk"), (F.col("start_line") + F.col("chunk_id") % 5).cast("int").alias("new_start"), (F.col("chunk_id") % 7).cast("int").alias("new_len"))
    syms = c.select(F.col("file_path").alias("path"), F.concat(F.lit("s"), F.col("chunk_id").cast("string")).alias("qualname"), "start_line", (F.col("end_line") + F.col("chunk_id") % 11).cast("int").alias("end_line"))
    return changes.hunk_symbols(hunks, syms)


def hunk_symbol_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


def touched_topn(spark: SparkSession, d: str) -> DataFrame:
    return changes.touched(_overlaps(spark, d), 3).select("path", F.array_join("symbols", ",").alias("symbols"), "more")


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of all files by the scanners."""
    f = table(spark, d, "files")
    return symbols.symbols(f.withColumn("language", F.coalesce("language", lines.detect(F.col("rel_path")))))


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all files, cut along their symbols."""
    f = table(spark, d, "files")
    return symbols.chunk_files(f.withColumn("language", F.coalesce("language", lines.detect(F.col("rel_path")))))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windows(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("value", 2).alias("value"))


_FNS = [
    langs_rollup, loc_files_rank, loc_files_range, files_glob, files_group_sample, read_slice, line_stats_plain, line_stats_code, find_matches, find_summary, find_round_robin, kind_counts, outline_depth,
    symbol_resolve, symbol_suggest, common_prefix, dirs, resolve_path, signature_diff, overview_join, state_buckets, folder_totals, hunk_symbol_overlap, touched_topn, extract_symbols, chunk_files, event_windows,
]
QUERIES = {f.__name__: f for f in _FNS}

_F = "(SELECT DISTINCT concat_ws('/', repo, rel_path) AS path FROM files)"
_C = "(SELECT concat_ws('/', repo, rel_path) AS path, language, line_total AS total, line_blank AS blank, line_comment AS comment, line_total - line_blank - line_comment AS code FROM parse_cache)"
_P = "(SELECT concat_ws('/', p_brand, p_type) AS path, p_type AS kind, concat_ws('.', p_brand, p_name) AS qualname, p_partkey AS b FROM part)"
_D = "(SELECT doc_id AS chunk_id, concat_ws('/', repo, doc_path) AS file_path, text AS content FROM documents)"
_TOP = "CASE WHEN contains({0}, '/') THEN split_part({0}, '/', 1) ELSE '' END"
_LINES = r"string_split(regexp_replace(content, '\n$', ''), chr(10))"
_FIND = f"""fl AS (SELECT DISTINCT path FROM {_P}), rr AS (SELECT path, split_part(path, '/', 1) AS bucket, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS turn FROM fl),
h AS (SELECT p.*, bucket, turn, row_number() OVER (PARTITION BY p.path ORDER BY b, qualname) AS n FROM {_P} p JOIN rr USING (path) WHERE contains(lower(qualname), '1')),
e AS (SELECT *, row_number() OVER (ORDER BY turn, bucket, path, b, qualname) AS place FROM h WHERE n <= 2),
cut AS (SELECT turn, bucket, path, b FROM e WHERE place = 50)"""
_PATH = r"regexp_replace(replace(rel_path, '\', '/'), '^\./', '')"


def _snap(at: str) -> str:
    return f"(SELECT repo, {_PATH} AS rel_path, arg_max([len, mtime_ns], (walked_at, loaded_at, sig_id)) AS st FROM signatures WHERE len IS NOT NULL AND mtime_ns IS NOT NULL AND loaded_at <= TIMESTAMP '{at}' GROUP BY ALL)"


_DIFF = f"""SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.rel_path, o.rel_path) AS rel_path, CASE WHEN o.st IS NULL THEN 'added' WHEN n.st IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM {_snap(NEW)} n FULL JOIN {_snap(OLD)} o ON n.repo IS NOT DISTINCT FROM o.repo AND n.rel_path = o.rel_path WHERE n.st IS DISTINCT FROM o.st"""
_OVER = f"""df AS ({_DIFF}), ov AS (SELECT CASE change WHEN 'changed' THEN 'M' WHEN 'removed' THEN 'D' ELSE 'A' END AS status, concat_ws('/', df.repo, df.rel_path) AS path, c.total - c.blank AS added, c.comment AS removed,
  c.path IS NOT NULL AND (c.total - c.blank) IS NULL AS binary, coalesce(c.language IN ('rust', 'python'), false) AS staged, coalesce(c.language <> 'python', false) AS unstaged
  FROM df LEFT JOIN {_C} c ON c.path = concat_ws('/', df.repo, df.rel_path))"""
_HUNKS = f"""c AS (SELECT * FROM {CHUNKS} WHERE file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL),
h AS (SELECT file_path AS path, chunk_id AS hunk, greatest(start_line + chunk_id % 5, 1) AS lo, greatest(start_line + chunk_id % 5, 1) + greatest(chunk_id % 7, 1) - 1 AS hi FROM c),
s AS (SELECT file_path AS path, 's' || chunk_id AS symbol, start_line AS a, end_line + chunk_id % 11 AS z FROM c),
pr AS (SELECT path, hunk, symbol, row_number() OVER (PARTITION BY path, hunk ORDER BY (a <= lo AND z >= hi) DESC, z - a, a, symbol)::INT AS place FROM h JOIN s USING (path) WHERE a <= hi AND z >= lo AND z >= a)"""

ORACLE = {
    "langs_rollup": f"SELECT coalesce(language, 'plaintext') AS language, count(*) AS files, sum(total)::BIGINT AS lines, sum(blank)::BIGINT AS blank, sum(comment)::BIGINT AS comment, sum(code)::BIGINT AS code FROM {_C} GROUP BY 1",
    "loc_files_rank": f"SELECT path, language, code, count(*) OVER () AS matches FROM {_C} WHERE language IS NOT NULL AND code IS NOT NULL ORDER BY code DESC, path LIMIT 50",
    "loc_files_range": f"SELECT path, language, code FROM {_C} WHERE code BETWEEN 10 AND 40 AND lower(language) IN ('rust', 'python')",
    "files_glob": f"SELECT path FROM {_F} WHERE (path LIKE '%.rs' OR regexp_matches(path, '^[^/]*/[^/]*/tests/.*$')) AND NOT contains('/' || path || '/', '/vendor/') AND NOT contains('/' || path || '/', '/third_party/')",
    "files_group_sample": f"""WITH r AS (SELECT path, {_TOP.format('path')} AS root, row_number() OVER (PARTITION BY {_TOP.format('path')} ORDER BY path) AS a, row_number() OVER (PARTITION BY {_TOP.format('path')} ORDER BY path DESC) AS z FROM {_F})
SELECT root, count(*) AS files, string_agg(path, '|' ORDER BY path) FILTER (a <= 3) AS first, string_agg(path, '|' ORDER BY path) FILTER (z <= 3) AS last FROM r GROUP BY root""",
    "read_slice": f"SELECT chunk_id, array_to_string(list_slice({_LINES}, 2, 4), chr(10)) AS slice FROM {_D} WHERE len({_LINES}) >= 2",
    "line_stats_plain": rf"SELECT chunk_id, (CASE WHEN content = '' THEN 0 ELSE len({_LINES}) END)::INT AS total, (CASE WHEN content = '' THEN 0 ELSE len(list_filter({_LINES}, lambda x: length(regexp_replace(x, '\s+', '', 'g')) = 0)) END)::INT AS blank, 0 AS comment FROM {_D} WHERE content IS NOT NULL",
    "find_matches": f"WITH {_FIND} SELECT place, path, qualname, coalesce((SELECT count(*) FROM h WHERE h.path = e.path AND h.n > 2 AND (NOT EXISTS (FROM cut) OR (h.turn, h.bucket) < (SELECT (turn, bucket) FROM cut))), 0) AS more_in_file FROM e WHERE place <= 50",
    "find_summary": f"""WITH {_FIND} SELECT count(*) < (SELECT count(*) FROM rr) OR EXISTS (SELECT 1 FROM {_P} p, cut WHERE p.path = cut.path AND p.b > cut.b) AS truncated, count(*) AS searched,
coalesce((SELECT string_agg(bucket, '|' ORDER BY bucket) FROM (SELECT DISTINCT bucket FROM rr WHERE bucket NOT IN (SELECT rr.bucket FROM rr, cut WHERE (rr.turn, rr.bucket) <= (cut.turn, cut.bucket)))), '') AS unsampled
FROM rr, cut WHERE (rr.turn, rr.bucket) <= (cut.turn, cut.bucket)""",
    "find_round_robin": f"SELECT path, row_number() OVER (PARTITION BY {_TOP.format('path')} ORDER BY path)::INT AS turn, {_TOP.format('path')} AS bucket FROM {_F}",
    "kind_counts": f"SELECT file_path, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT file_path, coalesce(language, 'plaintext') AS kind, count(*) AS n FROM {CHUNKS} GROUP BY ALL) GROUP BY file_path",
    "outline_depth": f"SELECT chunk_id, replace(file_path, '/', '.') AS qualname FROM {_D} WHERE file_path IS NOT NULL AND len(string_split(replace(file_path, '/', '.'), '.')) <= 4",
    "symbol_resolve": f"WITH q AS (SELECT split_part(min(qualname), '.', 1) AS lead, substr(min(qualname), length(split_part(min(qualname), '.', 1)) + 2) AS leaf FROM {_P}) SELECT path, qualname FROM {_P}, q WHERE qualname = leaf OR ends_with(qualname, '.' || leaf)",
    "symbol_suggest": """WITH t AS (SELECT DISTINCT term AS name, contains(lower(term), 'registri') AS i, levenshtein(lower(term), 'registri') AS d FROM postings WHERE term IS NOT NULL)
SELECT row_number() OVER (ORDER BY CASE WHEN m THEN 0 ELSE d END, CASE WHEN m THEN 0 ELSE -(1 - d / greatest(length(name), 8, 1)) END, name)::INT AS rank, name FROM (SELECT *, max(i) OVER () AS m FROM t) WHERE i OR NOT m ORDER BY rank LIMIT 5""",
    "common_prefix": f"""WITH p AS (SELECT min(path) AS a, max(path) AS z FROM {_F} WHERE starts_with(path, 'quillmark/')), n AS (SELECT a, coalesce(max(i), 0) AS k FROM p, range(1, 300) r(i) WHERE i <= length(a) AND substr(a, 1, i) = substr(z, 1, i) GROUP BY a)
SELECT regexp_extract(substr(a, 1, k), '^(.*/)', 1) AS prefix FROM n""",
    "dirs": f"SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS dir FROM {_F}, range(1, 40) r(i) WHERE i < len(string_split(path, '/'))",
    "resolve_path": f"SELECT path FROM {_F} WHERE path = 'src/lib.rs' OR (ends_with(path, '/src/lib.rs') AND NOT EXISTS (SELECT 1 FROM {_F} WHERE path = 'src/lib.rs'))",
    "signature_diff": _DIFF,
    "overview_join": f"WITH {_OVER} SELECT * FROM ov",
    "state_buckets": f"WITH {_OVER} SELECT CASE WHEN staged AND unstaged THEN 'staged+unstaged' WHEN staged THEN 'staged' WHEN unstaged THEN 'unstaged' ELSE 'other' END AS state, count(*) AS files, sum(coalesce(added, 0))::BIGINT AS added, sum(coalesce(removed, 0))::BIGINT AS removed FROM ov GROUP BY 1",
    "folder_totals": f"WITH {_OVER} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' ELSE './' END AS folder, count(*) AS files, sum(coalesce(added, 0))::BIGINT AS added, sum(coalesce(removed, 0))::BIGINT AS removed FROM ov GROUP BY 1",
    "hunk_symbol_overlap": f"WITH {_HUNKS} SELECT path, hunk, symbol, place FROM pr",
    "touched_topn": f"WITH {_HUNKS}, u AS (SELECT path, symbol, row_number() OVER (PARTITION BY path ORDER BY symbol) AS n, count(*) OVER (PARTITION BY path) AS t FROM (SELECT DISTINCT path, symbol FROM pr)) SELECT path, string_agg(symbol, ',' ORDER BY symbol) AS symbols, any_value(t) - count(*) AS more FROM u WHERE n <= 3 GROUP BY path",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(round(sum(value), 4), 2) AS value FROM events GROUP BY 1, 2",
}
