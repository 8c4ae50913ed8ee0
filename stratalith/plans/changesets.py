"""Queries of change sets: git's texts written from the file table and parsed again, drilldowns,
rebased overviews, the parse cache, and symbols of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import lines, paths
from stratalith.operators import bm25, changes, dense, index, structure, symbols
from stratalith.plans.corpora import CHUNKS, chunks, docs
from stratalith.plans.retrieval import _hash, _top
from stratalith.plans.structure import _OVER, _entries
from stratalith.sources.repo import guarded_text
from stratalith.sources.tables import table

FOLDER = "parserio"


def _files(spark, d):
    t = table(spark, d, "files").where("rel_path IS NOT NULL").select("file_id", "repo", "rel_path", F.coalesce("length", F.lit(0)).alias("n"))
    return t.distinct()


def _old(kind):
    return F.when(kind, F.concat(F.lit("old/"), F.col("rel_path")))


def name_status_parse(spark: SparkSession, d: str) -> DataFrame:
    """One text of two records per file, as git would write it, parsed again."""
    k = F.col("n") % 5
    code = F.when(k == 3, F.concat(F.lit("R0"), F.lpad((50 + F.col("n") % 50).cast("string"), 2, "0"))).when(k == 4, F.lit("C100")).otherwise(F.element_at(F.array(*map(F.lit, "AMD")), (k + 1).cast("int")))
    first = F.when(k >= 3, F.concat_ws("\0", code, F.concat(F.lit("old/"), "rel_path"), "rel_path")).otherwise(F.concat_ws("\0", code, "rel_path"))
    text = F.concat(first, F.lit("\0T\0"), F.col("rel_path"), F.lit(".twin\0"))
    return changes.parsed(_files(spark, d).select("repo", text.alias("text")), "name_status")


def numstat_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    counts = F.when(n % 7 == 0, F.lit("-\t-\t")).otherwise(F.format_string("%d\t%d\t", n % 97, n % 13))
    text = F.when(n % 5 == 3, F.concat(counts, F.lit("\0old/"), "rel_path", F.lit("\0"), "rel_path", F.lit("\0"))).otherwise(F.concat(counts, "rel_path", F.lit("\0")))
    return changes.parsed(_files(spark, d).select("repo", text.alias("text")), "numstat")


def _unified(spark, d):
    n, p = F.col("n"), F.col("rel_path")
    moved = F.when(n % 5 == 3, F.concat(F.lit("rename from old/"), p, F.lit("\nrename to "), p, F.lit("\n"))).otherwise("")
    old = F.when(n % 5 == 3, F.concat(F.lit("old/"), p)).otherwise(p)
    at, more = (n % 50 + 1).cast("int"), (n % 4 + 1).cast("int")
    one = F.format_string("@@ -%d,2 +%d,3 @@ fn\n-x\n+y%d\n+--- z\n c\n", at, at, at)
    two = F.concat(F.format_string("@@ -%d +%d,%d @@\n-q\n", at + 60, at + 61, more), F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: F.concat(F.lit("+@@ r"), i.cast("string"))), "\n"), F.lit("\n\\ No newline at end of file\n"))
    text = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), p, F.lit("\n"), moved, F.lit("--- a/"), old, F.lit("\n+++ b/"), p, F.lit("\n"), one, two)
    return changes.parsed(_files(spark, d).select(F.concat_ws("/", "repo", "file_id").alias("repo"), text.alias("text")), "hunks")


def unified_parse(spark: SparkSession, d: str) -> DataFrame:
    """A unified diff per file; the repository column names the file too, so paths may repeat."""
    return _unified(spark, d)


def _drill(spark, d, **options):
    hunks = _unified(spark, d).withColumn("path", F.concat_ws("/", "repo", "path"))
    f = _files(spark, d).withColumn("path", F.concat_ws("/", "repo", "file_id", "rel_path"))
    spans = [("A", 1, 200, "class"), ("A.f", 1, 30, "method"), ("A.g", 31, 60, "method"), ("B", 100, 115, "function")]
    syms = f.select("path", F.explode(F.array(*[F.struct(F.lit(q).alias("qualname"), F.lit(a).alias("start_line"), F.lit(z).alias("end_line"), F.lit(k).alias("kind")) for q, a, z, k in spans])).alias("s")).select("path", "s.*")
    within = syms.where("qualname = 'B'") if options.pop("only_b", False) else None
    return changes.drilldown(hunks, syms, within=within, **options)


def _shown(df):
    return df.select("path", "hunk", "old_lo", "old_hi", "new_lo", "new_hi", "added", "removed", "symbol", "kind", F.array_join("spans", ",").alias("spans"), "snippet", "body")


def drilldown_changed(spark: SparkSession, d: str) -> DataFrame:
    """Hunks of every file with their symbols and changed lines."""
    return _shown(_drill(spark, d, body="changed"))


def drilldown_symbol(spark: SparkSession, d: str) -> DataFrame:
    """Only hunks that overlap symbol B, added lines only, and bodies dropped in files of over 20 bytes."""
    return _shown(_drill(spark, d, body="added", only_b=True, most_bytes=20))


def overview_rebased(spark: SparkSession, d: str) -> DataFrame:
    """The overview seen from one folder; every third change stands as a move from another one."""
    e = _entries(spark, d).drop("old_path")
    moved = F.length("path") % 3 == 0
    e = e.withColumn("old_path", F.when(moved, F.concat(F.lit("elsewhere/"), "path"))).withColumn("status", F.when(moved, "R").otherwise(F.col("status")))
    return changes.rebase(e, FOLDER).select("status", "path", "old_path", "added", "removed", "note")


def untracked_counts(spark: SparkSession, d: str) -> DataFrame:
    """All-added hunks of documents, as of untracked files."""
    t = docs(spark, d).where("content IS NOT NULL AND file_path IS NOT NULL").select(F.concat_ws("/", F.col("chunk_id").cast("string"), "file_path").alias("path"), F.col("content").alias("text"))
    return changes.untracked_hunks(t).select("path", "hunk", "new_start", "new_len", "added", "removed", F.md5("body").alias("body"))


def resolve_changed(spark: SparkSession, d: str) -> DataFrame:
    """What "src" and "src/lib.rs" mean among all paths."""
    e = _files(spark, d).select(F.concat_ws("/", "repo", "rel_path").alias("path"))
    both = [changes.resolve_change(e, w).withColumn("wanted", F.lit(w)) for w in ("src/lib.rs", "parserio", "nowhere")]
    return both[0].unionByName(both[1]).unionByName(both[2])


def cache_languages(spark: SparkSession, d: str) -> DataFrame:
    return index.cache_languages(table(spark, d, "parse_cache"))


def cache_stale(spark: SparkSession, d: str) -> DataFrame:
    """Files that the parse cache does not hold in their present state."""
    f = table(spark, d, "files").select("repo", "rel_path", "length", "mtime_ns").distinct()
    return index.stale(f, table(spark, d, "parse_cache")).select("repo", "rel_path")


def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The cache after stale files were parsed again and vanished ones dropped."""
    f = table(spark, d, "files").where("rel_path IS NOT NULL AND repo IS NOT NULL").select("repo", "rel_path", "length", "mtime_ns").distinct()
    old = table(spark, d, "parse_cache").where("repo IS NOT NULL")
    fresh = index.stale(f, old).select("repo", "rel_path", F.col("length").alias("size"), F.lit("fresh").alias("language"))
    return index.upsert(old.select("repo", "rel_path", "size", "language"), fresh, ["repo", "rel_path"], f)


def guarded_read(spark: SparkSession, d: str) -> DataFrame:
    """What hinders reading each file, and its length in characters if nothing does."""
    f = table(spark, d, "files").select("file_id", "content").distinct()
    text, problem = guarded_text(F.col("content"))
    return f.select("file_id", problem.alias("problem"), F.length(text).alias("chars"))


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("file_id", lines.detect(F.col("rel_path")).alias("language")).distinct()
    return f


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """First lines of chunks as shown, and as one terse line each."""
    c = chunks(spark, d).where("content IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL")
    shown = structure.snippet(F.col("content"))
    line = structure.terse(F.col("file_path"), F.col("start_line"), F.col("chunk_id").cast("string"), F.coalesce("language", F.lit("text")), shown)
    return c.select("chunk_id", shown.alias("snippet"), structure.signature(F.col("content")).alias("signature"), line.alias("terse"))


def chunk_of_line(spark: SparkSession, d: str) -> DataFrame:
    """The chunk that holds line 20 of the file whose path comes first."""
    c = chunks(spark, d)
    path = c.agg(F.min("file_path")).first()[0]
    return dense.chunk_at(c, path, 20).select("chunk_id", "file_path")


def related_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks like the first one by the hashing encoder, without itself."""
    c = chunks(spark, d).where("content IS NOT NULL")
    source = c.orderBy("chunk_id").first()
    scored = dense.semantic_scores(dense.hash_vectors(c, "chunk_id", F.col("content")), source["content"]).where(F.col("chunk_id") != source["chunk_id"])
    return bm25.top_k(scored, 10)


def _balanced(spark, d, language):
    t = table(spark, d, "files").where(F.col("rel_path").isNotNull() & (lines.detect(F.col("rel_path")) == language)).select("repo", "rel_path", F.lit(language).alias("language"), "content").distinct()
    text, problem = guarded_text(F.col("content"))
    t = t.where(problem.isNull())
    return t.where(F.length(F.regexp_replace(text, "[^{]", "")) == F.length(F.regexp_replace(text, "[^}]", "")))


def go_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods of Go files by the scanner, with their lines."""
    return symbols.symbols(_balanced(spark, d, "go")).where("kind IN ('function', 'method') AND NOT contains(qualname, '.')").select("repo", "rel_path", "name", "start_line", "end_line")


def rust_functions(spark: SparkSession, d: str) -> DataFrame:
    """Top-level functions of Rust files by the scanner, with their first lines."""
    return symbols.symbols(_balanced(spark, d, "rust")).where("kind = 'function' AND NOT contains(qualname, '.')").select("repo", "rel_path", "name", "start_line")


def find_functions(spark: SparkSession, d: str) -> DataFrame:
    """Go functions whose name contains "cache", at most two a file, from the files to the matches."""
    f = _balanced(spark, d, "go")
    s = symbols.symbols(f).where("kind IN ('function', 'method') AND NOT contains(qualname, '.')")
    s = s.select(F.concat_ws("/", "repo", "rel_path").alias("path"), "kind", "qualname", F.col("start_line").alias("start_byte"), F.col("end_line").alias("end_byte"))
    return structure.find(s, f.select(F.concat_ws("/", "repo", "rel_path").alias("path")).distinct(), "cache", None, 1000, 2)[0].select("place", "path", "qualname", "more_in_file")


def path_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which paths a user may give, and what they become."""
    rows = []
    for p in ("a/b", "./a//b/", "a\\b", "", " ", "/a", "\\a", "C:/a", "../a", "a/../b", "a/..b"):
        try:
            rows.append((p, paths.valid_relative(p)))
        except ValueError:
            rows.append((p, None))
    return spark.createDataFrame(rows, "given string, path string")


_FNS = [
    name_status_parse, numstat_parse, unified_parse, drilldown_changed, drilldown_symbol, overview_rebased, untracked_counts, resolve_changed, cache_languages, cache_stale, cache_upsert, guarded_read, detect_language,
    snippets, chunk_of_line, related_chunks, go_functions, rust_functions, find_functions, path_checks,
]
QUERIES = {f.__name__: f for f in _FNS}

_F = "f AS (SELECT DISTINCT file_id, repo, rel_path, coalesce(length, 0) AS n FROM files WHERE rel_path IS NOT NULL)"
_H = f"""{_F}, h AS (
  SELECT concat_ws('/', repo, file_id) AS repo, rel_path AS path, CASE WHEN n % 5 = 3 THEN 'old/' || rel_path ELSE rel_path END AS old_path, hunk, n,
    (n % 50 + CASE hunk WHEN 1 THEN 1 ELSE 61 END)::INT AS old_start, CASE hunk WHEN 1 THEN 2 ELSE 1 END AS old_len, (n % 50 + CASE hunk WHEN 1 THEN 1 ELSE 62 END)::INT AS new_start,
    (CASE hunk WHEN 1 THEN 3 ELSE n % 4 + 1 END)::INT AS new_len, (CASE hunk WHEN 1 THEN 2 ELSE n % 4 + 1 END)::INT AS added, 1 AS removed
  FROM f, (VALUES (1), (2)) t(hunk))"""
_PLUS = "(CASE hunk WHEN 1 THEN '+y' || old_start || chr(10) || '+--- z' ELSE array_to_string(list_transform(range(1, new_len + 1), lambda i: '+@@ r' || i), chr(10)) END)"
_SPANS = """s AS (SELECT * FROM (VALUES ('A', 1, 200, 'class'), ('A.f', 1, 30, 'method'), ('A.g', 31, 60, 'method'), ('B', 100, 115, 'function')) t(symbol, a, z, kind)),
g AS (SELECT concat_ws('/', repo, path) AS path, hunk, old_start AS old_lo, old_start + old_len - 1 AS old_hi, new_start AS new_lo, new_start + new_len - 1 AS new_hi, added, removed, old_start, new_len FROM h),
o AS (SELECT path, hunk, symbol, kind, a, z, row_number() OVER (PARTITION BY path, hunk ORDER BY (a <= new_lo AND z >= new_hi) DESC, z - a, a, symbol) AS place FROM g, s WHERE a <= new_hi AND z >= new_lo),
w AS (SELECT path, hunk, max(symbol) FILTER (place = 1) AS symbol, max(kind) FILTER (place = 1) AS kind, CASE WHEN count(*) > 1 THEN string_agg(symbol, ',' ORDER BY a, z DESC, symbol) ELSE '' END AS spans FROM o GROUP BY ALL)"""


def _drill_sql(body: str, where: str, most: int) -> str:
    return f"""WITH {_H}, {_SPANS}, b AS (SELECT *, {body} AS body, CASE hunk WHEN 1 THEN '-x' ELSE '-q' END AS snippet FROM g WHERE {where}), t AS (SELECT path, sum(strlen(body)) AS size FROM b GROUP BY path)
SELECT b.path, b.hunk, old_lo, old_hi, new_lo, new_hi, added, removed, symbol, kind, coalesce(spans, '') AS spans, snippet, CASE WHEN size <= {most} THEN body END AS body FROM b JOIN t USING (path) LEFT JOIN w ON w.path = b.path AND w.hunk = b.hunk"""


def _function_lines(language: str, extensions: str, first: str) -> str:
    return f"""t AS (SELECT DISTINCT repo, rel_path, decode(content) AS text FROM files WHERE rel_path IS NOT NULL AND content IS NOT NULL AND regexp_matches(lower(rel_path), '\\.({extensions})$') AND octet_length(content) <= 1048576 AND try(decode(content)) IS NOT NULL AND NOT contains(try(decode(content)), chr(0))),
l AS (SELECT repo, rel_path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS no FROM t WHERE length(text) - length(replace(text, '{{', '')) = length(text) - length(replace(text, '}}', ''))),
fn AS (SELECT repo, rel_path, regexp_extract(line, '{first}', 1) AS name, no::INT AS start_line, line FROM l WHERE regexp_matches(line, '{first}'))"""


_GO = _function_lines("go", "go", r"^func (?:\([^)]*\) )?(\w+)[\[(]") + """,
gf AS (SELECT fn.repo, fn.rel_path, name, start_line, CASE WHEN ends_with(rtrim(fn.line, ' ' || chr(13)), '}') THEN start_line ELSE min(l.no)::INT END AS end_line FROM fn LEFT JOIN l ON l.repo IS NOT DISTINCT FROM fn.repo AND l.rel_path = fn.rel_path AND l.no > fn.start_line AND rtrim(l.line, ' ' || chr(13)) = '}' GROUP BY fn.repo, fn.rel_path, name, start_line, fn.line)"""
_EXTENSIONS = {
    "python": "py pyi", "rust": "rs", "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs jsx", "go": "go", "java": "java", "kotlin": "kt kts", "c": "c h", "cpp": "cc cpp hpp", "csharp": "cs", "ruby": "rb", "php": "php", "swift": "swift",
    "scala": "scala", "dart": "dart", "elixir": "ex exs", "lua": "lua", "haskell": "hs", "zig": "zig", "sql": "sql", "css": "css", "scss": "scss", "less": "less", "html": "html htm", "xml": "xml", "json": "json", "yaml": "yaml yml", "toml": "toml", "bash": "sh bash", "markdown": "md", "prisma": "prisma",
}
_DETECT = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in x.split())}) THEN '{lang}'" for lang, x in _EXTENSIONS.items())

ORACLE = {
    "name_status_parse": f"""WITH {_F} SELECT repo, (CASE n % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' WHEN 3 THEN 'R' ELSE 'C' END) AS status, (CASE n % 5 WHEN 3 THEN 50 + n % 50 WHEN 4 THEN 100 END)::INT AS score, rel_path AS path, CASE WHEN n % 5 >= 3 THEN 'old/' || rel_path END AS old_path FROM f
UNION ALL SELECT repo, 'T', NULL, rel_path || '.twin', NULL FROM f""",
    "numstat_parse": f"WITH {_F} SELECT repo, (CASE WHEN n % 7 <> 0 THEN n % 97 END)::INT AS added, (CASE WHEN n % 7 <> 0 THEN n % 13 END)::INT AS removed, rel_path AS path, CASE WHEN n % 5 = 3 THEN 'old/' || rel_path END AS old_path FROM f",
    "unified_parse": f"WITH {_H} SELECT repo, path, old_path, hunk, old_start, old_len, new_start, new_len, added, removed, CASE hunk WHEN 1 THEN '-x' || chr(10) || {_PLUS} || chr(10) || ' c' ELSE '-q' || chr(10) || {_PLUS} || chr(10) || '\\ No newline at end of file' END AS body FROM h",
    "drilldown_changed": _drill_sql(f"(CASE hunk WHEN 1 THEN '-x' ELSE '-q' END) || chr(10) || {_PLUS}", "true", 1 << 20),
    "drilldown_symbol": _drill_sql(_PLUS, "new_lo <= 115 AND new_hi >= 100", 20),
    "overview_rebased": f"""WITH {_OVER}, e AS (SELECT CASE WHEN moved THEN 'R' ELSE status END AS status, path, CASE WHEN moved THEN 'elsewhere/' || path END AS old_path, added, removed, moved FROM (SELECT *, length(path) % 3 = 0 AS moved FROM ov))
SELECT CASE WHEN moved THEN 'A' ELSE status END AS status, substr(path, {len(FOLDER) + 2}) AS path, NULL::VARCHAR AS old_path, added, removed, CASE WHEN moved THEN 'from ' || old_path END AS note FROM e WHERE starts_with(path, '{FOLDER}/')""",
    "untracked_counts": r"""WITH t AS (SELECT concat_ws('/', doc_id, concat_ws('/', repo, doc_path)) AS path, text, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS ls FROM documents WHERE text IS NOT NULL)
SELECT path, 1 AS hunk, least(len(ls), 1)::INT AS new_start, len(ls)::INT AS new_len, len(ls)::INT AS added, 0 AS removed, md5(array_to_string(list_transform(ls, lambda x: '+' || x), chr(10))) AS body FROM t""",
    "resolve_changed": """WITH p AS (SELECT DISTINCT concat_ws('/', repo, rel_path) AS path FROM files WHERE rel_path IS NOT NULL), w AS (SELECT unnest(['src/lib.rs', 'parserio', 'nowhere']) AS wanted),
r AS (SELECT path, wanted, CASE WHEN path = wanted THEN 0 WHEN ends_with(path, '/' || wanted) THEN 1 WHEN starts_with(path, wanted || '/') THEN 2 END AS k FROM p, w)
SELECT path, wanted FROM r WHERE k = (SELECT min(k) FROM r x WHERE x.wanted = r.wanted)""",
    "cache_languages": "SELECT language, count(*) AS entries, count(*) FILTER (parsed_for_symbols) AS parsed FROM parse_cache GROUP BY language",
    "cache_stale": "SELECT DISTINCT repo, rel_path FROM files f WHERE NOT EXISTS (SELECT 1 FROM parse_cache c WHERE c.repo IS NOT DISTINCT FROM f.repo AND c.rel_path = f.rel_path AND c.size = f.length AND c.mtime_secs * 1000000000 + c.mtime_nanos = f.mtime_ns)",
    "cache_upsert": """WITH f AS (SELECT DISTINCT repo, rel_path, length, mtime_ns FROM files WHERE repo IS NOT NULL AND rel_path IS NOT NULL), c AS (SELECT * FROM parse_cache WHERE repo IS NOT NULL),
s AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = f.repo AND c.rel_path = f.rel_path AND c.size = f.length AND c.mtime_secs * 1000000000 + c.mtime_nanos = f.mtime_ns))
SELECT repo, rel_path, length AS size, 'fresh' AS language FROM s UNION ALL SELECT repo, rel_path, size, language FROM c WHERE (repo, rel_path) IN (SELECT (repo, rel_path) FROM f) AND (repo, rel_path) NOT IN (SELECT (repo, rel_path) FROM s)""",
    "guarded_read": """SELECT file_id, problem, CASE WHEN problem IS NULL THEN length(text) END AS chars FROM (SELECT *, CASE WHEN octet_length(content) > 1048576 THEN 'too large' WHEN contains(hex(content), '00') AND list_contains(string_split(regexp_replace(hex(content), '(..)', '\\1 ', 'g'), ' '), '00') THEN 'binary' WHEN content IS NOT NULL AND text IS NULL THEN 'not utf-8' END AS problem
FROM (SELECT DISTINCT file_id, content, try(decode(content)) AS text FROM files))""",
    "detect_language": f"SELECT DISTINCT file_id, CASE WHEN name IN ('dockerfile', 'containerfile') THEN 'dockerfile' WHEN name = 'makefile' THEN 'make' {_DETECT} END AS language FROM (SELECT *, regexp_extract(name, '\\.([^.]*)$', 1) AS ext FROM (SELECT file_id, lower(regexp_extract(rel_path, '([^/]*)$', 1)) AS name FROM files))",
    "snippets": f"""WITH c AS (SELECT *, trim(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1], ' ') AS s, trim(string_split(content, chr(10))[1], ' ') AS g FROM {CHUNKS} WHERE content IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL),
k AS (SELECT *, CASE WHEN length(s) > 100 THEN left(s, 100) || '…' ELSE s END AS snippet, CASE WHEN length(g) > 100 THEN left(g, 100) || '…' ELSE g END AS signature FROM c)
SELECT chunk_id, snippet, signature, file_path || ':' || start_line || ' ' || chunk_id || '(' || coalesce(language, 'text') || ')' || coalesce(' :: ' || snippet, '') AS terse FROM k""",
    "chunk_of_line": f"SELECT chunk_id, file_path FROM {CHUNKS} WHERE file_path = (SELECT min(file_path) FROM {CHUNKS}) ORDER BY (start_line <= 20 AND end_line >= 20) DESC, chunk_id LIMIT 1",
    "related_chunks": f"WITH {_hash(CHUNKS)}, src AS (SELECT min(chunk_id) AS id FROM {CHUNKS} WHERE content IS NOT NULL), q AS (SELECT idx, value FROM hv WHERE chunk_id = (SELECT id FROM src)), sc AS (SELECT chunk_id, round(sum(hv.value * q.value), 6) AS score FROM hv JOIN q USING (idx) WHERE chunk_id <> (SELECT id FROM src) AND hv.value <> 0 GROUP BY chunk_id) {_top('sc', 10)}",
    "go_functions": f"WITH {_GO} SELECT * FROM gf",
    "rust_functions": f"WITH {_function_lines('rust', 'rs', r'^(?:pub(?:\([^)]*\))? )?(?:(?:const|async|unsafe) )*fn (\w+)')} SELECT repo, rel_path, name, start_line FROM fn",
    "find_functions": f"""WITH {_GO}, p AS (SELECT DISTINCT concat_ws('/', repo, rel_path) AS path FROM l), rr AS (SELECT path, split_part(path, '/', 1) AS bucket, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS turn FROM p),
h AS (SELECT concat_ws('/', repo, rel_path) AS path, name AS qualname, start_line AS b, end_line AS z FROM gf WHERE contains(lower(name), 'cache')),
e AS (SELECT h.*, turn, bucket, row_number() OVER (PARTITION BY h.path ORDER BY b, z, qualname) AS n, count(*) OVER (PARTITION BY h.path) AS t FROM h JOIN rr USING (path))
SELECT row_number() OVER (ORDER BY turn, bucket, path, b, z, qualname) AS place, path, qualname, greatest(t - 2, 0) AS more_in_file FROM e WHERE n <= 2""",
    "path_checks": "SELECT * FROM (VALUES ('a/b', 'a/b'), ('./a//b/', 'a/b'), ('a\\b', 'a/b'), ('', NULL), (' ', NULL), ('/a', NULL), ('\\a', NULL), ('C:/a', NULL), ('../a', NULL), ('a/../b', NULL), ('a/..b', 'a/..b')) t(given, path)",
}
