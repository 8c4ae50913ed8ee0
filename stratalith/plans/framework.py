"""Queries of the web framework's routes, of query classes, and of the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import intent as intents
from stratalith.functions.text import tokenize_sql
from stratalith.operators import framework
from stratalith.operators.index import Index
from stratalith.operators.scale import shared_dir
from stratalith.plans.corpora import dirs_sql, stem_sql
from stratalith.sources.repo import guarded_text
from stratalith.sources.tables import table

APP = {
    "package.json": '{"name": "x", "dependencies": {"react": "18"}, "devDependencies": {"next": "14.2.1"}}',
    "app/page.tsx": "export default function Home() {}", "app/(marketing)/promo/page.tsx": "", "app/_parts/x/page.tsx": "", "app/blog/[slug]/page.jsx": "", "app/docs/[...all]/page.js": "", "app/@modal/photos/page.tsx": "", "app/feed/(..)(..)photo/page.tsx": "", "app/shop/(.)cart/page.ts": "",
    "app/layout.tsx": "", "app/blog/error.tsx": "", "app/blog/loading.js": "", "app/(marketing)/template.tsx": "", "app/blog/styles.css": "", "app/api/users/route.ts": "export async function POST() {}\nexport function GET() {}\nconst remove = 1, patch = 2\nexport { remove as DELETE, patch as PATCH, other }\nexport const dynamic = 'x'\n",
    "app/api/ping/route.js": "export const HEAD = () => 1;\nfunction OPTIONS() {}\n", "pages/index.tsx": "", "pages/about.jsx": "", "pages/_app.tsx": "", "pages/404.tsx": "", "pages/blog/index.js": "", "pages/blog/[id].tsx": "", "pages/api/hello.ts": "", "pages/notes.md": "",
    "app/actions.ts": "'use server'\nexport async function createPost() {}\nasync function archive() {}\nfunction plain() {}\nexport { archive as archivePost, plain as notAnAction, gone }\nexport const likePost = async () => {}\nexport default async function () {}\n",
    "app/form.tsx": "export function HomePage() {\n  async function submitForm(data) {\n    'use server'\n    save(data)\n  }\n  const saveDraft = async (x) => { 'use server'; return x }\n  function plainHelper() { return 'use server' }\n}\n",
    "lib/util.ts": "// 'use server' is only mentioned\nexport async function helper() {}\n",
}


def _app(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(APP.items()), "path string, text string")


def framework_info(spark: SparkSession, d: str) -> DataFrame:
    return framework.detect(_app(spark))


def framework_routes(spark: SparkSession, d: str) -> DataFrame:
    return framework.routes(_app(spark).select("path"))


def framework_layouts(spark: SparkSession, d: str) -> DataFrame:
    return framework.layouts(_app(spark).select("path"))


def framework_methods(spark: SparkSession, d: str) -> DataFrame:
    return _app(spark).where("path LIKE 'app/api/%'").select(F.col("path").alias("file"), F.array_join(framework.methods(F.col("text")), ",").alias("methods"))


def framework_actions(spark: SparkSession, d: str) -> DataFrame:
    return framework.server_actions(_app(spark))


def routes_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file's folder as a route of the newer router, with a group and, for some, a slot."""
    f = table(spark, d, "files").where("rel_path IS NOT NULL").select("repo", "rel_path", "file_id").distinct()
    slot = F.when(F.col("file_id") % 3 == 0, "@side/").otherwise("")
    path = F.concat(F.lit("src/app/(g)/"), F.concat_ws("/", "repo", F.regexp_replace("rel_path", "/?[^/]*$", "")), F.lit("/"), slot, F.when(F.col("file_id") % 2 == 0, "page.tsx").otherwise("route.ts"))
    return framework.app_routes(f.select(path.alias("path")).distinct())


QUERIES_BY_CLASS = [
    "MyService", "parse_json", "useSession hook", "parse hunk header", "how does routing work", "request lifecycle architecture", "where are errors handled?", "request validation and error handling",
]


def query_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = [(q, intents.query_class(q), intents.semantic_weight(q)) for q in QUERIES_BY_CLASS] + [("explicit", "given", intents.semantic_weight("anything", 0.7))]
    return spark.createDataFrame(rows, "query string, class string, weight double")


def symbol_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(q, intents.symbol_name(q)) for q in ("a::b::C", "App\\Models\\User", "self->run", "auth.session.open", " plain ")], "query string, name string")


def index_store(spark: SparkSession, d: str) -> DataFrame:
    """Terms of an index that was built over half of the short files and then brought up to date with
    all; a short file is one chunk."""
    f = table(spark, d, "files").where("rel_path IS NOT NULL AND repo IS NOT NULL").select("repo", "rel_path", "length", "mtime_ns", "content").distinct()
    text, problem = guarded_text(F.col("content"))
    f = f.where(problem.isNull() & F.octet_length("content").between(1, 1000) & (F.trim(F.regexp_replace(text, "\\s+", "")) != "")).select(
        "repo", "rel_path", F.lit("json").alias("language"), F.octet_length("content").cast("bigint").alias("length"), F.coalesce("mtime_ns", F.lit(0)).alias("mtime_ns"), "content"
    )
    index = Index(spark, shared_dir(spark))
    index.ensure(f.where("length % 2 = 0"))
    index.ensure(f)
    return index.table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


_FNS = [framework_info, framework_routes, framework_layouts, framework_methods, framework_actions, routes_of_files, query_weights, symbol_names, index_store]
QUERIES = {f.__name__: f for f in _FNS}

_STEM, _PATH = stem_sql("path"), "concat_ws('/', repo, rel_path)"
ORACLE = {
    "framework_info": "SELECT '14.2.1' AS version, true AS app, true AS pages, false AS src",
    "framework_routes": """SELECT * FROM (VALUES
('/', 'app/page.tsx', 'page', 'app', false), ('/promo', 'app/(marketing)/promo/page.tsx', 'page', 'app', false), ('/blog/[slug]', 'app/blog/[slug]/page.jsx', 'page', 'app', false), ('/docs/[...all]', 'app/docs/[...all]/page.js', 'page', 'app', false),
('/photos', 'app/@modal/photos/page.tsx', 'page', 'app', true), ('/feed/photo', 'app/feed/(..)(..)photo/page.tsx', 'page', 'app', true), ('/shop/cart', 'app/shop/(.)cart/page.ts', 'page', 'app', true), ('/api/users', 'app/api/users/route.ts', 'api', 'app', false), ('/api/ping', 'app/api/ping/route.js', 'api', 'app', false),
('/', 'pages/index.tsx', 'page', 'pages', false), ('/about', 'pages/about.jsx', 'page', 'pages', false), ('/blog', 'pages/blog/index.js', 'page', 'pages', false), ('/blog/[id]', 'pages/blog/[id].tsx', 'page', 'pages', false), ('/api/hello', 'pages/api/hello.ts', 'api', 'pages', false)
) t(pattern, file, kind, router, advanced)""",
    "framework_layouts": "SELECT * FROM (VALUES ('layout', 'app/layout.tsx', '/'), ('error', 'app/blog/error.tsx', '/blog'), ('loading', 'app/blog/loading.js', '/blog'), ('template', 'app/(marketing)/template.tsx', '/')) t(kind, file, scope)",
    "framework_methods": "SELECT * FROM (VALUES ('app/api/users/route.ts', 'GET,POST,DELETE,PATCH'), ('app/api/ping/route.js', 'HEAD')) t(file, methods)",
    "framework_actions": "SELECT * FROM (VALUES ('app/actions.ts', 'createPost', 'file'), ('app/actions.ts', 'archivePost', 'file'), ('app/actions.ts', 'likePost', 'file'), ('app/actions.ts', 'default', 'file'), ('app/form.tsx', 'submitForm', 'function'), ('app/form.tsx', 'saveDraft', 'function')) t(file, name, scope)",
    "routes_of_files": """WITH f AS (SELECT DISTINCT concat_ws('/', repo, regexp_replace(rel_path, '/?[^/]*$', '')) AS dir, file_id % 3 = 0 AS side, file_id % 2 = 0 AS page FROM files WHERE rel_path IS NOT NULL)
SELECT CASE WHEN regexp_replace(dir, '/+$', '') = '' THEN '/' ELSE '/' || regexp_replace(dir, '/+$', '') END AS pattern, 'src/app/(g)/' || dir || '/' || CASE WHEN side THEN '@side/' ELSE '' END || CASE WHEN page THEN 'page.tsx' ELSE 'route.ts' END AS file,
CASE WHEN page THEN 'page' ELSE 'api' END AS kind, 'app' AS router, side AS advanced FROM f WHERE NOT regexp_matches('/' || dir, '/_')""",
    "query_weights": """SELECT * FROM (VALUES ('MyService', 'symbol', 0.25), ('parse_json', 'symbol', 0.25), ('useSession hook', 'mixed', 0.45), ('parse hunk header', 'keywords', 0.35), ('how does routing work', 'question', 0.65), ('request lifecycle architecture', 'question', 0.65),
('where are errors handled?', 'question', 0.65), ('request validation and error handling', 'other', 0.55), ('explicit', 'given', 0.7)) t(query, class, weight)""",
    "symbol_names": "SELECT * FROM (VALUES ('a::b::C', 'C'), ('App\\Models\\User', 'User'), ('self->run', 'run'), ('auth.session.open', 'open'), (' plain ', 'plain')) t(query, name)",
    "index_store": f"""WITH f AS (SELECT DISTINCT {_PATH} AS path, decode(content) AS text FROM files WHERE repo IS NOT NULL AND rel_path IS NOT NULL AND content IS NOT NULL AND octet_length(content) BETWEEN 1 AND 1000 AND try(decode(content)) IS NOT NULL
  AND NOT list_contains(string_split(regexp_replace(hex(content), '(..)', '\\1 ', 'g'), ' '), '00') AND regexp_replace(try(decode(content)), '\\s+', '', 'g') <> ''),
tok AS (SELECT path, unnest(list_concat(list_concat(coalesce({tokenize_sql('text')}, []), list_concat(coalesce({tokenize_sql(_STEM)}, []), coalesce({tokenize_sql(_STEM)}, []))), flatten(list_transform({dirs_sql('path')}, lambda dd: {tokenize_sql('dd')})))) AS term FROM f)
SELECT term, count(DISTINCT path) AS df, count(*)::BIGINT AS tf FROM tok GROUP BY term""",
}
