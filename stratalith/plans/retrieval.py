"""Queries of lexical, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import intent as intents
from stratalith.functions import paths
from stratalith.functions.text import STOPWORDS, split_identifier_str, tokenize, tokenize_sql, tokenize_str
from stratalith.operators import bm25, dense, fusion
from stratalith.operators.scale import materialise, shared_dir, spread
from stratalith.plans.corpora import CHUNKS, DOCS, chunks, dirs_sql, docs, stem_sql
from stratalith.sources.tables import table

QUERY = "render the cache snapshot"
HYBRID = "config cache snapshot parser"
K = 10
PREFIXES = ["parserio", "quillmark/tessera"]
EXCLUDES = ["src", "*/*/tests/**"]
LANGUAGES = ["rust", "typescript"]


def _index(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index as a search would store it: texts are tokenised once, not per use."""
    postings = materialise(bm25.build_index(source)[0])
    return postings, postings.groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("dl"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return spread(chunks(spark, d).select("content")).select(F.explode(tokenize(F.col("content"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    postings, _ = bm25.build_index(docs(spark, d))
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build_index(chunks(spark, d))[1]


def _lexical(spark, d, **select):
    c = chunks(spark, d)
    postings, lengths = _index(c)
    return bm25.top_k(bm25.scores(postings, lengths, QUERY, bm25.select_chunks(c, **select)), K)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    postings, lengths = _index(docs(spark, d))
    return bm25.top_k(bm25.scores(postings, lengths, QUERY), K)


def bm25_language_filter(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, languages=LANGUAGES)


def bm25_path_scope(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, prefixes=PREFIXES)


def bm25_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, excludes=EXCLUDES)


def _stored(spark, d):
    """The stored index: usable postings, and lengths of the chunks in it."""
    p = table(spark, d, "postings").where("tf > 0 AND term IS NOT NULL").distinct().select("term", F.col("doc_id").alias("chunk_id"), "tf")
    lengths = table(spark, d, "chunks").where("doc_len IS NOT NULL").select("chunk_id", F.col("doc_len").alias("dl")).distinct()
    return p, lengths


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(bm25.scores(*_stored(spark, d), QUERY), K)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """All texts of the query log against the stored index at once."""
    return bm25.batch(*_stored(spark, d), table(spark, d, "queries"), K)


def _vectors(spark, d):
    return dense.usable(table(spark, d, "vectors").select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), 64)


def _query_vector():
    return [((i * 37) % 19 - 9) / 10 for i in range(64)]


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(dense.scores(_vectors(spark, d), _query_vector()), K)


def dense_selector(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return bm25.top_k(dense.scores(_vectors(spark, d), _query_vector(), bm25.select_chunks(c, languages=LANGUAGES, prefixes=PREFIXES)), K)


def dense_related(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the first usable vector, without itself."""
    v = _vectors(spark, d)
    source = v.orderBy("chunk_id").first()
    return bm25.top_k(dense.scores(v.where(F.col("chunk_id") != source["chunk_id"]), source["embedding"]), K)


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return dense.hash_vectors(docs(spark, d), "chunk_id", F.col("content")).select("chunk_id", "idx", F.round("value", 6).alias("value"))


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    v = dense.hash_vectors(chunks(spark, d), "chunk_id", F.col("content"))
    return bm25.top_k(dense.semantic_scores(v, QUERY), K)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Fused ranks of both sides for one text, before any boost."""
    c = chunks(spark, d)
    lexical = bm25.top_k(bm25.scores(*_index(c), HYBRID), fusion.WIDTH * K)
    semantic = bm25.top_k(dense.semantic_scores(materialise(dense.hash_vectors(c, "chunk_id", F.col("content"))), HYBRID), fusion.WIDTH * K)
    fused = fusion.fuse(semantic, lexical, intents.semantic_weight(HYBRID))
    return bm25.top_k(fused, K, 9)


def _seeds(spark, d):
    """Candidates of one lexical ranking with their files, as the boosts take them."""
    c = chunks(spark, d)
    best = bm25.top_k(bm25.scores(*_index(c), HYBRID), fusion.WIDTH * K)
    return c, F.broadcast(best).join(c.select("chunk_id", "file_path"), "chunk_id").select("chunk_id", "file_path", "score")


def file_boost(spark: SparkSession, d: str) -> DataFrame:
    return fusion.file_boost(_seeds(spark, d)[1]).select("chunk_id", F.round("score", 6).alias("score"))


def diversity_rerank(spark: SparkSession, d: str) -> DataFrame:
    return fusion.diversity(_seeds(spark, d)[1], K).withColumn("score", F.round("score", 6))


def path_penalty(spark: SparkSession, d: str) -> DataFrame:
    """The penalty factor of every file for a query without wishes."""
    return chunks(spark, d).select("file_path").where(F.col("file_path").isNotNull()).distinct().select("file_path", F.round(fusion.penalty(F.col("file_path"), frozenset()), 6).alias("penalty"))


def path_intent(spark: SparkSession, d: str) -> DataFrame:
    """How every file's path fits a query with wishes."""
    return chunks(spark, d).select("file_path").where(F.col("file_path").isNotNull()).distinct().select("file_path", F.round(fusion.path_score(intents.intent(HYBRID), F.col("file_path")), 6).alias("fit"))


def named_insertions(spark: SparkSession, d: str) -> DataFrame:
    c, seeds = _seeds(spark, d)
    return fusion.insertions(seeds, c.where(F.col("file_path").isNotNull()), intents.intent(HYBRID), 1.0).select("chunk_id", F.round("score", 6).alias("score"))


def definition_boost(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that define the symbol, candidates or not."""
    c, seeds = _seeds(spark, d)
    return fusion.definition_boost(seeds, c.where(F.col("file_path").isNotNull()), "CacheStore", 1.0).select("chunk_id", F.round("score", 6).alias("score"))


def hybrid_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: both rankings, fusion, boosts, insertions, penalties, diversity."""
    c = chunks(spark, d)
    lexical = bm25.top_k(bm25.scores(*_index(c), HYBRID), fusion.WIDTH * K, 9)
    semantic = bm25.top_k(dense.semantic_scores(materialise(dense.hash_vectors(c, "chunk_id", F.col("content"))), HYBRID), fusion.WIDTH * K, 9)
    return fusion.hybrid(semantic, lexical, c, HYBRID, K).withColumn("score", F.round("score", 6))


_INDEXES: dict[tuple[str, str], object] = {}


def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """A hybrid search over all files through the stored index: the first call of an application
    builds it, later ones find it up to date by the files' signatures and only search."""
    from stratalith.api import Engine
    from stratalith.operators.index import Index

    files = table(spark, d, "files").where("rel_path IS NOT NULL AND length IS NOT NULL AND mtime_ns IS NOT NULL").select(
        F.lit("").alias("repo"), F.concat_ws("/", "repo", "rel_path").alias("rel_path"), "language", "length", "mtime_ns", "content"
    )
    index = _INDEXES.setdefault((spark.sparkContext.applicationId, d), Index(spark, shared_dir(spark)))
    return Engine(spark, files, index=index).search(HYBRID, k=K).select("rank", "file_path", "start_line", "end_line", F.round("score", 6).alias("score"))


_FNS = [
    search_indexed, tokenize_terms, term_doc_freq, doc_length_stats, bm25_topk, bm25_language_filter, bm25_path_scope, bm25_exclude, bm25_postings, bm25_batch, dense_topk, dense_selector, dense_related,
    hash_embed, semantic_topk, rrf_hybrid, file_boost, diversity_rerank, path_penalty, path_intent, named_insertions, definition_boost, hybrid_full,
]
QUERIES = {f.__name__: f for f in _FNS}

# ---- the same in SQL ------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _postings(source: str) -> str:
    stem = tokenize_sql(stem_sql("file_path"))
    dirs = f"flatten(list_transform({dirs_sql('file_path')}, lambda dd: {tokenize_sql('dd').replace('lambda t:', 'lambda t:')}))"
    return f"""tok AS (
  SELECT chunk_id, unnest(list_concat(list_concat(coalesce({tokenize_sql('content')}, []), list_concat(coalesce({stem}, []), coalesce({stem}, []))), coalesce({dirs}, []))) AS term FROM {source}
), post AS (SELECT term, chunk_id, count(*)::INT AS tf FROM tok GROUP BY ALL), len AS (SELECT chunk_id, sum(tf)::INT AS dl FROM post GROUP BY chunk_id)"""


_WEIGHT = "ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1.0)))"


def _scored(query: str, where: str = "true", name: str = "sc", digits: int = 6) -> str:
    terms = ", ".join(f"'{t}'" for t in dict.fromkeys(tokenize_str(query)))
    return f"""stat AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len), hit AS (SELECT * FROM post WHERE term IN ({terms})),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
{name} AS (SELECT chunk_id, round(sum({_WEIGHT}), {digits}) AS score FROM hit JOIN dfs USING (term) JOIN len USING (chunk_id), stat WHERE {where} GROUP BY chunk_id)"""


def _top(name: str, k: int, score: str = "score") -> str:
    return f"SELECT row_number() OVER (ORDER BY {score} DESC, chunk_id)::INT AS rank, chunk_id, {score} AS score FROM (SELECT chunk_id, {score} FROM {name} ORDER BY {score} DESC, chunk_id LIMIT {k})"


def _bm25_sql(source: str, where: str = "true") -> str:
    return f"WITH {_postings(source)}, {_scored(QUERY, where)} {_top('sc', K)}"


_IN_LANG = f"chunk_id IN (SELECT chunk_id FROM {CHUNKS} WHERE language IN ('rust', 'typescript'))"
_IN_PATH = f"chunk_id IN (SELECT chunk_id FROM {CHUNKS} WHERE " + " OR ".join(f"file_path = '{p}' OR starts_with(file_path, '{p}/')" for p in PREFIXES) + ")"
_OUTSIDE = f"chunk_id IN (SELECT chunk_id FROM {CHUNKS} WHERE NOT (concat('/', file_path, '/') LIKE '%/src/%' OR regexp_matches(file_path, '^[^/]*/[^/]*/tests/.*$')))"
_USABLE = "(SELECT DISTINCT vec_id AS chunk_id, embedding FROM vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)"


def _cos(q: str) -> str:
    norm = "sqrt(list_sum(list_transform({0}, lambda v: v::DOUBLE * v::DOUBLE)))"
    a, b = norm.format("embedding"), norm.format(q)
    dots = f"list_sum(list_transform(list_zip(embedding, {q}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
    return f"round({dots} / (CASE WHEN {a} > 1e-8 THEN {a} ELSE 1 END) / {b}, 6)"


def _dense_sql(q: str, where: str = "true") -> str:
    return f"WITH sc AS (SELECT chunk_id, {_cos(q)} AS score FROM {_USABLE} WHERE {where}) {_top('sc', K)}"


def _hash(source: str) -> str:
    return f"""tk AS (SELECT chunk_id, unnest({tokenize_sql('content')}) AS term FROM {source}),
cell AS (SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS idx, sum(CASE WHEN substr(md5(term), 9, 1) >= '8' THEN -1.0 ELSE 1.0 END)::DOUBLE AS v FROM tk GROUP BY ALL),
hv AS (SELECT chunk_id, idx::INT AS idx, v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS value FROM cell QUALIFY sum(v * v) OVER (PARTITION BY chunk_id) > 1e-16)"""


def _semantic(query: str, name: str = "sem", digits: int = 6) -> str:
    q = dense.hash_query(query)
    values = ", ".join(f"({i}, {v!r})" for i, v in q.items())
    return f"{name} AS (SELECT chunk_id, round(sum(hv.value * q.value), {digits}) AS score FROM hv JOIN (VALUES {values}) q(idx, value) ON hv.idx = q.idx WHERE hv.value <> 0 GROUP BY chunk_id)"


def _fused(digits: int = 6) -> str:
    a, k = intents.semantic_weight(HYBRID), fusion.WIDTH * K
    return f"""{_postings(CHUNKS)}, {_hash(CHUNKS)}, {_scored(HYBRID, digits=digits)}, {_semantic(HYBRID, digits=digits)}, lex AS ({_top('sc', k)}), den AS ({_top('sem', k)}),
fu AS (SELECT chunk_id, sum(w) AS raw FROM (SELECT chunk_id, {a} / (60 + rank) AS w FROM den UNION ALL SELECT chunk_id, {1 - a} / (60 + rank) FROM lex) GROUP BY chunk_id)"""


_SEEDS = f"{_postings(CHUNKS)}, {_scored(HYBRID)}, best AS ({_top('sc', fusion.WIDTH * K)}), seed AS (SELECT chunk_id, file_path, score FROM best JOIN {CHUNKS} USING (chunk_id))"
_BOOSTED = """SELECT chunk_id, file_path, score + CASE WHEN score_no = 1 AND most > 0 THEN 0.2 * top * fsum / most ELSE 0 END AS score FROM (
  SELECT *, max(score) OVER () AS top, max(fsum) OVER () AS most FROM (
    SELECT *, sum(score) OVER (PARTITION BY file_path) AS fsum, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) AS score_no FROM {0}))"""


def _flag(kind: str, path: str) -> str:
    return f"regexp_matches(lower(replace({path}, '\\', '/')), '{paths.kind_pattern(kind)}')"


def _penalty(path: str, wants=frozenset()) -> str:
    out = f"(CASE WHEN regexp_extract({path}, '([^/]*)$', 1) IN ('__init__.py', 'package-info.java') THEN 0.5 ELSE 1.0 END)"
    for kind, factor, wish in (("test", 0.3, "test"), ("docs", 0.55, "docs"), ("vendor", 0.35, "vendor"), ("generated", 0.45, "generated"), ("compat", 0.3, None), ("examples", 0.3, "docs"), ("types", 0.7, "types")):
        if wish not in wants:
            out += f" * (CASE WHEN {_flag(kind, path)} THEN {factor} ELSE 1.0 END)"
    return out


def _words(path: str) -> str:
    stem = stem_sql(path)
    return f"list_filter(list_concat({tokenize_sql(path)}, {_split_sql(stem)}), lambda w: length(w) > 1 AND NOT list_contains({_list(STOPWORDS)}, w))"


def _split_sql(expr: str) -> str:
    one = tokenize_sql("''")
    body = one[one.index("lambda t: ") + len("lambda t: ") : -2]
    return f"list_extract(list_transform([{expr}], lambda t: {body}), 1)"


def _matches(keywords, words: str) -> str:
    def one(k: str) -> str:
        cut = k.rstrip("s")
        w = "regexp_replace(w, 's+$', '')"
        short = f"(CASE WHEN {len(cut)} <= length({w}) THEN '{cut}' ELSE {w} END)"
        long = f"(CASE WHEN {len(cut)} <= length({w}) THEN {w} ELSE '{cut}' END)"
        return f"(CASE WHEN len(list_filter({words}, lambda w: w = '{k}' OR {w} = '{cut}' OR (length({short}) >= 3 AND starts_with({long}, {short})))) > 0 THEN 1 ELSE 0 END)"

    return "(" + " + ".join(one(k) for k in keywords) + ")" if keywords else "0"


def _fit(path: str, words: str) -> str:
    want = intents.intent(HYBRID)
    low = f"lower(replace({path}, '\\', '/'))"
    out = f"({_matches(want.keywords, words)} / {len(want.keywords)}.0)" if want.keywords else "0.0"
    for ident in want.identifiers:
        parts = split_identifier_str(ident)
        m = _matches(parts, words)
        out += f" + (CASE WHEN {m} > 0 THEN 0.9 + {m} / {len(parts)}.0 ELSE 0 END)"
    tests = {
        "component": (f"contains({low}, '/components/')", 0.9), "hook": (f"(contains({low}, '/hooks/') OR starts_with({stem_sql(path)}, 'use'))", 0.9), "route": (f"contains({low}, '/routes/')", 0.9),
        "schema": (f"contains({low}, 'schema')", 0.8), "config": (f"regexp_matches({low}, 'config|settings')", 0.8), "model": (f"contains({low}, 'model')", 0.6), "cli": (f"regexp_matches({low}, '/cli|main\\.rs$')", 0.7),
        "cache": (f"contains({low}, 'cache')", 0.8), "public_api": (f"list_contains({_list(paths.PUBLIC_STEMS)}, {stem_sql(path)})", 1.0),
    }
    for w in sorted(want.wants):
        cond, value = tests.get(w) or (_flag(w, path), 1.0)
        out += f" + (CASE WHEN {cond} THEN {value} ELSE 0 END)"
    return out


_FILES = f"files_ AS (SELECT file_path, min(chunk_id) AS chunk_id, {_words('file_path')} AS words FROM {CHUNKS} WHERE file_path IS NOT NULL GROUP BY file_path), fit AS (SELECT file_path, chunk_id, {_fit('file_path', 'words')} AS s FROM files_)"
_WANT = intents.intent(HYBRID)


def _insert_sql(cands: str, top: str) -> str:
    defines = "false"
    if _WANT.identifiers:
        defines = f"regexp_matches(content, '{intents.definition_regex(_WANT.identifiers)}')"
    return f"""SELECT f.chunk_id, f.file_path, {top} * (CASE WHEN {defines} THEN 1.35 ELSE 0.85 END) * least(s, 2.0) AS score FROM (
  SELECT * FROM fit WHERE s >= 0.9 AND file_path NOT IN (SELECT file_path FROM {cands}) ORDER BY file_path LIMIT 24) f JOIN {CHUNKS} c ON c.chunk_id = f.chunk_id"""


def _definition_sql() -> str:
    name = "CacheStore"
    stem = stem_sql("file_path")
    home = " OR ".join(f"{e} = '{name.lower()}'" for s in (stem, f"replace({stem}, '_', '')") for e in (s, f"regexp_replace({s}, 's+$', '')"))
    rx = intents.definition_regex([name])
    tier = f"(CASE WHEN coalesce(regexp_matches(content, '{rx}'), false) THEN (CASE WHEN {home} THEN 4.5 ELSE 3.0 END) ELSE 0.0 END)"
    return f"""WITH {_SEEDS} SELECT seed.chunk_id, round(seed.score + {tier.replace('file_path', 'seed.file_path')}, 6) AS score FROM seed JOIN (SELECT chunk_id, content FROM {CHUNKS}) USING (chunk_id)
UNION ALL SELECT chunk_id, round({tier}, 6) FROM {CHUNKS} WHERE file_path IS NOT NULL AND ({home}) AND {tier} > 0 AND chunk_id NOT IN (SELECT chunk_id FROM seed)"""


def _hybrid_sql() -> str:
    keywords = list(dict.fromkeys(w for w in tokenize_str(HYBRID) if len(w) > 2 and w not in STOPWORDS))
    stem_gain = f"top * {_matches(keywords, 'words')} / {len(keywords)}.0" if any(w in HYBRID for w in intents.STEM_TRIGGERS) else "0.0"
    return f"""WITH {_fused(9)}, cand AS (SELECT fu.chunk_id, c.file_path, raw AS score FROM fu JOIN {CHUNKS} c USING (chunk_id) WHERE c.file_path IS NOT NULL), fb AS ({_BOOSTED.format('cand')}), mx AS (SELECT max(score) AS top FROM fb), {_FILES},
b AS (SELECT fb.chunk_id, fb.file_path, fb.score + {stem_gain} + CASE WHEN s > 0 THEN 0.45 * top * least(s, 2.5) ELSE 0 END AS score FROM fb JOIN fit USING (file_path) JOIN (SELECT file_path, words FROM files_) USING (file_path), mx),
al AS (SELECT * FROM b UNION ALL ({_insert_sql('b', '(SELECT top FROM mx)')})),
pn AS (SELECT chunk_id, file_path, score * {_penalty('file_path', _WANT.wants)} AS score FROM al),
dv AS (SELECT chunk_id, round(score * pow(0.5, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) - 1), 9) AS sc9 FROM pn)
SELECT row_number() OVER (ORDER BY sc9 DESC, chunk_id)::INT AS rank, chunk_id, round(sc9, 6) AS score FROM (SELECT * FROM dv ORDER BY sc9 DESC, chunk_id LIMIT {K})"""


_STORED = "post AS (SELECT DISTINCT term, doc_id AS chunk_id, tf FROM postings WHERE tf > 0 AND term IS NOT NULL), len AS (SELECT DISTINCT chunk_id, doc_len AS dl FROM chunks WHERE doc_len IS NOT NULL)"

ORACLE = {
    "tokenize_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({tokenize_sql('content')}) AS term FROM {CHUNKS}) GROUP BY term",
    "term_doc_freq": f"WITH {_postings(DOCS)} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term",
    "doc_length_stats": f"WITH {_postings(CHUNKS)} SELECT chunk_id, dl FROM len",
    "bm25_topk": _bm25_sql(DOCS),
    "bm25_language_filter": _bm25_sql(CHUNKS, _IN_LANG),
    "bm25_path_scope": _bm25_sql(CHUNKS, _IN_PATH),
    "bm25_exclude": _bm25_sql(CHUNKS, _OUTSIDE),
    "bm25_postings": f"WITH {_STORED}, {_scored(QUERY)} {_top('sc', K)}",
    "bm25_batch": f"""WITH {_STORED}, stat AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len), q AS (SELECT DISTINCT query_text, unnest(list_distinct({tokenize_sql('query_text')})) AS term FROM queries WHERE query_text IS NOT NULL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), sc AS (SELECT query_text, chunk_id, round(sum({_WEIGHT}), 6) AS score FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN len USING (chunk_id), stat GROUP BY ALL)
SELECT * FROM (SELECT query_text, row_number() OVER (PARTITION BY query_text ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, score FROM sc WHERE score > 0) WHERE rank <= {K}""",
    "dense_topk": _dense_sql(_list(_query_vector()).replace("'", "")),
    "dense_selector": _dense_sql(_list(_query_vector()).replace("'", ""), f"{_IN_LANG} AND {_IN_PATH}"),
    "dense_related": f"WITH src AS (SELECT chunk_id AS sid, embedding AS q FROM {_USABLE} ORDER BY chunk_id LIMIT 1), sc AS (SELECT chunk_id, {_cos('q')} AS score FROM {_USABLE}, src WHERE chunk_id <> sid) {_top('sc', K)}",
    "hash_embed": f"WITH {_hash(DOCS)} SELECT chunk_id, idx, round(value, 6) AS value FROM hv WHERE value <> 0",
    "semantic_topk": f"WITH {_hash(CHUNKS)}, {_semantic(QUERY)} {_top('sem', K)}",
    "rrf_hybrid": f"WITH {_fused()}, rf AS (SELECT chunk_id, round(raw, 9) AS score FROM fu) {_top('rf', K)}",
    "file_boost": f"WITH {_SEEDS} SELECT chunk_id, round(score, 6) AS score FROM ({_BOOSTED.format('seed')})",
    "diversity_rerank": f"WITH {_SEEDS}, dv AS (SELECT chunk_id, round(score * pow(0.5, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) - 1), 9) AS sc9 FROM seed) SELECT row_number() OVER (ORDER BY sc9 DESC, chunk_id)::INT AS rank, chunk_id, round(sc9, 6) AS score FROM (SELECT * FROM dv ORDER BY sc9 DESC, chunk_id LIMIT {K})",
    "path_penalty": f"SELECT DISTINCT file_path, round(({_penalty('file_path')})::DOUBLE, 6) AS penalty FROM {CHUNKS} WHERE file_path IS NOT NULL",
    "path_intent": f"WITH {_FILES} SELECT file_path, round(s, 6) AS fit FROM fit",
    "named_insertions": f"WITH {_SEEDS}, {_FILES} SELECT chunk_id, round(score, 6) AS score FROM (SELECT chunk_id, score FROM seed UNION ALL SELECT chunk_id, score FROM ({_insert_sql('seed', '1.0')}))",
    "definition_boost": _definition_sql(),
    "hybrid_full": _hybrid_sql(),
}
