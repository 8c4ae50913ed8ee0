"""Hybrid ranking: reciprocal-rank fusion, boosts, insertions, penalties and diversity.

Everything before the candidates is distributed; the candidates are at most 18 k rows, so global
windows and maxima run on these only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import intent as intents
from stratalith.functions import paths
from stratalith.functions.text import STOPWORDS, split_identifier_str, tokenize_str

CONSTANT = 60
WIDTH = 9  # candidates per side, times k
INSERTIONS = 24


def reciprocal(ranked: DataFrame, weight: float) -> DataFrame:
    """(chunk_id, score) = weight / (60 + rank) from (rank, chunk_id)."""
    return ranked.select("chunk_id", (F.lit(float(weight)) / (CONSTANT + F.col("rank"))).alias("score"))


def fuse(dense_ranked: DataFrame, lexical_ranked: DataFrame, alpha: float) -> DataFrame:
    """The full outer join of two ranked lists with their weighted reciprocal ranks added."""
    both = reciprocal(dense_ranked, alpha).unionByName(reciprocal(lexical_ranked, 1 - alpha))
    return both.groupBy("chunk_id").agg(F.sum("score").alias("score"))


def file_boost(cands: DataFrame) -> DataFrame:
    """The best chunk of each file gains 0.2 * max * (file's sum / largest sum)."""
    by_file = Window.partitionBy("file_path")
    best = F.row_number().over(by_file.orderBy(F.col("score").desc(), "chunk_id")) == 1
    all_ = Window.partitionBy()
    out = cands.withColumn("_sum", F.sum("score").over(by_file)).withColumn("_best", best)
    out = out.withColumn("_top", F.max("score").over(all_)).withColumn("_most", F.max("_sum").over(all_))
    gain = F.when(F.col("_best") & (F.col("_most") > 0), F.lit(0.2) * F.col("_top") * F.col("_sum") / F.col("_most")).otherwise(0.0)
    return out.withColumn("score", F.col("score") + gain).drop("_sum", "_best", "_top", "_most")


def stem_matches(stem: Column, name: str) -> Column:
    flat = F.replace(stem, F.lit("_"), F.lit(""))
    cut = lambda c: F.regexp_replace(c, "s+$", "")
    return (stem == name) | (flat == name) | (cut(stem) == name) | (cut(flat) == name)


def definition_tier(names: list[str], unit: Column) -> Column:
    """0 where no name is defined, else ``unit``, half as much again where the stem is the name."""
    stem = paths.stem(F.col("file_path"))
    at_home = reduce(lambda a, b: a | b, [stem_matches(stem, n.lower()) for n in names])
    defines = F.coalesce(F.col("content").rlike(intents.definition_regex(names)), F.lit(False))
    return F.when(defines & at_home, unit * 1.5).when(defines, unit).otherwise(0.0)


def definition_boost(cands: DataFrame, chunks: DataFrame, query: str, top: float) -> DataFrame:
    """Definitions of the query's symbol: candidates gain, others at home in their file come in.

    ``chunks`` are the chunks the selection allows. The content filter runs over stems that fit
    only, so the scan reads the contents of few files."""
    whole = intents.is_symbol(query)
    if whole:
        leaf = intents.symbol_name(query)
        names, factor = sorted({leaf, query.strip()}), 3.0
        fits = stem_matches(paths.stem(F.col("file_path")), leaf.lower())
    else:
        names, factor = sorted(set(intents.EMBEDDED.findall(query))), 1.5
        if not names:
            return cands
        stem = paths.stem(F.col("file_path"))
        flat = F.replace(stem, F.lit("_"), F.lit(""))
        starts = lambda s, n: (s == n) | ((F.length(s) >= 4) & F.startswith(F.lit(n), s))
        fits = reduce(lambda a, b: a | b, [starts(s, n.lower()) for n in names for s in (stem, flat)])
    unit = F.lit(factor * top)
    known = cands.join(chunks.select("chunk_id", "content"), "chunk_id", "left").withColumn("score", F.col("score") + definition_tier(names, unit)).drop("content")
    new = chunks.where(fits).join(F.broadcast(cands.select("chunk_id")), "chunk_id", "left_anti").withColumn("score", definition_tier(names, unit))
    return known.unionByName(new.where(F.col("score") > 0).select(known.columns))


def stem_boost(cands: DataFrame, query: str, top: float) -> DataFrame:
    """Share of the longer keywords found in the path, and public files on public queries."""
    if not any(w in query.lower() for w in intents.STEM_TRIGGERS):
        return cands
    keywords = list(dict.fromkeys(w for w in tokenize_str(query) if len(w) > 2 and w not in STOPWORDS))
    if not keywords:
        return cands
    gain = paths.match_count(keywords, paths.path_words(F.col("file_path"))) * F.lit(top / len(keywords))
    if intents.PUBLIC_WORDS & set(keywords):
        gain = gain + F.when(paths.stem(F.col("file_path")).isin(paths.PUBLIC_STEMS), 0.8 * top).otherwise(0.0)
    return cands.withColumn("score", F.col("score") + gain)


def path_score(want: intents.Intent, path: Column) -> Column:
    """How well a path fits the query's words, identifiers and wishes."""
    words, low = paths.path_words(path), paths.normal(path)
    score = F.lit(0.0)
    if want.keywords:
        score = score + paths.match_count(want.keywords, words) / len(want.keywords)
    for ident in want.identifiers:
        parts = split_identifier_str(ident)
        n = paths.match_count(parts, words)
        score = score + F.when(n > 0, 0.9 + n / max(len(parts), 1)).otherwise(0.0)
    tests = {
        "component": (F.contains(low, F.lit("/components/")), 0.9), "hook": (F.contains(low, F.lit("/hooks/")) | F.startswith(paths.stem(path), F.lit("use")), 0.9),
        "route": (F.contains(low, F.lit("/routes/")), 0.9), "schema": (F.contains(low, F.lit("schema")), 0.8), "config": (low.rlike("config|settings"), 0.8),
        "model": (F.contains(low, F.lit("model")), 0.6), "cli": (low.rlike(r"/cli|main\.rs$"), 0.7), "cache": (F.contains(low, F.lit("cache")), 0.8),
        "public_api": (paths.stem(path).isin(paths.PUBLIC_STEMS), 1.0),
    } | {k: (paths.is_kind(path, k), 1.0) for k in ("types", "test", "docs", "vendor", "generated")}
    for w in sorted(want.wants):
        cond, value = tests[w]
        score = score + F.when(cond, value).otherwise(0.0)
    return score


def path_boost(cands: DataFrame, want: intents.Intent, top: float) -> DataFrame:
    if not want.about_paths:
        return cands
    s = path_score(want, F.col("file_path"))
    return cands.withColumn("score", F.col("score") + F.when(s > 0, F.lit(0.45 * top) * F.least(s, F.lit(2.5))).otherwise(0.0))


def insertions(cands: DataFrame, chunks: DataFrame, want: intents.Intent, top: float) -> DataFrame:
    """Up to 24 files, in path order, whose path fits and of which no chunk is a candidate come in
    with their first allowed chunk. Paths are scored once per file, not per chunk."""
    if not want.about_paths:
        return cands
    files = chunks.groupBy("file_path").agg(F.min("chunk_id").alias("chunk_id"))
    free = files.join(F.broadcast(cands.select("file_path").distinct()), "file_path", "left_anti")
    fit = free.withColumn("s", path_score(want, F.col("file_path"))).where(F.col("s") >= 0.9).orderBy("file_path").limit(INSERTIONS)
    content = fit.join(chunks.select("chunk_id", "content"), "chunk_id")
    if want.identifiers:
        defines = F.coalesce(F.col("content").rlike(intents.definition_regex(want.identifiers)), F.lit(False))
    else:
        defines = F.lit(False)
    new = content.withColumn("score", F.lit(top) * F.when(defines, 1.35).otherwise(0.85) * F.least("s", F.lit(2.0)))
    return cands.unionByName(new.select(cands.columns))


def penalty(path: Column, wants: frozenset[str]) -> Column:
    """Product of the factors for unwanted kinds of files."""
    name = paths.file_name(path)
    out = F.when(name.isin("__init__.py", "package-info.java"), 0.5).otherwise(1.0)
    for kind, factor, wish in (("test", 0.3, "test"), ("docs", 0.55, "docs"), ("vendor", 0.35, "vendor"), ("generated", 0.45, "generated"), ("compat", 0.3, None), ("examples", 0.3, "docs"), ("types", 0.7, "types")):
        if wish not in wants:
            out = out * F.when(paths.is_kind(path, kind), factor).otherwise(1.0)
    return out


def diversity(cands: DataFrame, k: int) -> DataFrame:
    """(rank, chunk_id, score): the n-th chunk of a file counts 0.5^(n-1); scores are >= 0."""
    n = F.row_number().over(Window.partitionBy("file_path").orderBy(F.col("score").desc(), "chunk_id"))
    decayed = cands.withColumn("score", F.col("score") * F.pow(F.lit(0.5), n - 1)).withColumn("score", F.round("score", 9))
    best = decayed.orderBy(F.col("score").desc(), "chunk_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "chunk_id"))
    return best.select(place.alias("rank"), "chunk_id", "score")


def hybrid(dense_ranked: DataFrame, lexical_ranked: DataFrame, chunks: DataFrame, query: str, k: int, alpha: float | None = None, selection: DataFrame | None = None) -> DataFrame:
    """(rank, chunk_id, score) of the whole chain over chunks (chunk_id, file_path, content)."""
    weight = intents.semantic_weight(query, alpha)
    want = intents.intent(query)
    slim = chunks.select("chunk_id", "file_path", "content").where(F.col("file_path").isNotNull())
    allowed = slim if selection is None else slim.join(selection.distinct(), "chunk_id", "left_semi")
    fused = fuse(dense_ranked, lexical_ranked, weight)
    cands = file_boost(F.broadcast(fused).join(slim.select("chunk_id", "file_path"), "chunk_id").select("chunk_id", "file_path", "score"))
    cands = cands.persist()  # at most 18 k rows
    top = cands.agg(F.max("score")).first()[0] or 0.0
    if intents.is_symbol(query):
        out = definition_boost(cands, allowed, query, top)
    else:
        out = definition_boost(stem_boost(cands, query, top), allowed, query, top)
    out = insertions(path_boost(out, want, top), allowed, want, top)
    if weight < 1:
        out = out.withColumn("score", F.col("score") * penalty(F.col("file_path"), want.wants))
    return diversity(out, k)
