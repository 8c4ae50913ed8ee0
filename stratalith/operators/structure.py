"""Catalogue and structure queries: files, languages, line counts, reading, finding symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions import paths
from stratalith.operators.scale import rank_in_groups

# Names that stand for sets of kinds.
KIND_SETS = {
    "callable": ["function", "method", "constructor"], "container": ["class", "interface", "struct", "enum", "trait", "impl", "module", "namespace", "object", "record"],
    "value": ["constant", "variable", "property", "field"],
}
SNIPPET = 100


def languages(stats: DataFrame) -> DataFrame:
    """(language, files, lines, blank, comment, code) of per-file counts; null is plaintext."""
    code = F.col("total") - F.col("blank") - F.col("comment")
    return (
        stats.groupBy(F.coalesce("language", F.lit("plaintext")).alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("total").alias("lines"), F.sum("blank").alias("blank"), F.sum("comment").alias("comment"), F.sum(code).alias("code"))
        .orderBy(F.col("files").desc(), "language")
    )


def kinds_filter(kinds: Sequence[str] | None) -> Column:
    if not kinds:
        return F.lit(True)
    wanted = [k for kind in kinds for k in KIND_SETS.get(kind.lower(), [kind.lower()])]
    return F.lower("kind").isin(wanted)


def depth_filter(depth: int | None) -> Column:
    return F.lit(True) if depth is None else F.size(F.split("qualname", r"\.")) <= depth


def contains_text(column: Column, wanted: str) -> Column:
    """Case-insensitive substring, never a pattern."""
    return F.contains(F.lower(column), F.lit(wanted.lower()))


def sort_code(df: DataFrame, sort: str, ties: Sequence[str]) -> list[Column]:
    keys = {"code-desc": [F.col("code").desc()], "code-asc": [F.col("code").asc()], "path": []}
    if sort not in keys:
        raise ValueError(f"unknown sort {sort!r}")
    return [*keys[sort], *[F.col(t).asc() for t in ties]]


def loc(rows: DataFrame, least: int | None = None, most: int | None = None, langs: Sequence[str] | None = None, sort: str = "code-desc", limit: int | None = 50, ties: Sequence[str] = ("path",)) -> DataFrame:
    """``rows`` (path, language, total, blank, comment) with code lines within bounds; languages
    compare without case; ``matches`` is the number before the limit."""
    if least is not None and most is not None and least > most:
        raise ValueError("the least number of lines exceeds the most")
    out = rows.withColumn("code", F.col("total") - F.col("blank") - F.col("comment"))
    if least is not None:
        out = out.where(F.col("code") >= least)
    if most is not None:
        out = out.where(F.col("code") <= most)
    if langs:
        out = out.where(F.lower("language").isin([x.lower() for x in langs]))
    if limit is None:
        return out.orderBy(*sort_code(out, sort, ties))
    total = out.agg(F.count(F.lit(1)).alias("matches"))
    return out.orderBy(*sort_code(out, sort, ties)).limit(limit).crossJoin(F.broadcast(total))


def list_files(files: DataFrame, globs: Sequence[str] | None = None, excludes: Sequence[str] | None = None, path: str = "rel_path") -> DataFrame:
    """Distinct paths by globs, in byte order."""
    col = F.col(path)
    return files.where(paths.include(col, list(globs or [])) & paths.exclude(col, list(excludes or []))).select(col.alias("path")).distinct().orderBy("path")


def file_groups(listed: DataFrame, sample: int = 3) -> DataFrame:
    """(root, files, first, last): per top folder the count and the first and last few paths, each
    by a group-limited window, so no group is gathered whole."""
    rows = listed.select("path", paths.top_dir(F.col("path")).alias("root"))
    counts = rows.groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    ends = []
    for name, order in (("first", F.col("path").asc()), ("last", F.col("path").desc())):
        n = F.row_number().over(Window.partitionBy("root").orderBy(order))
        top = rows.withColumn("n", n).where(F.col("n") <= sample).groupBy("root").agg(F.array_sort(F.collect_list("path")).alias(name))
        ends.append(top)
    return counts.join(ends[0], "root").join(ends[1], "root")


def common_prefix(rows: DataFrame, path: str = "path") -> DataFrame:
    """(prefix): the longest common folder prefix; the least and greatest path settle it."""
    both = rows.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))), F.lit(0),
        lambda s, i: F.when((s == i - 1) & (F.substring(F.col("a"), i, F.lit(1)) == F.substring(F.col("b"), i, F.lit(1))), i).otherwise(s),
    )
    return both.select(F.regexp_extract(F.substring(F.col("a"), F.lit(1), shared), "^(.*/)", 1).alias("prefix"))


def read_lines(files: DataFrame, start: int, end: int, text: str = "text") -> DataFrame:
    """Lines ``start``..``end`` (from 1, inclusive; the end clamps) of every row's text; texts
    that are shorter than ``start`` have no row."""
    if start < 1 or end < start:
        raise ValueError("lines are 1 <= start <= end")
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return files.where(F.size(lines) >= start).withColumn("slice", F.array_join(F.slice(lines, start, end - start + 1), "\n"))


def plain_line_stats(rows: DataFrame, text: str = "text") -> DataFrame:
    """total, blank and comment = 0 for languages without comments, in SQL alone."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    lines = F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(lines)
    blank = F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"\s+", "")) == 0))
    return rows.withColumn("total", F.size(lines)).withColumn("blank", blank).withColumn("comment", F.lit(0))


def kind_counts(symbols: DataFrame, path: str = "path") -> DataFrame:
    """(path, kinds): a map of kind to count, in key order."""
    per = symbols.groupBy(path, "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(path).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def outline(symbols: DataFrame, kinds: Sequence[str] | None = None, depth: int | None = None, most: int = 500) -> DataFrame:
    """Symbols of one file in order; without filters, more than ``most`` show the top level only."""
    if not kinds and depth is None and symbols.limit(most + 1).count() > most:
        depth = 1
    return symbols.where(kinds_filter(kinds) & depth_filter(depth)).orderBy("start_byte", "end_byte")


def round_robin(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, turn, bucket): one file of every top folder in turn, folders and files in order. Paths
    are distinct; a folder that holds most of all files is numbered by many tasks."""
    rows = files.select(F.col(path).alias("path"), paths.top_dir(F.col(path)).alias("bucket"))
    return rank_in_groups(rows, ["bucket"], [F.col("path").asc_nulls_first()], "turn").select("path", F.col("turn").cast("int").alias("turn"), "bucket")


def find(symbols: DataFrame, files: DataFrame, query: str, kinds: Sequence[str] | None = None, limit: int = 50, per_file: int = 5) -> tuple[DataFrame, DataFrame]:
    """(matches, summary) of a scan that stops at ``limit``.

    Files are visited in ``round_robin`` order and their symbols by position. A match beyond
    ``per_file`` in its file is overflow. The position of the ``limit``-th match cuts the scan:
    matches and overflow up to it count, ``truncated`` tells whether anything was left to visit,
    ``searched`` how many files were begun and ``unsampled`` which top folders were not.

    Matching is distributed; only the matches' positions (keys, no content) are ordered globally,
    by the distributed rank of ``scale.rank_in_groups``.
    """
    from stratalith.operators.scale import rank_in_groups

    if not query:
        raise ValueError("the query is empty")
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    order = round_robin(files)
    hit = symbols.where(contains_text(F.col("qualname"), query) & kinds_filter(kinds)).join(order, "path")
    in_file = Window.partitionBy("path").orderBy("start_byte", "end_byte", "qualname")
    hit = hit.withColumn("n", F.row_number().over(in_file)).withColumn("emitted", (F.col("n") <= per_file) | F.lit(per_file == 0))
    shown = hit.where("emitted").withColumn("g", F.lit(0))
    ranked = rank_in_groups(shown, ["g"], [F.col("turn").asc(), F.col("bucket").asc(), F.col("path").asc(), F.col("start_byte").asc(), F.col("end_byte").asc(), F.col("qualname").asc()], "place").where(F.col("place") <= limit)
    cut = ranked.where(F.col("place") == limit).select(F.struct("turn", "bucket", "path", "start_byte", "end_byte", "qualname").alias("cut"))
    at = cut.first()  # one row
    place_of = F.struct("turn", "bucket", "path")
    if at is None:
        summary = order.agg(F.lit(False).alias("truncated"), F.count(F.lit(1)).alias("searched"), F.array().cast("array<string>").alias("unsampled"))
        over = hit.where(~F.col("emitted"))
    else:
        c = at["cut"]
        here = F.struct(F.lit(c["turn"]).alias("turn"), F.lit(c["bucket"]).alias("bucket"), F.lit(c["path"]).alias("path"))
        over = hit.where(~F.col("emitted") & (place_of < here))
        visited = order.where(place_of <= here)
        rest = order.where(place_of > here).limit(1).count() > 0
        if not rest:
            later = symbols.where((F.col("path") == c["path"]) & (F.struct("start_byte", "end_byte", "qualname") > F.struct(F.lit(c["start_byte"]), F.lit(c["end_byte"]), F.lit(c["qualname"]))))
            rest = later.limit(1).count() > 0
        missed = order.select("bucket").distinct().join(visited.select("bucket").distinct(), "bucket", "left_anti").where(F.col("bucket") != "")
        summary = visited.agg(F.lit(rest).alias("truncated"), F.count(F.lit(1)).alias("searched")).crossJoin(missed.agg(F.array_sort(F.collect_set("bucket")).alias("unsampled")))
    more = over.groupBy("path").agg(F.count(F.lit(1)).alias("more"))
    matches = ranked.join(more, "path", "left").select("place", "path", "kind", "qualname", "start_byte", "end_byte", F.coalesce("more", F.lit(0)).alias("more_in_file"))
    return matches.orderBy("place"), summary


def resolve_path(known: DataFrame, wanted: str, path: str = "path") -> DataFrame:
    """(path): ``wanted`` itself where it exists, else all paths that end in its components."""
    wanted = paths.valid_relative(wanted)
    exact = F.col(path) == wanted
    hit = known.where(exact | F.endswith(path, F.lit("/" + wanted))).select(F.col(path).alias("path"), exact.alias("_exact")).distinct()
    any_exact = hit.agg(F.max("_exact").alias("any"))
    return hit.crossJoin(F.broadcast(any_exact)).where(F.col("_exact") | ~F.col("any")).select("path")


def dirs(files: DataFrame, path: str = "path") -> DataFrame:
    """Distinct folders of all paths."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(prefixes).alias("dir")).distinct()


def _shortened(line: Column) -> Column:
    return F.when(F.length(line) > SNIPPET, F.concat(F.left(line, F.lit(SNIPPET)), F.lit("…"))).otherwise(line)


def snippet(text: Column) -> Column:
    """First non-blank line, trimmed, at most 100 characters and an ellipsis."""
    return _shortened(F.trim(F.element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1)))


def signature(text: Column) -> Column:
    """First line of a symbol's text, trimmed, at most 100 characters and an ellipsis."""
    return _shortened(F.trim(F.substring_index(text, "\n", 1)))


def terse(path: Column, line: Column, qualname: Column, kind: Column, shown: Column | None = None) -> Column:
    """``path:line qualname(kind)`` and, with a snippet, `` :: snippet``."""
    head = F.format_string("%s:%d %s(%s)", path, line, qualname, kind)
    return head if shown is None else F.when(shown.isNull(), head).otherwise(F.concat(head, F.lit(" :: "), shown))
