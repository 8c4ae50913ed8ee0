"""Change sets: parsers of git's texts, overview joins, and hunks against symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAME_STATUS = "status string, score int, path string, old_path string"
NUMSTAT = "added int, removed int, path string, old_path string"
HUNKS = "path string, old_path string, hunk int, old_start int, old_len int, new_start int, new_len int, added int, removed int, body string"
BLOCK = 64  # lines per bucket of the interval join
_HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_name_status(text: str) -> list[tuple]:
    """(status, score, path, old path) of ``--name-status -z``; renames and copies have two paths."""
    fields = text.split("\0")
    out, i = [], 0
    while i < len(fields) and fields[i]:
        code, n = fields[i][0], 2 if fields[i][0] in "RC" else 1
        if i + n >= len(fields) or not fields[i + n]:
            raise ValueError("the change list ends within a record")
        score = int(fields[i][1:]) if fields[i][1:].isdigit() else None
        old = fields[i + 1] if n == 2 else None
        out.append((code, score, fields[i + n], old))
        i += n + 1
    return out


def parse_numstat(text: str) -> list[tuple]:
    """(added, removed, path, old path) of ``--numstat -z``; binary files have no counts."""
    fields = text.split("\0")
    out, i = [], 0
    number = lambda v: None if v == "-" else int(v)
    while i < len(fields) and fields[i].strip():
        added, removed, path = fields[i].lstrip("\n").split("\t", 2)
        if path:
            out.append((number(added), number(removed), path, None))
            i += 1
        else:
            if i + 2 >= len(fields):
                raise ValueError("the numbers end within a rename")
            out.append((number(added), number(removed), fields[i + 2], fields[i + 1]))
            i += 3
    return out


def parse_unified(text: str) -> list[tuple]:
    """Rows of HUNKS from a unified diff of any number of files. Line counts of the header bound
    a hunk, so changed lines that look like headers stay lines."""
    out: list[tuple] = []
    path = old = None
    n = left = right = 0
    head, body = None, []

    def close():
        nonlocal head
        if head:
            plus, minus = sum(x[:1] == "+" for x in body), sum(x[:1] == "-" for x in body)
            out.append((path, old, n, *head, plus, minus, "\n".join(body)))
        head = None
        body.clear()

    def name(line: str) -> str | None:
        value = line[4:].split("\t")[0]
        if value.startswith('"') and value.endswith('"'):
            value = value[1:-1].encode("latin-1", "replace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
        return None if value == "/dev/null" else value[2:] if value[:2] in ("a/", "b/") else value

    for line in text.split("\n"):
        if head and (left > 0 or right > 0) and line[:1] in (" ", "+", "-", ""):
            body.append(line)
            left -= line[:1] != "+"
            right -= line[:1] != "-"
            continue
        if head and line.startswith("\\"):
            body.append(line)
            continue
        if line.startswith("diff --git "):
            close()
            path = old = None
            n = 0
        elif line.startswith("--- "):
            old = name(line)
        elif line.startswith("+++ "):
            path = name(line) or old
        elif line.startswith("rename from "):
            old = line[12:]
        elif line.startswith("rename to "):
            path = line[10:]
        else:
            m = _HEADER.match(line)
            if m:
                close()
                n += 1
                a, b, c, d = (int(v) if v is not None else 1 for v in m.groups())
                head, left, right = (a, b, c, d), b, d
    close()
    return out


def table_of(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _cells(parse, schema: str):
    """Rows of the texts of whole batches, each led by its repository."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(f"repo string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(repo, *r) for repo, text in zip(batch["repo"].to_pylist(), batch["text"].to_pylist()) if text for r in parse(text)]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kinds)], schema=kinds)

    return run


def parsed(texts: DataFrame, kind: str) -> DataFrame:
    """Rows of git's texts (repo, text), one text per repository or commit, parsed where they lie:
    ``name_status``, ``numstat`` or ``hunks``. Null and empty texts have no rows."""
    parse, schema = {"name_status": (parse_name_status, NAME_STATUS), "numstat": (parse_numstat, NUMSTAT), "hunks": (parse_unified, HUNKS)}[kind]
    return texts.select("repo", "text").mapInArrow(_cells(parse, schema), f"repo string, {schema}")


def overview(name_status: DataFrame, numstat: DataFrame, staged: DataFrame | None = None, unstaged: DataFrame | None = None) -> DataFrame:
    """(status, path, old_path, added, removed, binary, staged, unstaged): statuses with their
    counts; a file without counts in ``numstat`` is binary only if a null count is there. Marks
    come from path sets that hold both ends of renames."""
    counts = numstat.select(F.col("path").alias("_p"), "added", "removed", F.lit(True).alias("_known"))
    out = name_status.join(counts, name_status["path"] == counts["_p"], "left").withColumn("binary", F.col("_known").isNotNull() & F.col("added").isNull())
    for mark, rows in (("staged", staged), ("unstaged", unstaged)):
        if rows is None:
            out = out.withColumn(mark, F.lit(False))
            continue
        ends = rows.select(F.explode(F.array("path", "old_path")).alias(f"_{mark}")).where(F.col(f"_{mark}").isNotNull()).distinct()
        out = out.join(ends, out["path"] == ends[f"_{mark}"], "left").withColumn(mark, F.col(f"_{mark}").isNotNull()).drop(f"_{mark}")
    return out.select("status", "path", "old_path", "added", "removed", "binary", "staged", "unstaged")


def rebase(entries: DataFrame, folder: str) -> DataFrame:
    """Entries seen from ``folder``: paths lose the prefix; a rename across its border becomes an
    addition (target inside) or a deletion (source inside) with a note; the rest is outside."""
    folder = folder.strip("/")
    if not folder:
        return entries.withColumn("note", F.lit(None).cast("string"))
    inside = lambda c: F.coalesce(F.startswith(F.col(c), F.lit(folder + "/")), F.lit(False))
    cut = lambda c: F.when(inside(c), F.substring(F.col(c), len(folder) + 2, 10**6)).otherwise(F.col(c))
    moved = F.col("old_path").isNotNull() & (inside("path") != inside("old_path")) & (F.col("status") == "R")
    rows = entries.where(inside("path") | inside("old_path"))
    return rows.select(
        F.when(moved & inside("path"), F.lit("A")).when(moved, F.lit("D")).otherwise(F.col("status")).alias("status"),
        F.when(moved & ~inside("path"), cut("old_path")).otherwise(cut("path")).alias("path"),
        F.when(moved, F.lit(None)).otherwise(cut("old_path")).alias("old_path"),
        *[c for c in entries.columns if c not in ("status", "path", "old_path")],
        F.when(moved & inside("path"), F.concat(F.lit("from "), F.col("old_path"))).when(moved, F.concat(F.lit("to "), F.col("path"))).alias("note"),
    )


def state_bucket(staged: Column, unstaged: Column, status: Column) -> Column:
    return (
        F.when(status == "?", F.lit("untracked")).when(staged & unstaged, F.lit("staged+unstaged")).when(staged, F.lit("staged"))
        .when(unstaged, F.lit("unstaged")).otherwise(F.lit("other"))
    )


def totals(entries: DataFrame, *by: str) -> DataFrame:
    """Files and changed lines per group; null counts are 0."""
    return entries.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("added", F.lit(0))).alias("added"), F.sum(F.coalesce("removed", F.lit(0))).alias("removed"))


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.concat(F.split_part(path, F.lit("/"), F.lit(1)), F.lit("/"))).otherwise("./")


def hunk_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, hunk, symbol, place): symbols that overlap each hunk's new lines; place 1 is the
    smallest that contains the hunk, else the smallest that overlaps. A pure deletion stands at
    one line. Both sides meet on (path, block of lines), so a long file costs no nested loop."""
    low = F.greatest(F.col("new_start"), F.lit(1))
    h = hunks.select("path", "hunk", low.alias("lo"), (low + F.greatest(F.col("new_len"), F.lit(1)) - 1).alias("hi"))
    over = lambda a, b: F.explode(F.sequence(F.floor(a / BLOCK), F.floor(b / BLOCK)))
    h = h.withColumn("cell", over(F.col("lo"), F.col("hi")))
    s = symbols.select(F.col("path").alias("_p"), F.col("qualname").alias("symbol"), "start_line", "end_line").where(F.col("end_line") >= F.col("start_line"))
    s = s.withColumn("_cell", over(F.col("start_line"), F.col("end_line")))
    pairs = h.join(s, (h["path"] == s["_p"]) & (h["cell"] == s["_cell"]) & (F.col("start_line") <= F.col("hi")) & (F.col("end_line") >= F.col("lo")))
    # a pair meets in every block both cover; the first of them speaks for it
    pairs = pairs.where(F.col("cell") == F.floor(F.greatest("lo", "start_line") / BLOCK))
    holds = (F.col("start_line") <= F.col("lo")) & (F.col("end_line") >= F.col("hi"))
    order = [holds.desc(), (F.col("end_line") - F.col("start_line")).asc(), F.col("start_line").asc(), F.col("symbol").asc()]
    place = F.row_number().over(Window.partitionBy("path", "hunk").orderBy(*order))
    return pairs.select("path", "hunk", "symbol", place.alias("place"))


def touched(pairs: DataFrame, most: int = 8) -> DataFrame:
    """(path, symbols, more): the first ``most`` distinct symbols per path and how many follow."""
    names = pairs.select("path", "symbol").distinct()
    n = F.row_number().over(Window.partitionBy("path").orderBy("symbol"))
    first = names.withColumn("n", n).where(F.col("n") <= most).groupBy("path").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    count = names.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    return first.join(count, "path").select("path", "symbols", (F.col("_n") - F.size("symbols")).alias("more"))


def body_lines(body: Column, mode: str) -> Column:
    """The body in full, its changed lines, its added lines, or nothing."""
    lines = F.split(body, "\n")
    marks = {"changed": ["+", "-"], "added": ["+"]}
    if mode == "full":
        return body
    if mode == "none":
        return F.lit("")
    if mode not in marks:
        raise ValueError(f"unknown body {mode!r}")
    return F.array_join(F.filter(lines, lambda x: F.substring(x, 1, 1).isin(marks[mode])), "\n")


def hunk_snippet(body: Column) -> Column:
    """The first changed line, trimmed, at most 100 characters."""
    line = F.element_at(F.filter(F.split(body, "\n"), lambda x: F.substring(x, 1, 1).isin("+", "-")), 1)
    return F.left(F.trim(line), F.lit(100))


def drilldown(hunks: DataFrame, symbols: DataFrame, body: str = "full", within: DataFrame | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, hunk, old_lo, old_hi, new_lo, new_hi, added, removed, symbol, kind, spans, snippet, body,
    body_bytes): every hunk with the smallest symbol that holds it, all that overlap it in source
    order where there are several, and its body in one of the modes of ``body_lines``.

    ``within`` (path, start_line, end_line) keeps the hunks that overlap one of its ranges. A file
    whose bodies exceed ``most_bytes`` keeps none of them; ``body_bytes`` is the file's size."""
    low = lambda c: F.greatest(F.col(c), F.lit(1))
    high = lambda c, n: low(c) + F.greatest(F.col(n), F.lit(1)) - 1
    rows = hunks.select(
        "path", "hunk", low("old_start").alias("old_lo"), high("old_start", "old_len").alias("old_hi"), low("new_start").alias("new_lo"), high("new_start", "new_len").alias("new_hi"),
        "added", "removed", hunk_snippet(F.col("body")).alias("snippet"), body_lines(F.col("body"), body).alias("body"),
    )
    if within is not None:
        wanted = within.select(F.col("path").alias("_p"), F.col("start_line").alias("_a"), F.col("end_line").alias("_z"))
        rows = rows.join(wanted, (rows["path"] == wanted["_p"]) & (F.col("new_lo") <= F.col("_z")) & (F.col("new_hi") >= F.col("_a")), "left_semi")
    pairs = hunk_symbols(hunks, symbols)
    facts = symbols.select(F.col("path").alias("_p"), F.col("qualname").alias("_q"), "kind", "start_line", "end_line").groupBy("_p", "_q").agg(
        F.min(F.struct("start_line", "end_line", "kind")).alias("s")
    )
    named = pairs.join(facts, (pairs["path"] == facts["_p"]) & (pairs["symbol"] == facts["_q"]))
    spans = named.groupBy(F.col("path").alias("_sp"), F.col("hunk").alias("_sh")).agg(
        F.min(F.struct("place", "symbol", "s.kind")).alias("first"),
        F.array_sort(F.collect_list(F.struct("s.start_line", (-F.col("s.end_line")).alias("z"), "symbol"))).alias("all"),  # the symbols over one hunk
    )
    out = rows.join(spans, (rows["path"] == spans["_sp"]) & (rows["hunk"] == spans["_sh"]), "left")
    size = out.groupBy("path").agg(F.sum(F.octet_length("body")).cast("bigint").alias("body_bytes"))
    spread = F.when(F.size("all") > 1, F.transform("all", lambda x: x["symbol"]))
    return out.join(size, "path").select(
        "path", "hunk", "old_lo", "old_hi", "new_lo", "new_hi", "added", "removed", F.col("first.symbol").alias("symbol"), F.col("first.kind").alias("kind"),
        F.coalesce(spread, F.array().cast("array<string>")).alias("spans"), "snippet", F.when(F.col("body_bytes") <= most_bytes, F.col("body")).alias("body"), "body_bytes",
    )


def resolve_change(entries: DataFrame, wanted: str) -> DataFrame:
    """(path) of the changed files meant by ``wanted``: the path itself, else those that end in its
    components, else all below it as a folder."""
    wanted = wanted.strip("/")
    rank = F.when(F.col("path") == wanted, 0).when(F.endswith("path", F.lit("/" + wanted)), 1).when(F.startswith("path", F.lit(wanted + "/")), 2)
    hit = entries.select("path", rank.alias("_rank")).where(F.col("_rank").isNotNull()).distinct()
    best = hit.agg(F.min("_rank").alias("_best"))  # one row
    return hit.join(F.broadcast(best), F.col("_rank") == F.col("_best")).select("path")


def untracked_hunks(files: DataFrame, text: str = "text") -> DataFrame:
    """One all-added hunk per untracked text file (path, text)."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    n = F.when(F.col(text) == "", 0).otherwise(F.size(lines))
    body = F.when(n > 0, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n")).otherwise("")
    return files.select("path", F.lit(1).alias("hunk"), F.lit(0).alias("old_start"), F.lit(0).alias("old_len"), F.least(n, F.lit(1)).alias("new_start"), n.alias("new_len"), n.alias("added"), F.lit(0).alias("removed"), body.alias("body"))


def signature_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, change): added, removed or changed between two snapshots with one row per key."""
    a = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & b[k].eqNullSafe(a[f"_o_{k}"])
    j = b.join(a, cond, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    rows = j.where(~F.col("_old").eqNullSafe(F.col("_new")))
    return rows.select(*[F.when(F.col("_new").isNull(), F.col(f"_o_{k}")).otherwise(F.col(k)).alias(k) for k in keys], change.alias("change"))
