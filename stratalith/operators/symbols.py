"""Symbols of source files, and chunks cut along them.

A scanner per language family yields (kind, name, depth) with byte and line ranges: Python by its
own parser, the others by declarations and balanced braces. Files that do not scan yield nothing.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators.scale import spread

MAX_BYTES = 1 << 20
CHUNK_BYTES = 2_000


class Symbol(NamedTuple):
    kind: str
    name: str
    qualname: str
    start_byte: int
    end_byte: int
    start_line: int
    end_line: int


# What opens a symbol, by language; the group "n" is its name.
_DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<n>\w+)"), ("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"),
        ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("trait", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"), ("impl", r"impl(?:<[^{]*?>)?\s+(?:[\w:<>,' ]+\s+for\s+)?(?P<n>\w+)"),
        ("module", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)(?=\s*\{)"), ("constant", r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<n>\w+)\s*:"), ("type", r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)"), ("macro", r"macro_rules!\s+(?P<n>\w+)"),
    ],
    "go": [("function", r"func\s+(?P<n>\w+)\s*[\[(]"), ("method", r"func\s+\([^)]*\)\s*(?P<n>\w+)"), ("struct", r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+struct"), ("interface", r"type\s+(?P<n>\w+)(?:\[[^\]]*\])?\s+interface"), ("type", r"type\s+(?P<n>\w+)\s+(?!struct|interface)"), ("constant", r"const\s+(?P<n>\w+)"), ("variable", r"var\s+(?P<n>\w+)")],
    "java": [("class", r"(?:(?:public|protected|private|static|final|abstract|sealed|strictfp)\s+)*class\s+(?P<n>\w+)"), ("interface", r"(?:(?:public|protected|private|static|sealed|abstract)\s+)*@?interface\s+(?P<n>\w+)"), ("enum", r"(?:(?:public|protected|private|static)\s+)*enum\s+(?P<n>\w+)"), ("record", r"(?:(?:public|protected|private|static|final)\s+)*record\s+(?P<n>\w+)\s*[(<]"), ("method", r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]*>\s*)?(?:[\w.<>\[\],? ]+\s+)?(?P<n>\w+)\s*\((?=[^;{]*[;{])")],
    "kotlin": [("class", r"(?:(?:public|private|internal|open|abstract|sealed|data|inner|annotation)\s+)*class\s+(?P<n>\w+)"), ("interface", r"(?:(?:public|private|internal|sealed|fun)\s+)*interface\s+(?P<n>\w+)"), ("enum", r"(?:(?:public|private|internal)\s+)*enum\s+class\s+(?P<n>\w+)"), ("object", r"(?:companion\s+)?object\s+(?P<n>\w+)"), ("function", r"(?:(?:public|private|internal|protected|open|override|suspend|inline|operator|tailrec|infix)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<n>\w+)\s*\("), ("property", r"(?:(?:public|private|internal|protected|override|lateinit|const|open)\s+)*va[lr]\s+(?P<n>\w+)")],
    "c": [("struct", r"(?:typedef\s+)?struct\s+(?P<n>\w+)(?=\s*\{)"), ("enum", r"(?:typedef\s+)?enum\s+(?P<n>\w+)(?=\s*\{)"), ("macro", r"#define\s+(?P<n>\w+)"), ("function", r"(?:(?:static|inline|extern|const|unsigned|signed|struct)\s+)*[A-Za-z_]\w*[\s*]+(?P<n>\w+)\s*\([^;{)]*\)(?=\s*\{)")],
    "prisma": [("model", r"model\s+(?P<n>\w+)"), ("enum", r"enum\s+(?P<n>\w+)"), ("block", r"(?:datasource|generator)\s+(?P<n>\w+)")],
}
_JS = [
    ("class", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<n>[\w$]+)"), ("interface", r"(?:export\s+)?(?:declare\s+)?interface\s+(?P<n>[\w$]+)"), ("enum", r"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>[\w$]+)"),
    ("type", r"(?:export\s+)?(?:declare\s+)?type\s+(?P<n>[\w$]+)\s*(?:<[^=]*>)?\s*="), ("function", r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)"), ("function", r"(?:export\s+)?(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=]*)?=>"),
    ("constant", r"(?:export\s+)?const\s+(?P<n>[\w$]+)"), ("module", r"(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+(?P<n>[\w$.]+)"), ("method", r"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<n>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$#]+)\s*(?:<[^(]*>)?\([^)]*\)\s*(?::[^{;=]*)?(?=\{)"),
]
for _lang in ("javascript", "typescript", "tsx"):
    _DECLARATIONS[_lang] = _JS
for _lang in ("cpp", "csharp"):
    _DECLARATIONS[_lang] = _DECLARATIONS["c"] + [("class", r"(?:(?:public|private|internal|static|sealed|abstract|partial)\s+)*class\s+(?P<n>\w+)"), ("namespace", r"namespace\s+(?P<n>[\w.:]+)")]
_CONTAINERS = frozenset("class interface enum struct trait impl module object record namespace model block".split())
_COMPILED = {lang: [(k, re.compile(r"(?:^|(?<=[{;}]))[ \t]*" + p, re.M)) for k, p in rules] for lang, rules in _DECLARATIONS.items()}
_SKIP = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)'|r(#*)"[\s\S]*?"\1""")


def extract(text: str, language: str) -> list[Symbol]:
    """Symbols in order of their byte range; of several with one range the first kind stands."""
    found = _python(text) if language == "python" else _braces(text, language) if language in _COMPILED else []
    out, seen = [], set()
    for s in sorted(found, key=lambda s: (s.start_byte, s.end_byte)):
        if (s.start_byte, s.end_byte) not in seen:
            seen.add((s.start_byte, s.end_byte))
            out.append(s)
    return out


def _python(text: str) -> list[Symbol]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    raw = text.encode("utf-8", "replace")
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    out: list[Symbol] = []

    def visit(node, scope, inside):
        for child in ast.iter_child_nodes(node):
            kind = name = None
            if isinstance(child, ast.ClassDef):
                kind, name = "class", child.name
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind, name = ("method" if inside == "class" else "function"), child.name
            elif isinstance(child, ast.Assign) and inside != "function" and len(child.targets) == 1 and isinstance(child.targets[0], ast.Name):
                kind, name = ("constant" if child.targets[0].id.isupper() else "variable"), child.targets[0].id
            if kind:
                path = [*scope, name]
                first = min([child.lineno, *[d.lineno for d in getattr(child, "decorator_list", [])]])
                out.append(Symbol(kind, name, ".".join(path), starts[first - 1] + (child.col_offset if first == child.lineno else 0), starts[child.end_lineno - 1] + child.end_col_offset, first, child.end_lineno))
                visit(child, path, "class" if kind == "class" else "function")
            else:
                visit(child, scope, inside)

    visit(tree, [], "module")
    return out


def _braces(text: str, language: str) -> list[Symbol]:
    plain = _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    closes, stack = {}, []
    for i, c in enumerate(plain):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            closes[stack.pop()] = i
    marks = [m.start() for m in re.finditer("[{;]", plain)]
    breaks = [m.start() for m in re.finditer("\n", plain)]
    spans: list[tuple[int, int, str, str]] = []
    taken: set[int] = set()
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(plain):
            if m.start("n") in taken:
                continue
            taken.add(m.start("n"))
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            k = bisect_left(marks, m.end())
            stop = marks[k] if k < len(marks) else len(plain)
            k = bisect_left(breaks, m.end())
            if kind in ("macro", "constant", "variable", "type", "property") and k < len(breaks):
                stop = min(stop, breaks[k])
            if plain[stop : stop + 1] == "{":
                stop = closes.get(stop, len(plain) - 1) + 1
            spans.append((start, min(stop, len(plain)), kind, m.group("n")))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out, open_ = [], []
    sizes = None if text.isascii() else [0]
    if sizes is not None:
        for c in text:
            sizes.append(sizes[-1] + len(c.encode("utf-8", "replace")))
    lines = [i for i, c in enumerate(text) if c == "\n"]
    for a, b, kind, name in spans:
        while open_ and open_[-1][0] <= a:
            open_.pop()
        parent = open_[-1] if open_ else None
        if parent and parent[1] not in _CONTAINERS and kind in ("constant", "variable", "method", "property"):
            continue  # locals
        if kind == "method" and language in ("javascript", "typescript", "tsx") and (not parent or parent[1] != "class"):
            continue
        if kind == "function" and parent and parent[1] in ("impl", "trait", "class", "interface", "object"):
            kind = "method"
        path = f"{parent[2]}.{name}" if parent else name
        byte = (lambda i: i) if sizes is None else sizes.__getitem__
        out.append(Symbol(kind, name, path, byte(a), byte(b), bisect_left(lines, a) + 1, bisect_left(lines, max(a, b - 1)) + 1))
        open_.append((b, kind, path))
    return out


def cut_chunks(text: str, symbols: list[Symbol], target: int = CHUNK_BYTES) -> list[tuple[int, int, str]]:
    """(start line, end line, content): runs of lines of about ``target`` bytes that begin at
    top-level symbols where they can; blank runs are dropped."""
    lines = text.split("\n")
    heads = {s.start_line for s in symbols if "." not in s.qualname}
    out, start, size = [], 1, 0

    def close(end):
        body = "\n".join(lines[start - 1 : end])
        if body.strip():
            out.append((start, end, body))

    for n, line in enumerate(lines, 1):
        width = len(line.encode("utf-8", "replace")) + 1
        if n > start and (size + width > target or n in heads and size > target // 2):
            close(n - 1)
            start, size = n, 0
        size += width
    if start <= len(lines):
        close(len(lines))
    return out


_SYMBOLS = "repo string, rel_path string, language string, kind string, name string, qualname string, start_byte int, end_byte int, start_line int, end_line int"
_CHUNKS = "repo string, file_path string, language string, start_line int, end_line int, content string"


def _readable(raw) -> str | None:
    if raw is None or len(raw) > MAX_BYTES or b"\x00" in raw:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _run(rows_of, names, kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, lang, raw in zip(*(batch[c].to_pylist() for c in ("repo", "rel_path", "language", "content"))):
                text = _readable(raw)
                if text is not None and lang is not None:
                    rows.extend((repo, path, lang, *r) for r in rows_of(text, lang))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return run


def symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of ``files`` (repo, rel_path, language, content); binary, oversize,
    non-UTF-8 and unscannable files give none. Repeated file rows count once."""
    names = ["repo", "rel_path", "language", "kind", "name", "qualname", "start_byte", "end_byte", "start_line", "end_line"]
    kinds = [pa.string()] * 6 + [pa.int32()] * 4
    run = _run(lambda text, lang: [tuple(s) for s in extract(text, lang)], names, kinds)
    return spread(files.select("repo", "rel_path", "language", "content")).mapInArrow(run, _SYMBOLS).distinct()


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of ``files``; unknown languages and files without symbols' languages give none."""
    names = ["repo", "file_path", "language", "start_line", "end_line", "content"]
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()]
    known = frozenset(_COMPILED) | {"python", "json"}
    run = _run(lambda text, lang: cut_chunks(text, extract(text, lang)) if lang in known else [], names, kinds)
    return spread(files.select("repo", "rel_path", "language", "content")).mapInArrow(run, _CHUNKS).distinct()


def resolve_qualname(table: DataFrame, wanted: str) -> DataFrame:
    """Rows whose qualname is ``wanted``; only without such a row, those that end in it."""
    exact = F.col("qualname") == wanted
    hit = table.where(exact | F.endswith("qualname", F.lit("." + wanted))).withColumn("_exact", exact)
    any_exact = hit.agg(F.max("_exact").alias("any"))
    return hit.crossJoin(F.broadcast(any_exact)).where(F.col("_exact") | ~F.col("any")).drop("_exact", "any")


def suggest(names: DataFrame, wanted: str, column: str = "qualname", k: int = 5) -> DataFrame:
    """(rank, name): names that contain ``wanted``, in order; else the nearest by edit distance."""
    from pyspark.sql import Window

    low, w = F.lower(F.col(column)), wanted.lower()
    leaf = F.substring_index(low, ".", -1)
    distance = F.least(F.levenshtein(low, F.lit(w)), F.levenshtein(leaf, F.lit(w)))
    rows = names.select(F.col(column).alias("name"), F.contains(low, F.lit(w)).alias("_in"), distance.alias("_d"), F.length(leaf).alias("_n")).distinct()
    some = rows.agg(F.coalesce(F.max("_in"), F.lit(False)).alias("_some"))
    rows = rows.crossJoin(F.broadcast(some)).where(F.col("_in") | ~F.col("_some"))
    similar = 1 - F.col("_d") / F.greatest(F.col("_n"), F.lit(len(w)), F.lit(1))
    order = [F.when(F.col("_some"), 0).otherwise(F.col("_d")), F.when(F.col("_some"), 0.0).otherwise(-similar), F.col("name")]
    best = rows.orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "name")
