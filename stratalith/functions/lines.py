"""Languages of paths, comment rules, and the counter of blank, comment and code lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Rules(NamedTuple):
    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    nested: bool = False


_SLASH = Rules(("//",), ("/*", "*/"))
_NEST = Rules(("//",), ("/*", "*/"), True)
_HASH = Rules(("#",))
# Comment rules by language.
RULES: dict[str, Rules] = (
    dict.fromkeys("rust kotlin swift scala dart".split(), _NEST)
    | dict.fromkeys("typescript tsx prisma go java javascript php c cpp csharp zig".split(), _SLASH)
    | dict.fromkeys("css scss sass less".split(), Rules((), ("/*", "*/")))
    | dict.fromkeys("python yaml toml bash shell dockerfile ruby elixir make".split(), _HASH)
    | {"sql": Rules(("--",), ("/*", "*/")), "lua": Rules(("--",), ("--[[", "]]")), "haskell": Rules(("--",), ("{-", "-}"), True)}
    | dict.fromkeys(("html", "xml"), Rules((), ("<!--", "-->")))
)
# Languages by file extension.
EXTENSIONS = {
    "py": "python", "pyi": "python", "rs": "rust", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "swift": "swift", "scala": "scala", "dart": "dart", "ex": "elixir", "exs": "elixir", "lua": "lua", "hs": "haskell", "zig": "zig", "sql": "sql", "css": "css", "scss": "scss", "less": "less",
    "html": "html", "htm": "html", "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sh": "bash", "bash": "bash", "md": "markdown", "prisma": "prisma",
}
NAMES = {"dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "make"}


def detect(path: Column) -> Column:
    """Language of a path, or null; .txt, .text and .log never have one."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    special = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(special[name], F.when(ext.isin("txt", "text", "log"), None).otherwise(table[ext]))


def count_lines(text: str, language: str | None) -> tuple[int, int, int]:
    """(total, blank, comment). A line with code and a comment is code, white space only is blank
    even inside a comment; texts in double quotes may span lines, those in single quotes not. A
    last line without line end counts."""
    rules = RULES.get(language or "", Rules())
    total = blank = comment = 0
    depth, quoted = 0, False
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for line in lines:
        total += 1
        if not line.strip():
            blank += 1
            continue
        i, n, code, noted = 0, len(line), False, depth > 0
        while i < n:
            if depth:
                opener, closer = rules.block
                if line.startswith(closer, i):
                    depth -= 1
                    i += len(closer)
                elif rules.nested and line.startswith(opener, i):
                    depth += 1
                    i += len(opener)
                else:
                    i += 1
                noted = True
                continue
            c = line[i]
            if quoted:
                code = True
                if c == "\\":
                    i += 2
                    continue
                quoted = c != '"'
                i += 1
                continue
            if rules.block and line.startswith(rules.block[0], i):
                depth, noted = 1, True
                i += len(rules.block[0])
                continue
            if any(line.startswith(m, i) for m in rules.line):
                noted = True
                break
            if c == '"' and (rules.line or rules.block):
                quoted = code = True
            elif c == "'":
                end = _char_end(line, i)
                code = True
                i = end
                continue
            elif not c.isspace():
                code = True
            i += 1
        comment += noted and not code
    return total, blank, comment


def _char_end(line: str, i: int) -> int:
    """Behind a closed literal in single quotes on this line, else one further (lifetimes, prose)."""
    j = i + 1
    while j < len(line):
        if line[j] == "\\":
            j += 2
            continue
        if line[j] == "'":
            return j + 1
        j += 1
    return i + 1


_STATS = StructType([StructField(n, IntegerType()) for n in ("total", "blank", "comment")])


def _count_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, languages in batches:
        rows = [(None, None, None) if t is None else count_lines(bytes(t).decode("utf-8", "replace"), lang) for t, lang in zip(texts, languages)]
        yield pd.DataFrame(rows, columns=["total", "blank", "comment"]).astype("Int32")


def line_stats(content: Column | str, language: Column | str) -> Column:
    """Struct of total, blank and comment lines, counted in Arrow batches; null content gives nulls."""
    return F.pandas_udf(_count_batches, _STATS)(content, language)
