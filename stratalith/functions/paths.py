"""Path predicates and path words as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalith.functions.text import STOPWORDS, split_identifier, tokenize

# How tests, compatibility code, examples and type declarations are recognised.
TEST_FILE = (
    r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?"
    r"|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala"
    r"|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$"
)
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIR = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLES_DIR = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
TYPE_DEFS = r"\.d\.ts$"
DOCS = r"(?:^|/)docs?/|(?:readme\.md|changelog\.md|contributing\.md|license)$"
VENDOR = r"(?:^|/)(?:vendor|third_party)/"
GENERATED = r"generated|/gen/|\.pb\.go$"
PUBLIC_STEMS = ["api", "public", "index", "mod", "lib"]

_FLAGS = {"test": f"{TEST_FILE}|{TEST_DIR}", "docs": DOCS, "vendor": VENDOR, "generated": GENERATED, "compat": COMPAT_DIR, "examples": EXAMPLES_DIR, "types": TYPE_DEFS}


def normal(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def is_kind(path: Column, kind: str) -> Column:
    """Does the lower-case path belong to ``kind`` (test, docs, vendor, generated, ...)?"""
    return normal(path).rlike(_FLAGS[kind])


def kind_pattern(kind: str) -> str:
    return _FLAGS[kind]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension, lower-case; ``.env`` keeps its name."""
    return F.lower(F.regexp_extract(file_name(path), r"^(.+?)(?:\.[^.]*)?$", 1))


def last_dirs(path: Column, n: int = 3) -> Column:
    """Up to ``n`` folders above the file, outermost first."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.slice(dirs, F.greatest(F.size(dirs) - n + 1, F.lit(1)), n)


def path_words(path: Column) -> Column:
    """Distinct tokens of the path and of its stem, without one-letter and empty words."""
    words = F.concat(tokenize(path), split_identifier(stem(path)))
    keep = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
    return F.array_distinct(keep)


def word_matches(keyword: Column, word: Column) -> Column:
    """Equal, equal without plural s, or one the beginning of the other from three letters on."""
    a, b = F.regexp_replace(keyword, "s+$", ""), F.regexp_replace(word, "s+$", "")
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (keyword == word) | (a == b) | ((F.length(shorter) >= 3) & F.startswith(longer, shorter))


def match_count(keywords: list[str], words: Column) -> Column:
    """How many keywords match some path word."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.when(F.exists(words, lambda w: word_matches(F.lit(k), w)), 1).otherwise(0)
    return total


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regex: ``*`` and ``?`` stay within a folder, ``**`` crosses folders."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 3] == "**/":
                out += "(?:.*/)?"
                i += 3
                continue
            if pattern[i : i + 2] == "**":
                out += ".*"
                i += 2
                continue
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            end = pattern.find("}", i)
            if end < 0:
                raise ValueError(f"unclosed braces in glob {pattern!r}")
            out += "(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def exclude_regex(pattern: str) -> list[str]:
    """A bare name shuts out the file, the folder and everything below, wherever it is."""
    pattern = pattern.rstrip("/")
    if any(c in pattern for c in "*?[{/"):
        return [glob_regex(pattern)]
    return [glob_regex(p) for p in (f"{pattern}/**", f"**/{pattern}/**", pattern, f"**/{pattern}")]


def matches_any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def include(path: Column, globs: list[str] | None) -> Column:
    """No globs include everything."""
    return matches_any(path, [glob_regex(g) for g in globs]) if globs else F.lit(True)


def exclude(path: Column, globs: list[str] | None) -> Column:
    return ~matches_any(path, [r for g in globs or [] for r in exclude_regex(g)])


def under(path: Column, prefixes: list[str]) -> Column:
    """The path is one of ``prefixes`` or lies below one; an empty prefix is everything."""
    cond = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        cond = cond | ((path == p) | F.startswith(path, F.lit(p + "/")) if p else F.lit(True))
    return cond


def top_dir(path: Column) -> Column:
    """First folder, or '' for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def valid_relative(path: str) -> str:
    """Checks a path given by a user: not empty, not absolute, no way up."""
    parts = path.replace("\\", "/").split("/")
    if not path.strip() or path.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", path) or ".." in parts:
        raise ValueError(f"not a path within the repository: {path!r}")
    return "/".join(p for p in parts if p not in ("", "."))
