"""Source trees: ignore rules decide on the driver which paths exist, Spark reads their contents."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import lines, paths

MAX_BYTES = 1 << 20
_FILES = "rel_path string, full_path string, length bigint, mtime_ns bigint"


def _rules(folder: str, name: str = ".gitignore") -> list[tuple[bool, bool, re.Pattern]]:
    """(negated, folders only, pattern relative to ``folder``) of an ignore file."""
    try:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            text = f.read()
    except OSError:
        return []
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!")
        only, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        rx = paths.glob_regex(line if anchored else f"**/{line}")
        out.append((negated, only, re.compile(rx)))
    return out


def walk(root: str, hidden: bool = False, ignored: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """(relative path, full path, size, mtime in ns) of regular files that no rule ignores; links
    are not followed, hidden entries skipped."""
    root = os.path.realpath(root)
    first = [] if ignored else [("", _rules(os.path.join(root, ".git", "info"), "exclude"))]

    def visit(folder: str, rel: str, rules):
        here = rules if ignored else [*rules, (rel, _rules(folder))]
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                if (e.name.startswith(".") and not hidden) or e.is_symlink() or e.name == ".git":
                    continue
                path = f"{rel}{e.name}"
                drop = False
                for base, lines_ in here:
                    for negated, only, rx in lines_:
                        if (not only or e.is_dir()) and rx.match(path[len(base):]):
                            drop = not negated
                if drop:
                    continue
                if e.is_dir():
                    yield from visit(e.path, path + "/", here)
                elif e.is_file():
                    s = e.stat()
                    yield path, e.path, s.st_size, s.st_mtime_ns

    yield from visit(root, "", first)


def catalogue(spark: SparkSession, root: str, starts: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Metadata of the visible files, once each; if nothing is visible, of all files. ``starts`` are
    paths the files must lie below, ``exclude`` globs or folder names they must not match."""
    rows = list(walk(root)) or list(walk(root, hidden=True, ignored=True))
    df = spark.createDataFrame(rows, _FILES)
    df = df.where(paths.exclude(F.col("rel_path"), list(exclude))) if exclude else df
    return df.where(paths.under(F.col("rel_path"), [paths.valid_relative(s) for s in starts])) if starts else df


def files(spark: SparkSession, root: str, starts: Sequence[str] = (), repo: str = "", exclude: Sequence[str] = ()) -> DataFrame:
    """(repo, rel_path, language, length, mtime_ns, content) of visible files up to 1 MiB; contents
    are read by the executors' binary file source, only for the listed paths."""
    listed = catalogue(spark, root, starts, exclude).where(F.col("length") <= MAX_BYTES)
    full = [r["full_path"] for r in listed.select("full_path").collect()]
    if not full:
        return spark.createDataFrame([], "repo string, rel_path string, language string, length bigint, mtime_ns bigint, content binary")
    raw = spark.read.format("binaryFile").load([f"file://{p}" for p in full]).select(F.regexp_replace("path", "^file:/*", "/").alias("full_path"), "content")
    return listed.join(raw, "full_path").select(F.lit(repo).alias("repo"), "rel_path", lines.detect(F.col("rel_path")).alias("language"), "length", "mtime_ns", "content")


def guarded_text(content) -> tuple:
    """(text, problem) columns: null text with ``too large``, ``binary`` or ``not utf-8``."""
    size = F.octet_length(content)
    problem = (
        F.when(size > MAX_BYTES, "too large").when(F.position(F.lit("\x00"), content.cast("string")) > 0, "binary").when(~F.is_valid_utf8(content.cast("string")), "not utf-8")
    )
    return F.when(problem.isNull(), F.decode(content, "UTF-8")), problem


def git(root: str, *args: str) -> str:
    """Output of one git command; errors become ValueError with git's first line."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=120)
    if done.returncode not in (0, 1) or done.returncode == 1 and done.stderr:
        said = done.stderr.decode("utf-8", "replace").strip().splitlines()
        raise ValueError(said[0] if said else f"git ended with {done.returncode}")
    return done.stdout.decode("utf-8", "replace")


def valid_ref(ref: str) -> str:
    if not ref or ref.startswith("-") or ".." in ref or re.search(r"[\x00-\x20\x7f]", ref):
        raise ValueError(f"not a ref: {ref!r}")
    return ref


def blobs(spark: SparkSession, root: str, ref: str, names: Sequence[str]) -> DataFrame:
    """(repo, rel_path, language, length, mtime_ns, content) of files as they are in ``ref``, read by
    one ``cat-file`` for all names; names that are not there are left out."""
    ask = "".join(f"{valid_ref(ref)}:{n}\n" for n in names if "\n" not in n).encode()
    done = subprocess.run(["git", "-C", root, "cat-file", "--batch"], input=ask, capture_output=True, timeout=120)
    out, at, rows = done.stdout, 0, []
    for n in (n for n in names if "\n" not in n):
        end = out.find(b"\n", at)
        head = out[at:end].decode("utf-8", "replace").rsplit(" ", 2)
        at = end + 1
        if len(head) == 3 and head[1] == "blob":
            size = int(head[2])
            rows.append(("", n, size, 0, bytearray(out[at : at + size])))
            at += size + 1
    df = spark.createDataFrame(rows, "repo string, rel_path string, length bigint, mtime_ns bigint, content binary")
    return df.select("repo", "rel_path", lines.detect(F.col("rel_path")).alias("language"), "length", "mtime_ns", "content")


def diff_args(scope: str, against: str = "HEAD") -> list[str]:
    """What to compare for ``all``, ``staged`` or ``unstaged`` changes; untracked files are compared
    with nothing, so ``untracked`` compares HEAD with itself."""
    known = {"all": [valid_ref(against)], "staged": ["--cached", valid_ref(against)], "unstaged": [], "untracked": ["HEAD", "HEAD"]}
    if scope not in known:
        raise ValueError(f"unknown scope {scope!r}")
    return known[scope]


def change_set(spark: SparkSession, root: str, scope: str = "all", against: str = "HEAD") -> dict[str, DataFrame]:
    """name_status, numstat and hunks of a working tree as DataFrames."""
    from stratalith.operators import changes as c

    args = diff_args(scope, against)
    return {
        "name_status": c.table_of(spark, c.parse_name_status(git(root, "diff", "--name-status", "-z", "-M", *args)), c.NAME_STATUS),
        "numstat": c.table_of(spark, c.parse_numstat(git(root, "diff", "--numstat", "-z", "-M", *args)), c.NUMSTAT),
        "hunks": c.table_of(spark, c.parse_unified(git(root, "diff", "-U0", "-M", "--no-color", *args)), c.HUNKS),
        "untracked": c.table_of(spark, [(p,) for p in git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p], "path string"),
    }
