"""Routes, layouts, methods and server actions of a file-routed web framework."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File stems and extensions with a meaning, and the order of verbs.
SOURCES = ["js", "jsx", "ts", "tsx"]
LAYOUTS = ["layout", "template", "loading", "error", "not-found", "default", "global-error"]
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.(?:jsx?|tsx?)$", 1)


def _pattern(folder: Column) -> Column:
    parts = F.filter(F.split(folder, "/"), lambda p: (p != "") & ~p.rlike(r"^\((?!\.).*\)$") & ~F.startswith(p, F.lit("@")))
    plain = F.transform(parts, lambda p: F.regexp_replace(p, r"^(?:\(\.{1,3}\))+", ""))
    return F.concat(F.lit("/"), F.array_join(F.filter(plain, lambda p: p != ""), "/"))


def _advanced(folder: Column) -> Column:
    return F.exists(F.split(folder, "/"), lambda p: F.startswith(p, F.lit("@")) | p.rlike(r"^\(\.{1,3}\)"))


def _private(folder: Column) -> Column:
    return F.exists(F.split(folder, "/"), lambda p: F.startswith(p, F.lit("_")))


def _split_root(files: DataFrame, router: str, root: str) -> DataFrame:
    """Rows below ``<root>/(src/)<router>/`` with ``inner``, the path within the router."""
    base = (root.strip("/") + "/") if root.strip("/") else ""
    rx = "^" + re.escape(base)
    inner = F.regexp_extract("path", rx + rf"(?:src/)?{router}/(.+)$", 1)
    return files.withColumn("inner", inner).where(F.col("inner") != "")


def app_routes(files: DataFrame, root: str = "") -> DataFrame:
    """(pattern, file, kind, router, advanced) of page and route files; private folders hold none."""
    rows = _split_root(files, "app", root)
    folder = F.regexp_replace(F.regexp_extract("inner", r"^(.*/)?[^/]+$", 1), "/$", "")
    rows = rows.withColumn("stem", _stem(F.col("inner"))).withColumn("folder", folder)
    rows = rows.where(F.col("stem").isin("page", "route") & ~_private(F.col("folder")))
    kind = F.when(F.col("stem") == "page", "page").otherwise("api")
    return rows.select(_pattern(F.col("folder")).alias("pattern"), F.col("path").alias("file"), kind.alias("kind"), F.lit("app").alias("router"), _advanced(F.col("folder")).alias("advanced"))


def pages_routes(files: DataFrame, root: str = "") -> DataFrame:
    """The same of the older router: special files drop out, ``index`` folds into its folder."""
    rows = _split_root(files, "pages", root)
    bare = F.regexp_extract("inner", r"^(.+)\.(?:jsx?|tsx?)$", 1)
    rows = rows.withColumn("bare", bare).where(F.col("bare") != "")
    special = F.col("bare").rlike(r"(?:^|/)_[^/]*$") | F.col("bare").isin("404", "500")
    rows = rows.where(~special)
    folded = F.regexp_replace("bare", r"(?:^|/)index$", "")
    kind = F.when(F.col("bare").rlike("^api(?:/|$)"), "api").otherwise("page")
    return rows.select(F.concat(F.lit("/"), folded).alias("pattern"), F.col("path").alias("file"), kind.alias("kind"), F.lit("pages").alias("router"), F.lit(False).alias("advanced"))


def routes(files: DataFrame, root: str = "") -> DataFrame:
    return app_routes(files, root).unionByName(pages_routes(files, root)).orderBy("pattern", "file")


def layouts(files: DataFrame, root: str = "") -> DataFrame:
    """(kind, file, scope) of the special files of the app router."""
    rows = _split_root(files, "app", root)
    folder = F.regexp_replace(F.regexp_extract("inner", r"^(.*/)?[^/]+$", 1), "/$", "")
    rows = rows.withColumn("kind", _stem(F.col("inner"))).withColumn("folder", folder).where(F.col("kind").isin(LAYOUTS))
    return rows.select("kind", F.col("path").alias("file"), _pattern(F.col("folder")).alias("scope")).orderBy("scope", "kind", "file")


def methods(source: Column) -> Column:
    """Exported HTTP verbs of a route file, in verb order."""
    verb = "(" + "|".join(VERBS) + ")"
    declared = F.regexp_extract_all(source, F.lit(rf"export\s+(?:async\s+)?(?:function\s*\*?|const|let|var)\s+{verb}\b"), F.lit(1))
    lists = F.regexp_extract_all(source, F.lit(r"export\s*\{([^}]*)\}"), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda p: F.trim(F.regexp_replace(p, r"^.*\sas\s", "")))))
    found = F.concat(declared, names)
    return F.filter(F.array(*[F.lit(v) for v in VERBS]), lambda v: F.array_contains(found, v))


def server_actions(files: DataFrame, text: str = "text") -> DataFrame:
    """(file, name, scope): exported functions of files that begin with the directive, else the
    functions whose body begins with it. The substring test comes first and prunes most files."""
    rows = files.where(F.contains(F.col(text), F.lit("use server")))
    code = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    rows = rows.withColumn("code", code)
    whole = F.col("code").rlike(r"""^\s*(?:['"]use strict['"];?\s*)?['"]use server['"]""")
    exported = F.regexp_extract_all("code", F.lit(r"export\s+(?:default\s+)?(?:async\s+)?function\s*([A-Za-z_$][\w$]*)"), F.lit(1))
    bound = F.regexp_extract_all("code", F.lit(r"export\s+const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*async\b"), F.lit(1))
    # an export list counts where the local name before "as" is a function of the file
    local = F.concat(
        F.regexp_extract_all("code", F.lit(r"(?:^|\s)async\s+function\s*\*?\s*([A-Za-z_$][\w$]*)"), F.lit(1)),
        F.regexp_extract_all("code", F.lit(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*async\b"), F.lit(1)),
    )
    items = F.flatten(F.transform(F.regexp_extract_all("code", F.lit(r"export\s*\{([^}]*)\}"), F.lit(1)), lambda x: F.split(x, ",")))
    kept = F.filter(items, lambda p: F.array_contains(local, F.trim(F.regexp_replace(p, r"\sas\s.*$", ""))))
    listed = F.transform(kept, lambda p: F.trim(F.regexp_replace(p, r"^.*\sas\s", "")))
    unnamed = F.when(F.col("code").rlike(r"export\s+default\s+(?:async\s+)?(?:function\s*\(|\(|async)"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    of_file = F.array_distinct(F.filter(F.concat(exported, bound, listed, unnamed), lambda n: n != ""))
    of_file = F.when(F.size(of_file) == 0, F.array(F.lit("*"))).otherwise(of_file)
    inner = F.regexp_extract_all("code", F.lit(r"""(?:async\s+function\s+([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::[^{]*)?)\{\s*['"]use server['"]"""), F.lit(1))
    arrows = F.regexp_extract_all("code", F.lit(r"""(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*async\s*(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^={]*)?=>\s*\{\s*['"]use server['"]"""), F.lit(1))
    named = F.when(whole, of_file).otherwise(F.array_distinct(F.concat(inner, arrows)))
    return rows.select(F.col("path").alias("file"), F.explode(named).alias("name"), F.when(whole, "file").otherwise("function").alias("scope")).orderBy("file", "name")


def detect(files: DataFrame, root: str = "", text: str = "text") -> DataFrame:
    """(version, app, pages, src): the framework's version in package.json and which routers exist."""
    base = root.strip("/")
    manifest = F.col("path") == ((base + "/") if base else "") + "package.json"
    version = F.coalesce(*[F.get_json_object(text, f"$.{s}.next") for s in ("dependencies", "devDependencies", "peerDependencies")])
    below = lambda r: F.col("path").rlike("^" + ((base + "/") if base else "").replace(".", "\\.") + r)
    return files.agg(
        F.max(F.when(manifest, version)).alias("version"), F.coalesce(F.max(below(r"(?:src/)?app/")), F.lit(False)).alias("app"),
        F.coalesce(F.max(below(r"(?:src/)?pages/")), F.lit(False)).alias("pages"), F.coalesce(F.max(below(r"src/(?:app|pages)/")), F.lit(False)).alias("src"),
    )
