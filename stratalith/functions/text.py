"""Identifier tokens as Spark expressions, and the same rules for one string on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
# Words that carry no meaning in a query.
STOPWORDS = "a an and are as at be by do does for from has have how if in is it not of on or the to was what when where which who why with".split()
# Places where a name in capitals and small letters is cut (before, after).
CUTS = (("([a-z])([A-Z0-9])"), ("([0-9])([a-zA-Z])"), ("([A-Z])([A-Z][a-z])"))


def split_identifier(token: Column) -> Column:
    """[lower form, parts...]; parts only where there are two or more."""
    spaced = token
    for cut in CUTS:
        spaced = F.regexp_replace(spaced, cut, "$1 $2")
    lower = F.lower(token)
    parts = F.when(F.contains(token, F.lit("_")), F.filter(F.split(lower, "_"), lambda p: p != "")).otherwise(F.split(F.lower(spaced), " "))
    return F.when(F.size(parts) >= 2, F.concat(F.array(lower), parts)).otherwise(F.array(lower))


def tokenize(text: Column) -> Column:
    """All identifier tokens in order, with repeats; null gives null."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), split_identifier))


def split_identifier_str(token: str) -> list[str]:
    lower = token.lower()
    if "_" in token:
        parts = [p for p in lower.split("_") if p]
    else:
        spaced = token
        for cut in CUTS:
            spaced = re.sub(cut, r"\1 \2", spaced)
        parts = spaced.lower().split(" ")
    return [lower, *parts] if len(parts) >= 2 else [lower]


def tokenize_str(text: str) -> list[str]:
    return [p for m in re.findall(IDENTIFIER, text) for p in split_identifier_str(m)]


def tokenize_sql(expr: str) -> str:
    """``tokenize`` in DuckDB's SQL."""
    spaced = "t"
    for cut in CUTS:
        spaced = rf"regexp_replace({spaced}, '{cut}', '\1 \2', 'g')"
    parts = f"(CASE WHEN contains(t, '_') THEN list_filter(string_split(lower(t), '_'), lambda p: p <> '') ELSE string_split(lower({spaced}), ' ') END)"
    one = f"(CASE WHEN len({parts}) >= 2 THEN list_concat([lower(t)], {parts}) ELSE [lower(t)] END)"
    return f"flatten(list_transform(regexp_extract_all({expr}, '{IDENTIFIER}'), lambda t: {one}))"
