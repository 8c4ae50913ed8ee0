"""Plain text of small results: deterministic lines, no colour."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table(df: DataFrame, columns: list[str] | None = None, limit: int = 2_000) -> str:
    """Rows as tab-separated lines under their names; at most ``limit`` and a note of the rest."""
    columns = columns or df.columns
    rows = df.select(*columns).limit(limit + 1).collect()
    lines = ["\t".join(columns)] + ["\t".join("" if v is None else str(v) for v in r) for r in rows[:limit]]
    return "\n".join(lines + (["..."] if len(rows) > limit else []))


def hits(df: DataFrame) -> str:
    return "\n".join(f"{r['rank']}. {r['file_path']}:{r['start_line']}-{r['end_line']} ({r['score']:.4f}) {r['snippet'] or ''}".rstrip() for r in df.collect())


def matches(df: DataFrame, summary: DataFrame) -> str:
    """``path:position qualname(kind)`` per match, then what the scan left out."""
    out = []
    for r in df.collect():
        out.append(f"{r['path']}:{r['start_byte']} {r['qualname']}({r['kind']})" + (f"  +{r['more_in_file']} more in file" if r["more_in_file"] else ""))
    s = summary.first()
    if s["truncated"]:
        out.append(f"stopped after {s['searched']} files" + (f"; not sampled: {', '.join(s['unsampled'])}" if s["unsampled"] else ""))
    return "\n".join(out)


def drilldown(found: dict) -> str:
    """``@@ a-b symbol(kind) +x -y`` and the body of every hunk, file by file."""
    out, last = [], None
    for r in found["hunks"].toLocalIterator():
        if r["path"] != last:
            last = r["path"]
            out.append(last)
        named = f" {r['symbol']}({r['kind']})" if r["symbol"] else ""
        out.append(f"@@ {r['new_lo']}-{r['new_hi']}{named} +{r['added']} -{r['removed']}")
        if r["body"]:
            out.append(r["body"])
    return "\n".join(out + ([found["note"]] if found["note"] else []))


def outline(found: dict) -> str:
    """Symbols indented by their depth."""
    out = [found["path"]]
    for r in found["symbols"].toLocalIterator():
        out.append(f"{'  ' * (r['qualname'].count('.') + 1)}{r['start_line']}-{r['end_line']} {r['kind']} {r['qualname'].rsplit('.', 1)[-1]}")
    return "\n".join(out)


def languages(df: DataFrame) -> str:
    """Files and code lines per language, with their sum."""
    rows = df.collect()  # one row per language
    out = [f"{r['language']}: {r['files']} files, {r['code']} code, {r['comment']} comment, {r['blank']} blank" for r in rows]
    return "\n".join(out + [f"total: {sum(r['files'] for r in rows)} files, {sum(r['code'] for r in rows)} code"])


def routes(df: DataFrame) -> str:
    out = []
    for r in df.toLocalIterator():
        verbs = f" [{', '.join(r['methods'])}]" if r["methods"] else ""
        out.append(f"{r['pattern']} {r['kind']}{verbs} {r['file']}" + (" (advanced)" if r["advanced"] else ""))
    return "\n".join(out)


def overview(df: DataFrame) -> str:
    """``M path +a -r`` per change; binary files have no counts."""
    out = []
    for r in df.toLocalIterator():
        name = f"{r['old_path']} -> {r['path']}" if r["old_path"] else r["path"]
        count = "binary" if r["binary"] else f"+{r['added'] or 0} -{r['removed'] or 0}"
        out.append(f"{r['status']} {name} {count}")
    return "\n".join(out)
