"""Source files that do not parse, with rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators.scale import spread

_SCHEMA = "file_id bigint, repo string, rel_path string, checked_as string, valid boolean, reason string, line int"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from stratalith.llm.syntax.check import check, language_of

    for batch in batches:
        langs, valid, reasons, lines = [], [], [], []
        for path, content in zip(batch["rel_path"].to_pylist(), batch["content"]):
            lang = language_of(path)
            raw = content.as_py()
            if lang is None or raw is None:
                verdict, line = (None, None, None), None
            else:
                text = raw.decode("utf-8", "replace")
                verdict = check(text, lang)
                line = None if verdict[2] is None else text.count("\n", 0, verdict[2]) + 1
            langs.append(lang)
            valid.append(verdict[0])
            reasons.append(verdict[1])
            lines.append(line)
        yield pa.RecordBatch.from_arrays(
            [batch["file_id"], batch["repo"], batch["rel_path"], pa.array(langs, pa.string()), pa.array(valid, pa.bool_()),
             pa.array(reasons, pa.string()), pa.array(lines, pa.int32())],
            ["file_id", "repo", "rel_path", "checked_as", "valid", "reason", "line"],
        )


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, checked_as, valid, reason, line), one row per distinct file row.

    The language is that of the file extension; the language column may be null or wrong and is
    not read. ``valid`` is null where the extension is unknown or path or content is null. An
    empty file is valid except in JSON. ``reason`` is ``token`` where the derivative by a token is
    empty (``line`` is its line) and ``truncated`` where the text ends in a state that is not
    nullable, or inside a text or comment. Bytes that are not UTF-8 count as U+FFFD, which is
    valid only in texts and comments. Repeated rows count once; extra columns are ignored.

    One narrow pass in Arrow batches; the derivative tables stay in the Python worker between
    batches, and only the small verdict rows are shuffled.
    """
    columns = [F.col("file_id").cast("bigint"), "repo", "rel_path", F.col("content").cast("binary")]
    return spread(files.select(*columns)).mapInArrow(_verdicts, _SCHEMA).distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repo, checked_as, files, invalid, truncated, rate) over the files that could be checked."""
    bad = ~F.col("valid")
    return (
        syntax_verdicts(files)
        .where(F.col("valid").isNotNull())
        .groupBy("repo", "checked_as")
        .agg(
            F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("invalid"),
            F.count_if(F.col("reason") == "truncated").alias("truncated"),
        )
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
