"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators.scale import spread

TOKENIZER = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 50_000  # characters encoded at once; texts are cut at white space only

_loaded: dict = {}


def encoding(path: str = TOKENIZER):
    """The vocabulary of ``path`` (token ranks), loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str, enc) -> int:
    """Tokens of the whole text. Long texts are encoded piece by piece, so that runs without
    white space do not slow the merges down; a cut before a single space changes no token."""
    total, at = 0, 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            while cut > at and text[cut - 1].isspace():
                cut -= 1
            end = cut if cut > at else end
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def with_sizes(documents: DataFrame, text: str = "text", size: str = "tokens", path: str | None = None) -> DataFrame:
    """``documents`` without ``text`` but with its size; null texts have size 0. The vocabulary is
    ``path``, else the session's setting ``stratalith.tokenizer``, else TOKENIZER."""
    path = path or documents.sparkSession.conf.get("stratalith.tokenizer", TOKENIZER)
    keep = [c for c in documents.columns if c not in (text, size)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in keep), f"`{size}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            sizes = [count_tokens(t, enc) if t else 0 for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(sizes, pa.int64())], [*keep, size])

    return spread(documents.select(*keep, F.col(text))).mapInArrow(run, schema)
