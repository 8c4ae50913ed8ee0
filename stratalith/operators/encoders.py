"""Encoders: one seam for all ways from a text to a sparse unit vector (key, idx, value).

``HashingEncoder`` needs no model. ``StaticEncoder`` takes a vocabulary and a table of token vectors
(supplied as DataFrames, never downloaded): WordPiece ids, pooled by their weighted mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.operators import dense
from stratalith.operators.scale import spread

UNKNOWN, CONTINUED = "[UNK]", "##"
WORD_CHARS = 100  # longer words are unknown
TOKENS = 512  # tokens of a text that are pooled, and times the median token length its characters
VOCABULARY = 1_000_000  # entries (of some 20 bytes) that may be sent to the executors
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


class Encoder(Protocol):
    dim: int

    def fingerprint(self) -> str:
        """Tells stored vectors of this encoder from those of any other."""

    def encode(self, texts: DataFrame, key: str, text: Column) -> DataFrame:
        """(key, idx, value) of the texts; texts without known tokens have no rows."""


@dataclass
class HashingEncoder:
    dim: int = 256

    def fingerprint(self) -> str:
        return f"hashing-{self.dim}"

    def encode(self, texts: DataFrame, key: str, text: Column) -> DataFrame:
        return dense.hash_vectors(texts, key, text, self.dim)


@dataclass
class StaticEncoder:
    """``vocabulary`` (token, id), ``vectors`` (id, vector), and ``weights`` (id, weight) or None."""

    vocabulary: DataFrame
    vectors: DataFrame
    dim: int
    weights: DataFrame | None = None

    def fingerprint(self) -> str:
        """Hash of all entries; sums do not depend on their order."""
        parts = [self.vocabulary.select(F.xxhash64("token", "id").alias("h")), self.vectors.select(F.xxhash64("id", "vector").alias("h"))]
        if self.weights is not None:
            parts.append(self.weights.select(F.xxhash64("id", "weight").alias("h")))
        sums = [str(p.agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0] or 0) for p in parts]
        return f"static-{self.dim}-" + "-".join(sums)

    def encode(self, texts: DataFrame, key: str, text: Column) -> DataFrame:
        short = F.left(text, F.lit(TOKENS * median_token_bytes(self.vocabulary)))
        return pooled(wordpiece(texts, key, short, self.vocabulary), key, self.vectors, self.weights)


def load_static(spark: SparkSession, folder: str) -> StaticEncoder:
    """An encoder from ``folder``: vocab.txt (a token a line, its id the line number from 0), vectors
    (Parquet: id, vector) and, if it is there, weights (Parquet: id, weight)."""
    lines = spark.read.text(f"{folder}/vocab.txt", wholetext=True).first()["value"].split("\n")
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate(lines) if t], "token string, id int")
    vectors = spark.read.parquet(f"{folder}/vectors")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/weights")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    dim = len(vectors.select("vector").first()["vector"])
    return StaticEncoder(vocabulary, vectors, dim, spark.read.parquet(f"{folder}/weights") if there else None)


def pieces(word: str, known: dict[str, int], unknown: int | None) -> list[int]:
    """Ids of the longest known piece at each place; a word with a gap, or of more than WORD_CHARS
    characters, is unknown as a whole."""
    out, at = [], 0
    while at < len(word) and len(word) <= WORD_CHARS:
        lead = CONTINUED if at else ""
        for end in range(len(word), at, -1):
            found = known.get(lead + word[at:end])
            if found is not None:
                break
        else:
            break
        out.append(found)
        at = end
    if at == len(word):
        return out
    return [] if unknown is None else [unknown]


def wordpiece(texts: DataFrame, key: str, text: Column, vocabulary: DataFrame) -> DataFrame:
    """(key, pos, id): the tokens of every lower-cased text in order, unknown ones included.

    Words are cut by an expression in the JVM; the pieces of a word are found once per worker."""
    rows = vocabulary.select("token", "id").limit(VOCABULARY + 1).collect()
    if len(rows) > VOCABULARY:
        raise ValueError(f"a vocabulary of more than {VOCABULARY} entries")
    shared = texts.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        unknown = known.get(UNKNOWN)
        seen: dict[str, list[int]] = {}
        for batch in batches:
            ids = []
            for words in batch["words"].to_pylist():
                line: list[int] = []
                for w in words or ():
                    p = seen.get(w)
                    if p is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        p = seen[w] = pieces(w, known, unknown)
                    line.extend(p)
                ids.append(line)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = texts.schema[key].dataType.simpleString()
    worded = spread(texts.select(key, text.alias("_text"))).select(key, F.regexp_extract_all(F.lower("_text"), F.lit(WORD), F.lit(0)).alias("words"))
    return worded.mapInArrow(run, f"`{key}` {kind}, ids array<int>").select(key, F.posexplode("ids").alias("pos", "id"))


def median_token_bytes(vocabulary: DataFrame) -> int:
    """The upper median of the tokens' lengths in bytes, 1 without tokens."""
    rows = vocabulary.groupBy(F.octet_length("token").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy("n").collect()  # one row per length
    left = sum(r["c"] for r in rows) // 2
    for r in rows:
        if left < r["c"]:
            return max(1, r["n"])
        left -= r["c"]
    return 1


def pooled(tokens: DataFrame, key: str, vectors: DataFrame, weights: DataFrame | None = None, unknown: int | None = 0, most: int = TOKENS) -> DataFrame:
    """(key, idx, value): the mean of the vectors of each text's first ``most`` known tokens, scaled
    by their weights, as a unit vector. Tokens without a vector do not count.

    Equal tokens of a text are added up before the vectors are joined."""
    from pyspark.sql import Window

    kept = tokens if unknown is None else tokens.where(F.col("id") != unknown)
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    first = kept.withColumn("_n", place).where(F.col("_n") <= most).groupBy(key, "id").agg(F.count(F.lit(1)).alias("_c"))
    table = vectors.select("id", "vector")
    if weights is not None:
        table = table.join(weights.select("id", "weight"), "id", "left").select("id", "vector", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    else:
        table = table.withColumn("weight", F.lit(1.0))
    each = first.join(table, "id").select(key, "_c", "weight", F.posexplode("vector").alias("idx", "v"))
    sums = each.groupBy(key, "idx").agg((F.sum(F.col("_c") * F.col("weight") * F.col("v")) / F.sum("_c")).alias("m"))
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return sums.join(norms, key).select(key, "idx", F.when(F.col("norm") > 1e-8, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value")).where(F.col("value") != 0)
