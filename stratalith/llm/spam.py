"""Keyword-stuffed and link-list pages, by pointwise mutual information of neighbouring words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators.scale import lookup_join, materialise, spread

SHARE = 0.5  # a document is flagged when more of its text than this is spam
INCOHERENT = -2.0  # mean PMI below which a segment is word salad
LEAST_PAIRS = 7  # shorter segments have no reliable mean
REPEATED = 0.3  # share of a segment's pairs that are repeated collocations
OFTEN, OFTEN_PAIRS, RARE = 4, 500, 0.02  # repeated: so often in a text of up to so many pairs, in so few texts
ITEMS = 3  # product lines from which they count as a list
BLOCK_CHARS = 1_000_000  # characters of texts that are counted together
BROADCAST_ROWS = 1_000_000  # pair tables up to so many rows (24 bytes, some 60 in a hash table: 60 MB) are sent to all executors

_ROWS = "doc_id bigint, seg int, kind string, chars int, h bigint, n int, h1 bigint, h2 bigint, repeated boolean"
_MIX = 0x9E3779B97F4A7C15


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three sorts: a segment (h null), a pair within a segment, a word of a document.

    ``n`` is the pair's count in the segment; h1, h2 are set where the document has the pair first,
    so that counting these counts documents. Texts are cut one by one; counting runs over arrays
    of BLOCK_CHARS characters' worth of documents at once."""
    import xxhash

    from stratalith.llm.segments import segments

    known: dict[str, int] = {}

    def code(word: str) -> int:
        h = known.get(word)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    held: list[tuple[int, list]] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = text.as_py()
            if doc is None or not text:
                continue
            held.append((doc, segments(text)))
            size += len(text)
            if size > BLOCK_CHARS:
                yield from _count(held, code)
                held, size = [], 0
    if held:
        yield from _count(held, code)


def _count(docs: list[tuple[int, list]], code) -> Iterator[pa.RecordBatch]:
    ids, of_doc, place, kind, chars, lens, words = [], [], [], [], [], [], []
    for d, (doc, parts) in enumerate(docs):
        ids.append(doc)
        items = sum(p.kind == "item" for p in parts)
        for i, p in enumerate(parts):
            of_doc.append(d)
            place.append(i)
            kind.append("prose" if p.kind == "item" and items < ITEMS else p.kind)
            chars.append(p.chars)
            lens.append(len(p.words) if p.kind != "other" else 0)
            if lens[-1]:
                words.extend(map(code, p.words))
    ids, of_doc, place = np.array(ids, np.int64), np.array(of_doc, np.int64), np.array(place, np.int32)
    kind, chars = np.array(kind, object), np.array(chars, np.int32)
    w = np.array(words, np.uint64)
    seg = np.repeat(np.arange(len(lens)), np.array(lens, np.int64))

    def rows(doc, at, k, c, h=None, n=None, h1=None, h2=None, fresh=None, often=None) -> pa.RecordBatch:
        m = len(doc)
        none = lambda kind_: pa.nulls(m, kind_)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[doc]), pa.array(at), pa.array(k, pa.string()), pa.array(c), none(pa.int64()) if h is None else pa.array(h.view(np.int64)),
             pa.array(np.zeros(m, np.int32) if n is None else n), none(pa.int64()) if h1 is None else pa.array(h1.view(np.int64), mask=~fresh),
             none(pa.int64()) if h2 is None else pa.array(h2.view(np.int64), mask=~fresh), pa.array(np.zeros(m, bool) if often is None else often)],
            ["doc_id", "seg", "kind", "chars", "h", "n", "h1", "h2", "repeated"],
        )

    yield rows(of_doc, place, kind, chars)
    if not len(w):
        return
    inside = seg[:-1] == seg[1:]
    a, b, s = w[:-1][inside], w[1:][inside], seg[:-1][inside]
    h, doc = a * np.uint64(_MIX) + b, of_doc[s]
    if len(h):
        o = np.lexsort((s, h, doc))
        a, b, s, h, doc = a[o], b[o], s[o], h[o], doc[o]
        new_pair = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
        new_row = new_pair | np.r_[True, s[1:] != s[:-1]]
        at = np.flatnonzero(new_row)
        n = np.diff(np.r_[at, len(h)]).astype(np.int32)
        total = np.diff(np.r_[np.flatnonzero(new_pair), len(h)])[np.cumsum(new_pair) - 1]
        pairs = np.bincount(doc, minlength=len(ids))[doc]
        # by the root of the length, so that longer texts may repeat more different pairs
        often = (total >= OFTEN * np.sqrt(np.maximum(pairs / OFTEN_PAIRS, 1)))[at]
        s = s[at]
        yield rows(doc[at], place[s], kind[s], np.zeros(len(at), np.int32), h[at], n, a[at], b[at], new_pair[at], often)
    d = of_doc[seg]
    o = np.lexsort((w, d))
    w, d = w[o], d[o]
    at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])])
    yield rows(d[at], np.full(len(at), -1, np.int32), np.full(len(at), "word", object), np.zeros(len(at), np.int32), w[at])


def spam_shares(documents: DataFrame) -> DataFrame:
    """(doc_id, chars, spam_chars, links, incoherent, repeated, by_words, share) of every non-blank text.

    Corpus statistics count distinct texts, so neither repeats within a text nor copies of it make
    its pairs common: PMI(a, b) = ln(N c(a,b) / (c(a) c(b))) over the N texts. A segment (a sentence or a
    few lines) is spam when it is a link without a sentence that explains it, a run of tags, a
    list of product lines, when its mean PMI is below INCOHERENT, or when more than REPEATED of
    its pairs are collocations that this text repeats and few others have. Headings do not count;
    code, traces and tables count as text that is no spam.

    Null ids and null, empty or blank texts have no row. A doc_id is a key; an exactly repeated row
    changes nothing. Extra columns are ignored. One document of each text is cut and counted, and
    its row is joined to the copies. Only hashes and counts are written and joined, unless there are
    repeated rows or more than BROADCAST_ROWS copies."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text <> ''")
    same = materialise(texts.select("doc_id", F.md5("text").alias("t")).groupBy("t", "doc_id").agg(F.count(F.lit(1)).alias("rows")))
    firsts = same.groupBy("t").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    copies = firsts.agg(F.sum(F.col("copies") - 1)).first()[0]
    if same.where("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id"])
    if not copies:
        return _shares(spread(texts))
    firsts = materialise(firsts)
    if copies <= BROADCAST_ROWS:
        others = lookup_join(same, firsts, ["t"], "copies").where(F.col("doc_id") != F.col("first")).select("doc_id")
        one = spread(texts).join(F.broadcast(others), "doc_id", "left_anti")
    else:
        one = texts.join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    verdicts = _shares(one).withColumnRenamed("doc_id", "first")
    verdicts = materialise(verdicts.join(firsts, "first"))
    return lookup_join(same.select("doc_id", "t"), verdicts, ["t"], "copies").drop("t", "first", "copies")


def _shares(documents: DataFrame) -> DataFrame:
    """``spam_shares`` of (doc_id, text) whose texts all differ."""
    rows = materialise(documents.mapInArrow(_pair_rows, _ROWS))
    found = rows.where(F.col("kind") != "word")
    docs = found.agg(F.count_distinct("doc_id")).first()[0]
    out = "doc_id bigint, chars bigint, spam_chars bigint, links bigint, incoherent bigint, repeated bigint, by_words bigint, share double"
    if not docs:
        return documents.sparkSession.createDataFrame([], out)
    words = rows.where(F.col("kind") == "word").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    pairs = found.where(F.col("h1").isNotNull()).groupBy("h", "h1", "h2").agg(F.count(F.lit(1)).alias("c12"))
    pairs = materialise(pairs)
    for side in ("h1", "h2"):
        uses = pairs.groupBy(side).agg(F.count(F.lit(1)).alias(f"uses_{side}"))
        counts = words.select(F.col("h").alias(side), F.col("c").alias(f"c_{side}")).join(uses, side)
        pairs = lookup_join(pairs, counts, [side], f"uses_{side}")
    pairs = pairs.select(
        "h", "c12", F.log(F.lit(float(docs)) * F.col("c12") / (F.col("c_h1") * F.col("c_h2"))).alias("pmi")
    )
    # two pairs with one hash are told apart by their words above and share the commoner's figures here
    pairs = materialise(pairs.groupBy("h").agg(F.max("c12").alias("c12"), F.max("pmi").alias("pmi")))
    inside = found.where(F.col("h").isNotNull())
    if pairs.count() <= BROADCAST_ROWS:
        scored = inside.join(F.broadcast(pairs), "h")
    else:
        weight = inside.groupBy("h").agg(F.count(F.lit(1)).alias("rows"))
        scored = lookup_join(inside, pairs.join(weight, "h"), ["h"], "rows")
    rare = F.col("repeated") & (F.col("c12") <= F.greatest(F.lit(1.0), F.lit(RARE * docs)))
    per_segment = scored.groupBy("doc_id", "seg").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("pmi")).alias("pmi"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("rep")
    )
    heads = found.where(F.col("h").isNull() & (F.col("kind") != "head")).select("doc_id", "seg", "kind", "chars").distinct()
    joined = heads.join(per_segment, ["doc_id", "seg"], "left")
    # links and tags are judged by their words too; being listed is evidence of its own
    salad = (F.col("n") >= LEAST_PAIRS) & (F.col("pmi") / F.col("n") < INCOHERENT)
    again = (F.col("rep") > REPEATED * F.col("n"))
    listed = F.col("kind").isin("link", "tag", "item")
    flags = joined.select("doc_id", "chars", F.coalesce(salad, F.lit(False)).alias("salad"), F.coalesce(again, F.lit(False)).alias("again"), listed.alias("listed"))
    spam = F.col("salad") | F.col("again") | F.col("listed")
    chars = F.col("chars").cast("bigint")
    return flags.groupBy("doc_id").agg(
        F.sum(chars).alias("chars"), F.sum(F.when(spam, chars).otherwise(0)).alias("spam_chars"), F.sum(F.when(F.col("listed"), chars).otherwise(0)).alias("links"),
        F.sum(F.when(F.col("salad"), chars).otherwise(0)).alias("incoherent"), F.sum(F.when(F.col("again"), chars).otherwise(0)).alias("repeated"),
        F.sum(F.when(F.col("salad") | F.col("again"), chars).otherwise(0)).alias("by_words"),
    ).withColumn("share", F.col("spam_chars") / F.col("chars"))


def spam_evidence(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, share, incoherent, repeated, listed, method) of the flagged documents: shares of the
    text by each evidence (they may overlap), and whether mean PMI and repeated collocations alone,
    without links, tags and product lines, exceed ``share``."""
    part = lambda c: F.round(F.col(c) / F.col("chars"), 6)
    return spam_shares(documents).where(F.col("share") > share).select(
        "doc_id", F.round("share", 6).alias("share"), part("incoherent").alias("incoherent"), part("repeated").alias("repeated"), part("links").alias("listed"),
        (F.col("by_words") > share * F.col("chars")).alias("method"),
    )


def spam_documents(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id) of the documents with more than ``share`` of their text spam."""
    return spam_shares(documents).where(F.col("share") > share).select("doc_id")
