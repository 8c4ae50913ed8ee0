"""Encoders against a plain version in Python; change operators on small literals."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratalith.operators import changes, encoders
from stratalith.operators.dense import hash_vectors

VOCAB = ["[UNK]", "un", "##do", "##ing", "do", "the", "##s", "a", "b", "##b", "."]


def _vocabulary(spark):
    return spark.createDataFrame(list(zip(VOCAB, range(len(VOCAB)))), "token string, id int")


def test_pieces_take_the_longest_and_give_up_whole_words():
    known = {t: i for i, t in enumerate(VOCAB)}
    assert encoders.pieces("undoing", known, 0) == [1, 2, 3]
    assert encoders.pieces("dos", known, 0) == [4, 6]
    assert encoders.pieces("dox", known, 0) == [0] and encoders.pieces("dox", known, None) == []
    assert encoders.pieces("a" + "b" * 200, known, 0) == [0] and encoders.pieces("abb", known, 0) == [7, 9, 9]


def test_wordpiece_and_pooling_equal_a_plain_version(spark):
    r = random.Random(2)
    words = ["undoing", "the", "dos", "zzz", "a", "abb", "Undo", "."]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 700)))) for i in range(12)] + [(90, None), (91, ""), (92, "zzz zzz"), (93, "THE\nthe")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "k long, t string, ids string")
    vectors = spark.createDataFrame([(i, [float(i % 3 - 1), 1.0 / (i + 1), 0.5]) for i in range(1, len(VOCAB)) if i != 7], "id int, vector array<double>")
    weights = spark.createDataFrame([(4, 3.0), (5, None)], "id int, weight double")
    tokens = {}
    for x in encoders.wordpiece(df, "k", F.col("t"), _vocabulary(spark)).orderBy("k", "pos").collect():
        tokens.setdefault(x["k"], []).append(x["id"])
    known = {t: i for i, t in enumerate(VOCAB)}
    want = {k: [p for w in t.lower().split() for p in encoders.pieces(w, known, 0)] for k, t in texts if t}
    assert tokens == want
    encoder = encoders.StaticEncoder(_vocabulary(spark), vectors, 3, weights)
    short = 512 * encoders.median_token_bytes(_vocabulary(spark))
    table = {x["id"]: x["vector"] for x in vectors.collect()}
    expected = {}
    for k, t in texts:
        ids = [p for w in (t or "")[:short].lower().split() for p in encoders.pieces(w, known, 0) if p][:512]
        ids = [i for i in ids if i in table]
        if ids:
            mean = [sum(table[i][j] * (3.0 if i == 4 else 1.0) for i in ids) / len(ids) for j in range(3)]
            norm = math.sqrt(sum(m * m for m in mean))
            expected |= {(k, j): m / norm for j, m in enumerate(mean) if m}
    got = {(x["k"], x["idx"]): x["value"] for x in encoder.encode(df, "k", F.col("t")).collect()}
    assert got == pytest.approx(expected) and 92 not in {k for k, _ in got}
    assert encoder.encode(df.limit(0), "k", F.col("t")).count() == 0
    assert encoder.fingerprint() != encoders.StaticEncoder(_vocabulary(spark), vectors, 3).fingerprint() == encoders.StaticEncoder(_vocabulary(spark), vectors.orderBy(F.desc("id")), 3).fingerprint()


def test_an_encoder_loads_from_a_folder(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(VOCAB) + "\n")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(len(VOCAB))], "id int, vector array<double>").write.parquet(f"{tmp_path}/vectors")
    encoder = encoders.load_static(spark, f"file://{tmp_path}")
    rows = encoder.encode(spark.createDataFrame([(1, "the")], "k int, t string"), "k", F.col("t")).orderBy("idx").collect()
    assert encoder.dim == 2 and [x["value"] for x in rows] == pytest.approx([1 / math.sqrt(26), 5 / math.sqrt(26)])


def test_median_of_token_lengths(spark):
    assert encoders.median_token_bytes(_vocabulary(spark)) == sorted(len(t) for t in VOCAB)[len(VOCAB) // 2]
    assert encoders.median_token_bytes(_vocabulary(spark).limit(0)) == 1


def test_hashed_vectors_are_unit_and_skip_empty_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "12 34"), (4, "")], "k long, t string")
    got = hash_vectors(df, "k", F.col("t")).groupBy("k").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert [(x["k"], round(x["n"], 9)) for x in got] == [(1, 1.0)]


def test_change_texts_in_columns(spark):
    texts = spark.createDataFrame([("r", "M\0a\0"), (None, "R090\0b\0c\0"), ("s", None), ("t", "")], "repo string, text string")
    got = {(x["repo"], x["status"], x["score"], x["path"], x["old_path"]) for x in changes.parsed(texts, "name_status").collect()}
    assert got == {("r", "M", None, "a", None), (None, "R", 90, "c", "b")}
    assert changes.parsed(texts.limit(0), "hunks").count() == 0


def test_drilldown_and_changed_paths(spark):
    hunks = spark.createDataFrame([("f", None, 1, 3, 1, 3, 2, 2, 1, " x\n-a\n+b\n+c"), ("f", None, 2, 90, 0, 91, 1, 1, 0, "+zz"), ("g", None, 1, 0, 0, 1, 1, 1, 0, "+q")], changes.HUNKS)
    syms = spark.createDataFrame([("f", "A", "class", 1, 50), ("f", "A.m", "method", 2, 9)], "path string, qualname string, kind string, start_line int, end_line int")
    rows = {(x["path"], x["hunk"]): x for x in changes.drilldown(hunks, syms, "changed").collect()}
    assert (rows["f", 1]["symbol"], rows["f", 1]["kind"], rows["f", 1]["spans"], rows["f", 1]["snippet"], rows["f", 1]["body"]) == ("A.m", "method", ["A", "A.m"], "-a", "-a\n+b\n+c")
    assert rows["f", 2]["symbol"] is None and rows["f", 2]["spans"] == [] and (rows["f", 2]["old_lo"], rows["f", 2]["old_hi"]) == (90, 90)
    within = syms.where("qualname = 'A.m'")
    assert [x["hunk"] for x in changes.drilldown(hunks, syms, "none", within).collect()] == [1]
    cut = {x["path"]: x["body"] for x in changes.drilldown(hunks, syms, "full", None, 5).collect()}
    assert cut == {"f": None, "g": "+q"}
    e = spark.createDataFrame([("a/x.py",), ("b/x.py",), ("x.py",), ("b/c/y.py",)], "path string")
    find = lambda w: sorted(r["path"] for r in changes.resolve_change(e, w).collect())
    assert find("x.py") == ["x.py"] and find("a/x.py") == ["a/x.py"] and find("b") == ["b/c/y.py", "b/x.py"] and find("c/y.py") == ["b/c/y.py"] and find("z") == []
