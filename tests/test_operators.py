"""Operators on small literals and against brute force, with the skew paths forced."""

import math
import os
import random
import subprocess
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith import render
from stratalith.api import Engine
from stratalith.operators import bm25, changes, dense, framework, fusion, structure, symbols
from stratalith.operators.incremental import IncrementalStore, change_feed, replay
from stratalith.operators.index import Index, stale, upsert
from stratalith.operators.scale import lookup_join, rank_in_groups
from stratalith.sources import repo as trees

CHUNKS = [
    (1, "src/auth/session.rs", "rust", 1, 9, "pub struct Session { id: u64 }\nfn open_session() {}"), (2, "src/ui/view.rs", "rust", 1, 5, "fn draw(view: View) { render(view) }"),
    (3, "docs/guide.md", "markdown", 1, 3, "the session guide explains the view"), (4, "src/auth/session.rs", "rust", 10, 20, "fn close_session(s: Session) { drop(s) }"), (5, "vendor/x/session_store.rs", "rust", 1, 4, "fn session_store() {}"), (6, "src/empty.rs", "rust", 1, 1, None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id bigint, file_path string, language string, start_line int, end_line int, content string")


def test_bm25_and_selectors(spark, chunks):
    postings, lengths = bm25.build_index(chunks)
    top = [r["chunk_id"] for r in bm25.top_k(bm25.scores(postings, lengths, "session"), 5).orderBy("rank").collect()]
    assert set(top) == {1, 3, 4, 5} and top[0] in (1, 4, 5)
    none = bm25.select_chunks(chunks, languages=[])
    assert bm25.scores(postings, lengths, "session", none).count() == 0
    assert bm25.select_chunks(chunks) is None
    only = bm25.select_chunks(chunks, ["rust"], ["src"], ["ui"])
    full = {r["chunk_id"]: r["score"] for r in bm25.scores(postings, lengths, "session view").collect()}
    part = {r["chunk_id"]: r["score"] for r in bm25.scores(postings, lengths, "session view", only).collect()}
    assert part == {k: v for k, v in full.items() if k in (1, 4)}
    with pytest.raises(ValueError):
        bm25.scores(postings, lengths, "?!")
    queries = spark.createDataFrame([("session",), ("session",), ("view draw",), (None,), ("",)], "query_text string")
    batch = {(r["query_text"], r["chunk_id"]): r["score"] for r in bm25.batch(postings, lengths, queries, 10).collect()}
    assert batch["session", 1] == round({r["chunk_id"]: r["score"] for r in bm25.scores(postings, lengths, "session").collect()}[1], 6)


def _written(spark):
    return sum(x.shuffleWriteRecords() for x in _all(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))


def _all(found):
    return [found.apply(i) for i in range(found.size())]


def _batch_loop(postings, lengths, queries, k):
    n, mean, df = len(lengths), max(1.0, sum(x for _, x in lengths) / len(lengths)), defaultdict(int)
    for term, _, _ in postings:
        df[term] += 1
    out = set()
    for text in {x for x in queries if x is not None}:
        score, words = defaultdict(float), set(text.split())
        for term, chunk, tf in postings:
            for one, dl in lengths:
                if term in words and one == chunk:
                    score[chunk] += math.log((n - df[term] + 0.5) / (df[term] + 0.5) + 1) * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * dl / mean))
        order = sorted((-math.floor(s * 1e6 + 0.5) / 1e6, c) for c, s in score.items())
        out |= {(text, i + 1, c, -s) for i, (s, c) in enumerate(order[:k]) if s < 0}
    return out


def test_batch_against_a_loop_writes_no_row_per_query_and_chunk(spark, monkeypatch):
    r = random.Random(4)
    words = ["every", *(f"w{chr(97 + i)}" for i in range(12)), "lost"]
    postings = [(w, c, r.choice([1, 1, 1, 2, 5])) for c in range(300) for w in {"every", *r.choices(words[1:-1], k=3)}]
    postings += [("wa", 7, 9), ("wa", 7, 2)] + [("lost", 1000 + i, 1) for i in range(700)] + [("lost", 3, 1)]  # a repeat; chunks without a length, so that a weight is below 0
    lengths = [(c, r.choice([5, 10])) for c in range(300)] + [(9, 77)]
    queries = ["every", "lost", "lost every", "nothing", "", None] + [" ".join(["every", *r.sample(words, 2), f"x{i}x"]) for i in range(300)]
    p, n = spark.createDataFrame(postings, "term string, chunk_id bigint, tf int"), spark.createDataFrame(lengths, "chunk_id bigint, dl int")
    q = spark.createDataFrame([(x,) for x in queries], "query_text string")
    began = _written(spark)
    got = bm25.batch(p, n, q, 10).collect()
    assert _written(spark) - began < 30_000  # of 90,000 matching pairs of query and chunk
    want = _batch_loop(postings, lengths, queries, 10)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    for name, most in (("TILE_CHUNKS", 40), ("TILE_QUERIES", 70), ("FEW_TERMS", 10)):
        monkeypatch.setattr(bm25, name, most)
    got = bm25.batch(p, n, q, 3).collect()
    want = _batch_loop(postings, lengths, queries, 3)
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert bm25.batch(p, n, q.limit(0), 3).count() == bm25.batch(p.limit(0), n.limit(0), q, 3).count() == bm25.batch(p, n, q, 0).count() == 0


def test_a_tile_of_many_blocks_keeps_the_first_of_equal_scores(monkeypatch):
    r = random.Random(5)
    for block, k, names in ((64, 2, int), (256, 2, lambda i: f"c{i}"), (300, 1, int), (1024, 50, int)):
        monkeypatch.setattr(bm25, "BLOCK", block)
        ids = r.sample(range(10_000), 1_000)
        rows = [(names(i), [(t, r.choice([0.5, 0.25, 1.0, -0.25])) for t in r.choices([3, 5, 8], k=2) + r.choices(range(100, 300), k=2)]) for i in ids]
        asked = [(q, t) for q in range(40) for t in {3, *r.sample([5, 8, 999], 1), *r.sample(range(100, 300), q % 4)}] + [(77, 999)]
        tile = pa.table({"chunk_id": [x for x, _ in rows], "ts": [[t for t, _ in x] for _, x in rows], "ws": [[w for _, w in x] for _, x in rows]})
        got = bm25.best_of_tile(tile, pa.table({"q": [q for q, _ in asked], "t": [t for _, t in asked]}), k)
        want = []
        for q in sorted({q for q, _ in asked}):
            terms = {t for x, t in asked if x == q}
            sums = sorted((-sum(w for t, w in x if t in terms), c) for c, x in rows)
            want += [(q, c, -s) for s, c in sums[:k] if s < 0]
        assert [tuple(x.values()) for x in got.to_pylist()] == want


def test_hash_vectors_and_lookup(spark, chunks):
    v = dense.hash_vectors(chunks, "chunk_id", F.col("content"))
    assert all(abs(r["n"] - 1) < 1e-9 for r in v.groupBy("chunk_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect())
    best = bm25.top_k(dense.semantic_scores(v, CHUNKS[1][5]), 1).first()
    assert best["chunk_id"] == 2 and best["score"] == pytest.approx(1.0)
    assert dense.chunk_at(chunks, "src/auth/session.rs", 12).first()["chunk_id"] == 4
    assert dense.chunk_at(chunks, "src/auth/session.rs", 99).first()["chunk_id"] == 1
    with pytest.raises(ValueError):
        dense.chunk_at(chunks, "x", 0)
    exact = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0]), (4, None), (5, [float("nan"), 0.0])], "chunk_id bigint, embedding array<float>")
    assert [r["chunk_id"] for r in bm25.top_k(dense.scores(dense.usable(exact, 2), [0.0, 1.0]), 5).orderBy("rank").collect()] == [2, 1]


def test_fusion_chain_against_a_loop(spark, chunks):
    r = random.Random(8)
    for _ in range(3):
        cands = [(i, f"f{r.randint(0, 3)}", round(r.random(), 3)) for i in range(12)]
        df = spark.createDataFrame(cands, "chunk_id bigint, file_path string, score double")
        sums, best = defaultdict(float), {}
        for i, f, s in cands:
            sums[f] += s
            if f not in best or s > best[f][1]:
                best[f] = (i, s)
        top, most = max(s for *_, s in cands), max(sums.values())
        want = {i: s + (0.2 * top * sums[f] / most if best[f][0] == i else 0) for i, f, s in cands}
        got = {x["chunk_id"]: x["score"] for x in fusion.file_boost(df).collect()}
        assert got == pytest.approx(want)
        seen, eff = defaultdict(int), []
        for i, f, s in sorted(cands, key=lambda x: (-x[2], x[0])):
            eff.append((i, round(s * 0.5 ** seen[f], 9)))
            seen[f] += 1
        want = [i for i, _ in sorted(eff, key=lambda x: (-x[1], x[0]))[:5]]
        assert [x["chunk_id"] for x in fusion.diversity(df, 5).orderBy("rank").collect()] == want


def test_definition_boost_inserts_definitions_at_home(spark, chunks):
    seeds = spark.createDataFrame([(2, "src/ui/view.rs", 1.0)], "chunk_id bigint, file_path string, score double")
    got = {x["chunk_id"]: x["score"] for x in fusion.definition_boost(seeds, chunks, "Session", 1.0).collect()}
    assert got == {2: 1.0, 1: 4.5}


def test_rank_and_lookup_on_heavy_keys(spark):
    r = random.Random(1)
    rows = [("hot", r.randint(0, 50), i) for i in range(900)] + [(None, i, i) for i in range(40)] + [(f"k{i % 9}", i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = rank_in_groups(df, ["k"], [F.col("v").desc(), F.col("i").asc()], "n", floor=50).collect()
    groups = defaultdict(list)
    for k, v, i in rows:
        groups[k].append((-v, i))
    assert {(x["k"], x["i"]): x["n"] for x in got} == {(k, i): n for k, g in groups.items() for n, (_, i) in enumerate(sorted(g), 1)}
    small = spark.createDataFrame([(k, len(g)) for k, g in groups.items() if k], "k string, w long")
    assert lookup_join(df, small, ["k"], "w", floor=50).count() == 990


SIGS = "sig_id long, repo string, rel_path string, len long, mtime_ns long, walked_at timestamp_ntz, loaded_at timestamp_ntz"


def test_materialised_files_can_be_released_and_purged(spark):
    from stratalith.operators.scale import materialise, purge, release

    a, b = materialise(spark.range(5)), materialise(spark.range(7))
    folder = lambda df: df._stratalith_folder.removeprefix("file://")
    assert a.count() == 5 and os.path.exists(folder(a))
    release(a)
    release(spark.range(1))
    assert not os.path.exists(folder(a)) and b.count() == 7
    assert purge(spark) >= 2 and not os.path.exists(folder(b)) and purge(spark) == 0


def _log(spark):
    import datetime as dt

    at = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    sig = [(1, "r", "./a/b", 1, 5, 1, 1), (2, "r", "a\\b", 2, 6, 3, 9), (3, "r", "c", 7, 7, 2, 2), (4, "r", "c", None, 7, 3, 3), (5, "r", "d", 1, 1, 1, 1), (6, "r", "d", 1, 1, 11, 11), (7, "r", "e", 1, 1, 2, 30), (8, "r", "a/b", 1, 5, 2, 12), (9, None, "f", 3, 3, 13, 13)]
    sigs = spark.createDataFrame([(*x[:5], at(x[5]), at(x[6])) for x in sig + sig[:2]], SIGS)
    runs = spark.createDataFrame([(1, at(5), "success"), (2, at(6), "failed"), (3, at(10), "success"), (4, at(20), "success"), (5, at(21), "failed"), (6, at(22), "success")], "run_id long, started_at timestamp_ntz, status string")
    cache = spark.createDataFrame([("r", "d", 0, 1, 1), ("r", "zz", 0, 1, 1)], "repo string, rel_path string, mtime_secs long, mtime_nanos int, size long")
    return sigs, runs, cache, at


def test_change_feed_and_store_agree(spark, tmp_path):
    sigs, runs, cache, at = _log(spark)
    got = {tuple(x) for x in change_feed(sigs, runs, cache).collect()}
    assert got == {(1, "r", "a/b"), (1, "r", "c"), (3, "r", "a/b"), (4, None, "f")}
    assert change_feed(sigs.limit(0), runs, cache).count() == 0 and change_feed(sigs, runs.limit(0), cache).count() == 0
    store = IncrementalStore(spark, f"file://{tmp_path}/store")
    seen = set()
    for run, hour in ((1, 5), (3, 10), (4, 20), (6, 22)):
        if run == 3:
            with pytest.raises(RuntimeError):
                store.run(sigs, cache, at(hour), fail_before_commit=True)
        seen |= {(run, x["repo"], x["rel_path"]) for x in store.run(sigs, cache, at(hour)).collect()}
    assert seen == got and store.last_commit()["n"] == 4
    # two folders of the run that died and of the last commit's forebears go, the state stays
    state = {(x["repo"], x["rel_path"]) for x in store.state().collect()}
    assert store.vacuum() >= 1 and store.vacuum() == 0 and {(x["repo"], x["rel_path"]) for x in store.state().collect()} == state == {("r", "a/b"), ("r", "c"), ("r", "d"), ("r", "zz"), (None, "f")}


def test_replay_takes_the_failed_runs_along(spark, tmp_path):
    sigs, runs, cache, _ = _log(spark)
    wide = sigs.withColumn("first", F.lit("a clashing name"))
    want = sorted(map(str, change_feed(sigs, runs, cache).collect()))
    assert sorted(map(str, replay(wide, runs, cache, f"file://{tmp_path}/a").collect())) == want
    assert len([f for f in os.listdir(f"{tmp_path}/a/store/commits") if f.isdigit()]) == 4
    assert len([f for f in os.listdir(f"{tmp_path}/a/store") if f.startswith("v=")]) == 6  # the failed runs wrote theirs
    assert replay(sigs.limit(0), runs, cache, f"file://{tmp_path}/b").count() == 0
    assert replay(sigs, runs.where("status = 'failed'"), cache, f"file://{tmp_path}/c").count() == 0


def test_store_parts_stay_few_and_many_keys_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    from stratalith.operators import incremental

    _, _, cache, at = _log(spark)
    monkeypatch.setattr(incremental, "FEW_KEYS", 3)
    store, expected = IncrementalStore(spark, f"file://{tmp_path}/s"), {}
    for n in range(1, 7):
        rows = [(n * 100 + i, "r" if i % 3 else None, f"p{i % (3 * n)}", n, i, at(n), at(n)) for i in range(2 * n)]
        got = {(x["repo"], x["rel_path"]) for x in store.run(spark.createDataFrame(rows, SIGS), cache.limit(0), at(n)).collect()}
        want = {}
        for _, repo, path, size, mtime, walked, loaded in rows:
            want[repo, path] = (size, mtime)
        assert got == {k for k, v in want.items() if expected.get(k) != v}
        expected |= want
        sizes = [p["rows"] for p in store.last_commit()["parts"]]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    best = store.state().groupBy("repo", "rel_path").agg(F.max("v").alias("v")).select("repo", "rel_path", "v.len", "v.mtime_ns").collect()
    assert {(a, b): (c, d) for a, b, c, d in best} == expected


def test_name_status_numstat_and_hunks():
    assert changes.parse_name_status("R100\0old\0new\0M\0file.txt\0") == [("R", 100, "new", "old"), ("M", None, "file.txt", None)]
    assert changes.parse_numstat("1\t2\ta\0-\t-\tb\x003\t4\t\0old\0new\0") == [(1, 2, "a", None), (None, None, "b", None), (3, 4, "new", "old")]
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -10 +12,2 @@ fn\n-a\n+b\n+-- c\n@@ -20,2 +22,0 @@\n--- d\n-e\n\\ No newline at end of file\ndiff --git a/o b/n\nrename from o\nrename to n\n--- a/o\n+++ b/n\n@@ -0,0 +1 @@\n+z\n"
    rows = changes.parse_unified(text)
    assert [(r[0], *r[3:9]) for r in rows] == [("x", 10, 1, 12, 2, 2, 1), ("x", 20, 2, 22, 0, 0, 2), ("n", 0, 0, 1, 1, 1, 0)]
    assert rows[1][9].startswith("--- d") and rows[2][1] == "o"
    with pytest.raises(ValueError):
        changes.parse_name_status("R100\0old")


def test_hunk_symbols_literals(spark):
    syms = spark.createDataFrame([("f", "Outer", 1, 100), ("f", "Inner", 10, 50), ("f", "Leaf", 20, 30), ("f", "Sibling", 60, 90), ("g", "Foo", 1, 10), ("g", "Bar", 11, 20), ("h", "Big", 1, 1000)], "path string, qualname string, start_line int, end_line int")
    hunks = spark.createDataFrame([("f", 1, 22, 4), ("g", 1, 8, 7), ("g", 2, 0, 0), ("h", 1, 60, 300)], "path string, hunk int, new_start int, new_len int")
    got = defaultdict(list)
    for x in changes.hunk_symbols(hunks, syms).orderBy("path", "hunk", "place").collect():
        got[x["path"], x["hunk"]].append(x["symbol"])
    assert got == {("f", 1): ["Leaf", "Inner", "Outer"], ("g", 1): ["Foo", "Bar"], ("g", 2): ["Foo"], ("h", 1): ["Big"]}
    many = spark.createDataFrame([("p", f"s{i:02}") for i in range(11)] * 2, "path string, symbol string")
    t = changes.touched(many).first()
    assert t["symbols"] == [f"s{i:02}" for i in range(8)] and t["more"] == 3


def test_overview_rebase_and_bodies(spark):
    ns = spark.createDataFrame([("R", 100, "x/b", "y/a"), ("R", 100, "y/c", "x/d"), ("M", None, "x/m", None), ("M", None, "z", None)], changes.NAME_STATUS)
    num = spark.createDataFrame([(1, 2, "x/b", "y/a"), (None, None, "x/m", None)], changes.NUMSTAT)
    o = {r["path"]: r for r in changes.overview(ns, num, ns.where("path = 'x/b'"), ns.where("path in ('x/b', 'x/m')")).collect()}
    assert (o["x/b"]["added"], o["x/b"]["staged"], o["x/b"]["unstaged"]) == (1, True, True) and o["x/m"]["binary"] and not o["z"]["binary"]
    r = {x["path"]: (x["status"], x["note"]) for x in changes.rebase(ns, "x").collect()}
    assert r == {"b": ("A", "from y/a"), "d": ("D", "to y/c"), "m": ("M", None)}
    body = spark.createDataFrame([("@\n+a\n-b\n c",)], "b string")
    assert [body.select(changes.body_lines(F.col("b"), m)).first()[0] for m in ("changed", "added", "none")] == ["+a\n-b", "+a", ""]


def test_find_semantics(spark):
    files = spark.createDataFrame([("aaa/x",), ("bbb/x",), ("ccc/x",), ("root",)], "path string")
    rows = [(f, "function", f"{f[:3]}.hit{i}", i, i + 1) for f in ("aaa/x", "bbb/x", "ccc/x") for i in range(6)]
    s = spark.createDataFrame(rows, "path string, kind string, qualname string, start_byte int, end_byte int")
    m, summary = structure.find(s, files, "HIT", None, 1)
    assert [x["path"] for x in m.collect()] == ["aaa/x"]
    got = summary.first()
    assert got["truncated"] and got["unsampled"] == ["bbb", "ccc"] and got["searched"] == 2
    m, summary = structure.find(s.where("path = 'aaa/x'"), files.where("path = 'aaa/x'"), "hit", ["callable"], 50, 5)
    assert [x["more_in_file"] for x in m.collect()] == [1] * 5 and not summary.first()["truncated"]
    m, summary = structure.find(s.where("path = 'ccc/x' and start_byte < 3"), files, "hit", None, 3, 0)
    assert m.count() == 3 and not summary.first()["truncated"]
    assert structure.find(s, files, "hit", ["class"])[0].count() == 0
    for bad in (("", 5), ("x", 0)):
        with pytest.raises(ValueError):
            structure.find(s, files, bad[0], None, bad[1])


def test_small_structure_operators(spark):
    p = spark.createDataFrame([("a/b/c.ts",), ("a/b/d.ts",), ("a/x/c.ts",)], "path string")
    assert structure.common_prefix(p).first()[0] == "a/" and structure.common_prefix(p.where("path like 'a/b%'")).first()[0] == "a/b/"
    assert {r[0] for r in structure.dirs(p).collect()} == {"a", "a/b", "a/x"}
    assert {r[0] for r in structure.resolve_path(p, "c.ts").collect()} == {"a/b/c.ts", "a/x/c.ts"} and structure.resolve_path(p, "a/b/c.ts").count() == 1
    t = spark.createDataFrame([("one\ntwo\nthree\n",), ("x",)], "text string")
    assert [r["slice"] for r in structure.read_lines(t, 2, 99).collect()] == ["two\nthree"]
    with pytest.raises(ValueError):
        structure.read_lines(t, 0, 1)
    with pytest.raises(ValueError):
        structure.loc(spark.createDataFrame([("a", "rust", 1, 0, 0)], "path string, language string, total int, blank int, comment int"), 5, 2)
    q = spark.createDataFrame([("AuthService.handleAuth",), ("AuthService",), ("other.handleAuth",)], "qualname string")
    assert symbols.resolve_qualname(q, "handleAuth").count() == 2 and symbols.resolve_qualname(q, "AuthService").count() == 1
    assert symbols.suggest(q, "handelAuth").orderBy("rank").first()["name"] == "AuthService.handleAuth"


SOURCES = {
    "python": ("class A:\n    x = 1\n    def f(self):\n        def g(): pass\n        return 1\n\nLIMIT = 3\n", ["A:class", "A.x:variable", "A.f:method", "A.f.g:function", "LIMIT:constant"]),
    "typescript": ("export class A {\n  f(x: number): void { if (x) { } }\n  async g() { }\n}\nexport const h = (a) => { const b = 1; };\ninterface I { x: string }\n", ["A:class", "A.f:method", "A.g:method", "h:function", "I:interface"]),
    "rust": ("pub struct S { x: u8 }\nimpl S {\n    pub fn new() -> S { let c = '{'; S { x: 1 } }\n}\nconst K: u8 = 1;\nmod m { fn inner() {} }\n", ["S:struct", "S:impl", "S.new:method", "K:constant", "m:module", "m.inner:function"]),
    "go": ("package a\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) M() {}\n\nfunc F(a int) {\n}\n", ["T:struct", "M:method", "F:function"]),
    "java": ("public class A {\n  private int x;\n  public static void main(String[] a) { run(); }\n  enum E { X }\n}\n", ["A:class", "A.main:method", "A.E:enum"]),
    "kotlin": ("class A(val x: Int) {\n  fun f() { }\n  companion object C { }\n}\nfun top() = 1\n", ["A:class", "A.f:method", "A.C:object", "top:function"]),
    "c": ("#define M 1\nstruct s { int a; };\nstatic int f(int a) {\n  return a;\n}\n", ["M:macro", "s:struct", "f:function"]),
    "prisma": ("model User {\n  id Int\n}\nenum Role { A }\n", ["User:model", "Role:enum"]),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_extract_symbols(lang):
    source, want = SOURCES[lang]
    got = symbols.extract(source, lang)
    assert [f"{s.qualname}:{s.kind}" for s in got] == want
    for s in got:
        assert s.name in source.encode()[s.start_byte : s.end_byte].decode() and 1 <= s.start_line <= s.end_line <= source.count("\n") + 1


def test_declarations_end_behind_a_long_line():
    source = f'const DATA = "{"x" * 6000}";\nconst B = 2;\nclass C {{\n  run() {{\n    return 1;\n  }}\n}}\nfunction last() {{\n  return B;\n}}\n'
    got = [(s.kind, s.qualname, s.start_line, s.end_line) for s in symbols.extract(source, "javascript")]
    assert got == [("constant", "DATA", 1, 1), ("constant", "B", 2, 2), ("class", "C", 3, 7), ("method", "C.run", 4, 6), ("function", "last", 8, 10)]
    assert [c[0] for c in symbols.cut_chunks(source, symbols.extract(source, "javascript"))] == [1, 2]
    data = f"const A = [{'1, ' * 3000}];\n" + "".join(f"function f{i}() {{\n  return {'1 + ' * 300}{i};\n}}\n" for i in range(3))
    assert [c[0] for c in symbols.cut_chunks(data, symbols.extract(data, "javascript"))] == [1, 2, 5, 8]


def test_chunks_cover_and_keep_order():
    source = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(400))
    out = symbols.cut_chunks(source, symbols.extract(source, "python"))
    assert all(c.strip() and len(c) < 2600 for *_, c in out) and [a for a, *_ in out] == sorted(a for a, *_ in out)
    assert "".join("".join(c.split()) for *_, c in out) == "".join(source.split())


NEXT = {
    "package.json": '{"dependencies": {"next": "14.1.0"}}', "app/page.tsx": "", "app/(marketing)/promo/page.tsx": "", "app/_components/x/page.tsx": "", "app/blog/[slug]/page.tsx": "", "app/@modal/photos/page.tsx": "", "app/feed/(..)(..)photo/page.tsx": "", "app/layout.tsx": "", "app/blog/error.tsx": "",
    "app/api/x/route.ts": "export async function GET() {}\nexport const PATCH = 1;\nconst del = 1;\nexport { del as DELETE, POST };", "pages/_app.tsx": "", "pages/404.tsx": "", "pages/index.tsx": "", "pages/api/hello.ts": "", "pages/posts/[id].tsx": "",
    "app/actions.ts": "'use server'\nexport async function createPost() {}\nexport const deletePost = async () => {};\nasync function a() {}\nexport { a as archivePost };\nexport default async function () {}\n",
    "app/form.tsx": "export async function submitForm() { 'use server'; }\nconst save = async () => { 'use server'; };\nasync function plain() { }\n",
}


def test_framework(spark):
    df = spark.createDataFrame(list(NEXT.items()), "path string, text string")
    routes = {(r["pattern"], r["kind"], r["router"], r["advanced"]) for r in framework.routes(df).collect()}
    assert routes == {("/", "page", "app", False), ("/promo", "page", "app", False), ("/blog/[slug]", "page", "app", False), ("/photos", "page", "app", True), ("/feed/photo", "page", "app", True), ("/api/x", "api", "app", False), ("/", "page", "pages", False), ("/api/hello", "api", "pages", False), ("/posts/[id]", "page", "pages", False)}
    assert [(r["kind"], r["scope"]) for r in framework.layouts(df).collect()] == [("layout", "/"), ("error", "/blog")]
    assert df.where("path like '%route.ts'").select(framework.methods(F.col("text"))).first()[0] == ["GET", "POST", "DELETE", "PATCH"]
    acts = {(r["file"], r["name"], r["scope"]) for r in framework.server_actions(df).collect()}
    assert acts == {("app/actions.ts", n, "file") for n in ("createPost", "deletePost", "archivePost", "default")} | {("app/form.tsx", "submitForm", "function"), ("app/form.tsx", "save", "function")}
    d = framework.detect(df).first()
    assert (d["version"], d["app"], d["pages"], d["src"]) == ("14.1.0", True, True, False)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    run = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    files = {"src/auth.py": "class Auth:\n    def login(self):\n        return 1\n\n    def out(self):\n        return 2\n", "src/main.rs": "fn main() {\n    // start\n    run();\n}\n", "lib/main.rs": "fn main() {}\n", ".gitignore": "build/\n*.tmp\n!keep.tmp\n", "build/x.py": "x = 1\n", "a.tmp": "x", "keep.tmp": "x", ".hidden/x.py": "x = 1\n", "bin.dat": "a\0b"}
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    run("init", "-q")
    run("-c", "user.email=a@b", "-c", "user.name=a", "add", "src", "lib")
    run("-c", "user.email=a@b", "-c", "user.name=a", "commit", "-qm", "x")
    (root / "src/auth.py").write_text(files["src/auth.py"].replace("return 2", "return 3\n        # more"))
    run("mv", "lib/main.rs", "lib/other.rs")
    return str(root)


def test_engine_on_a_tree(spark, tree):
    assert {p for p, *_ in trees.walk(tree)} == {"src/auth.py", "src/main.rs", "lib/other.rs", "keep.tmp", "bin.dat"}
    e = Engine.open(spark, tree)
    assert [r["path"] for r in e.files(["**/*.rs"])["files"].collect()] == ["lib/other.rs", "src/main.rs"]
    assert {r["language"]: r["code"] for r in e.langs().collect()}["rust"] == 4
    assert [s["qualname"] for s in e.outline("auth.py")["symbols"].collect()] == ["Auth", "Auth.login", "Auth.out"]
    assert e.symbol("src/auth.py", "login")["text"].startswith("def login")
    with pytest.raises(ValueError, match="Auth.login"):
        e.symbol("src/auth.py", "logni")
    assert e.read("main.rs", 2, 3) == "    // start\n    run();"
    with pytest.raises(ValueError, match="binary"):
        e.read("bin.dat")
    hit = e.search("login auth", k=3)
    assert hit.first()["file_path"] == "src/auth.py" and "1. src/auth.py" in render.hits(hit)
    assert e.search("main", mode="bm25", languages=["rust"]).count() == 2 and e.search("main", prefixes=["lib"], mode="semantic").count() == 1
    assert e.find_related("src/main.rs", 1, 2).first()["file_path"] == "lib/other.rs"
    f = e.find("log")
    assert "Auth.login(method)" in render.matches(f["matches"], f["summary"])
    assert [r["qualname"] for r in e.loc_symbols(least=3).collect()] == ["main"] or e.loc_symbols(least=2).count() >= 2
    d = e.diff()
    o = {r["path"]: r["status"] for r in d["overview"].collect()}
    assert o["src/auth.py"] == "M" and o["lib/other.rs"] == "R" and o["keep.tmp"] == "?"
    assert {(r["path"], r["symbol"]) for r in d["pairs"].where("place = 1").collect()} == {("src/auth.py", "Auth.out")}
    one = e.diff_file("auth.py", body="changed")
    h = one["hunks"].collect()
    assert [(x["symbol"], x["kind"], x["spans"], x["body"]) for x in h] == [("Auth.out", "method", ["Auth", "Auth.out"], "-        return 2\n+        return 3\n+        # more")] and one["note"] is None
    assert "@@ 6-7 Auth.out(method) +2 -1" in render.drilldown(one) and e.diff_file("src/auth.py", symbol="login")["hunks"].count() == 0
    assert e.diff_file("keep.tmp", scope="untracked")["hunks"].first()["added"] == 1 and [x["path"] for x in e.diff_names("staged").collect()] == ["lib/other.rs"]
    with pytest.raises(ValueError, match="no change"):
        e.diff_file("main.rs")
    with pytest.raises(ValueError, match="Auth.login"):
        e.diff_file("auth.py", symbol="logni")
    s = e.diff_summary()
    assert s["total"]["added"] == 3 and s["common"] == "" and "rust: 2 files" in render.languages(e.langs())
    assert "    5-6 method out" in render.outline(e.outline("auth.py"))
    assert "M src/auth.py +2 -1" in render.overview(d["overview"]) and "folder" in render.table(d["folders"])
    for bad in ({"query": " "}, {"query": "x", "mode": "y"}, {"query": "x", "k": 0}):
        with pytest.raises(ValueError):
            e.search(**bad)


def test_deleted_file_has_the_symbols_of_its_base(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True)
    (root / "gone.py").write_text("def first():\n    return 1\n\n\ndef second():\n    return 2\n")
    (root / "big.py").write_text("x = 1\n")
    run("init", "-q")
    run("add", ".")
    run("-c", "user.email=a@b", "-c", "user.name=a", "commit", "-qm", "x")
    (root / "gone.py").unlink()
    (root / "big.py").write_text("".join(f"x{i} = 1\n" for i in range(9)))
    e = Engine.open(spark, str(root))
    got = e.diff_file("gone.py")
    assert [x["status"] for x in got["entries"].collect()] == ["D"] and [(x["symbol"], x["removed"]) for x in got["hunks"].collect()] == [("first", 6)]
    assert {r["rel_path"]: r["language"] for r in trees.blobs(spark, str(root), "HEAD", ["gone.py", "nowhere.py"]).collect()} == {"gone.py": "python"}
    from stratalith import api

    kept, api.MAX_BYTES = api.MAX_BYTES, 10
    try:
        cut = e.diff_file("big.py")
        assert cut["hunks"].first()["body"] is None and "big.py" in cut["note"]
    finally:
        api.MAX_BYTES = kept


def test_refs():
    for bad in ("", "-x", "a..b", "a b"):
        with pytest.raises(ValueError):
            trees.valid_ref(bad)


def test_index_lifecycle(spark, tree, tmp_path):
    from stratalith.operators.encoders import HashingEncoder

    files = trees.files(spark, tree)
    ix = Index(spark, f"file://{tmp_path}/ix")
    assert ix.status() is None and ix.ensure(files) == "built" and ix.ensure(files) == "reused"
    before = {(r["file_path"], r["content"]): r["chunk_id"] for r in ix.table("chunks").collect()}
    changed = files.withColumn("mtime_ns", F.when(F.col("rel_path") == "src/main.rs", F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns"))).withColumn(
        "content", F.when(F.col("rel_path") == "src/main.rs", F.lit("fn changed() {}\n").cast("binary")).otherwise(F.col("content"))
    ).where("rel_path <> 'lib/other.rs'")
    assert {(r["rel_path"], r["change"]) for r in ix.changed(changed).collect()} == {("src/main.rs", "changed"), ("lib/other.rs", "removed")}
    first = ix.status()["tables"]
    assert ix.ensure(changed) == "updated" and ix.ensure(changed) == "reused"
    second = ix.status()["tables"]
    # only the buckets of the two files are written anew, and the ids of other chunks stay
    fresh = {b for t in second for b in second[t] if second[t][b] != first[t].get(b)}
    assert 1 <= len(fresh) <= 2 and sum(second[t][b] == first[t][b] for t in second for b in second[t] if b not in fresh) > 0
    after = {(r["file_path"], r["content"]): r["chunk_id"] for r in ix.table("chunks").collect()}
    assert after != before and all(before[k] == after[k] for k in before.keys() & after.keys())
    cold = Index(spark, f"file://{tmp_path}/cold")
    cold.ensure(changed)
    for name in ("chunks", "symbols", "postings", "lengths", "vectors", "signatures"):
        rows = lambda i: sorted(map(str, i.table(name).collect()))  # noqa: B023, E731
        assert rows(ix) == rows(cold) and rows(ix), name
    assert ix.vacuum() == 0 or ix.status()["tables"] == second
    other = Index(spark, ix.root, encoder=HashingEncoder(64))
    assert other.ensure(changed) == "vectors" and other.ensure(changed) == "reused"
    assert other.status()["tables"]["postings"] == second["postings"] and other.table("vectors").agg(F.max("idx")).first()[0] < 64
    assert ix.ensure(changed) == "vectors"
    e = Engine(spark, changed, index=ix)
    assert e.search("changed", mode="bm25").first()["file_path"] == "src/main.rs" and e.search("login auth", k=2).first()["file_path"] == "src/auth.py"
    assert [x["qualname"] for x in e.outline("auth.py")["symbols"].collect()] == ["Auth", "Auth.login", "Auth.out"]
    assert ix.vacuum() >= 1 and ix.table("vectors").count() > 0
    assert ix.clean() and ix.status() is None


def test_cache_upsert_and_stale(spark):
    cache = spark.createDataFrame([("r", "a", 1, 2, 3, "x"), ("r", "b", 1, 2, 3, "x")], "repo string, rel_path string, mtime_secs long, mtime_nanos int, size long, language string")
    fresh = spark.createDataFrame([("r", "b", 9, 9, 9, "y"), ("r", "c", 9, 9, 9, "y")], cache.schema)
    out = {r["rel_path"]: r["language"] for r in upsert(cache, fresh, ["repo", "rel_path"]).collect()}
    assert out == {"a": "x", "b": "y", "c": "y"}
    assert upsert(cache, fresh, ["repo", "rel_path"], fresh).count() == 2
    files = spark.createDataFrame([("r", "a", 3, 10**9 + 2), ("r", "b", 4, 10**9 + 2)], "repo string, rel_path string, length long, mtime_ns long")
    assert [r["rel_path"] for r in stale(files, cache).collect()] == ["b"]


def test_streams(spark, tmp_path):
    from stratalith.streaming.pipelines import event_windows, follow_signatures

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("props")
    events.repartition(2).write.parquet(f"{tmp_path}/ev")
    stream = event_windows(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev"), late="400 days")
    q = stream.writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["events"] for r in spark.table("w").collect()}
    assert got == {(r["start"], r["event_type"]): r["events"] for r in event_windows(events).collect()}
    sigs, runs, cache, _ = _log(spark)
    sigs.coalesce(1).write.parquet(f"{tmp_path}/sig")
    store = IncrementalStore(spark, f"file://{tmp_path}/st")
    s = spark.readStream.schema(sigs.schema).parquet(f"{tmp_path}/sig")
    for _ in range(2):  # the second start finds nothing new
        follow_signatures(s, store, cache, f"{tmp_path}/sink", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/sink").select("repo", "rel_path").distinct().count() == spark.read.parquet(f"{tmp_path}/sink").count() > 0


def test_stream_processes_every_row_of_a_batch_and_replays(spark, tmp_path):
    from stratalith.streaming.pipelines import follow_signatures

    _, _, cache, at = _log(spark)
    parts = [[(1, "r", "a", 1, 1, at(5), at(9))], [(2, "r", "b", 1, 1, at(5), at(9))], [(3, "r", "c", 1, 1, at(4), at(8))]]
    store = IncrementalStore(spark, f"file://{tmp_path}/st")
    follow = lambda store, to="cp": follow_signatures(spark.readStream.schema(SIGS).parquet(f"{tmp_path}/sig"), store, cache, f"{tmp_path}/sink", f"{tmp_path}/{to}").awaitTermination(120)
    seen = lambda: sorted(x["rel_path"] for x in spark.read.parquet(f"{tmp_path}/sink").collect())
    for k, rows in enumerate(parts):  # equal and falling loaded_at
        spark.createDataFrame(rows, SIGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/sig")
        follow(store)
        assert seen() == ["a", "b", "c"][: k + 1]

    class Dying(IncrementalStore):
        def run(self, *args, **kinds):
            super().run(*args, **kinds)
            raise RuntimeError("died after the commit")

    spark.createDataFrame([(4, "r", "q", 1, 1, at(5), at(10))], SIGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/sig")
    with pytest.raises(Exception, match="died after the commit"):
        follow(Dying(spark, store.root))
    assert seen() == ["a", "b", "c"] and store.last_commit()["n"] == 4
    follow(store)
    assert seen() == ["a", "b", "c", "q"] and store.last_commit()["n"] == 4
    follow(store, "another")
    assert seen() == ["a", "b", "c", "q"]


def test_sql_of_all_queries_parses():
    from stratalith.plans import catalogue

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    for name, sql in catalogue.ORACLE.items():
        con.execute(sql).fetchall()
        assert name in catalogue.QUERIES
