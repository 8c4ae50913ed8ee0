"""Problems 4, 6 and 7 against brute force, with the hot path forced by a small bound."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from stratalith.llm.distinctive import distinctive_terms, log_entropy
from stratalith.llm.rankmix import fused_top, rank_walk, ranked_sources, stationary, walk_top
from stratalith.llm.topn import top_n


def brute_top(rows, n):
    groups = defaultdict(set)
    for g, s, i, x in rows:
        if s is not None and s == s:
            groups[g].add((s, i, x))
    return {(g, s, i) for g, v in groups.items() for s, i, x in sorted(v, key=lambda t: (-t[0], t[1]))[:n]}


@pytest.mark.parametrize("floor", [10**6, 20])
def test_top_n_equals_brute_force(spark, floor):
    r = random.Random(5)
    rows = [("hot", float(r.choice([1, 2, 3, 50, r.random()])), i, "x") for i in range(600)]
    rows += [("flat", 1.0, i, "x") for i in range(300)] + [(None, float(i % 4), 5000 + i, "") for i in range(40)]
    rows += [(f"g{i % 7}", r.choice([None, float("nan"), r.random()]), 9000 + i, "y" * 1000) for i in range(60)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "g string, s double, id long, rank string")
    got = top_n(df, ["g"], "s", ["id"], 3, heavy_floor=floor)
    assert {(x["g"], x["s"], x["id"]) for x in got.collect()} == brute_top(rows, 3)
    assert got.count() == len(brute_top(rows, 3))


def test_top_n_empty_and_bad_n(spark):
    df = spark.createDataFrame([], "g string, s double, id long")
    assert top_n(df, ["g"], "s", ["id"], 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["g"], "s", ["id"], 0)


@pytest.mark.parametrize("floor", [10**6, 5])
def test_log_entropy_equals_brute_force(spark, floor):
    r = random.Random(2)
    rows = [("the", i, r.randint(1, 9)) for i in range(80)] + [(f"t{r.randint(0, 30)}", 100 + i, r.randint(1, 5)) for i in range(90)]
    rows = list({(t, d): (t, d, tf) for t, d, tf in rows}.values())
    dirty = rows + rows[:10] + [("zero", 1, 0), ("null", 2, None), (None, 3, 4), ("n", None, 2)]
    got = {(x["term"], x["doc_id"]): x["weight"] for x in log_entropy(spark.createDataFrame(dirty, "term string, doc_id long, tf int"), floor).collect()}
    n = len({d for _, d, _ in rows})
    gf = defaultdict(int)
    for t, _, tf in rows:
        gf[t] += tf
    h = defaultdict(float)
    for t, _, tf in rows:
        h[t] -= tf / gf[t] * math.log(tf / gf[t])
    assert got.keys() == {(t, d) for t, d, _ in rows}
    for t, d, tf in rows:
        assert got[t, d] == pytest.approx(math.log(1 + tf) * max(0, 1 - h[t] / math.log(n)), abs=1e-9)


def test_distinctive_terms_bounds(spark):
    p = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("b", 1, 9), ("c", 1, 3), ("c", 3, 3), ("c", 4, 2)], "term string, doc_id long, tf int")
    c = spark.createDataFrame([(1, 180), (2, 181), (3, None)], "chunk_id long, doc_len int")
    assert {(x["doc_id"], x["term"]) for x in distinctive_terms(p, c).collect()} == {(1, "a"), (1, "c")}
    assert distinctive_terms(p.limit(0), c).count() == 0


def transition(ranks, weights, damping):
    n, m = ranks.shape
    p = np.full((n, n), (1 - damping) / n)
    for s in range(m):
        for i in range(n):
            better = [j for j in range(n) if ranks[i, s] == 0 or 0 < ranks[j, s] <= ranks[i, s]]
            for j in better:
                p[i, j] += damping * weights[s] / (n if ranks[i, s] == 0 else ranks[i, s])
    return p


def test_stationary_is_the_fixed_point():
    r = np.random.default_rng(1)
    ranks = np.stack([r.permutation(9) + 1, np.r_[r.permutation(6) + 1, 0, 0, 0]], axis=1)
    x = stationary(np.zeros(9, int), ranks, np.tile([0.3, 0.7], (9, 1)), 0.85, 500)
    assert np.allclose(x @ transition(ranks, [0.3, 0.7], 0.85), x, atol=1e-9)


def hits(seed, per):
    r = random.Random(seed)
    rows = []
    for q, k in per.items():
        for i in range(k):
            rows.append((q, i, r.choice(["bm25", " BM25 "]), r.choice([r.random() * 20, 5.0]), len(rows)))
            if r.random() < 0.8:
                rows.append((q, i + 3, r.choice(["semantic", "Semantic"]), r.random(), len(rows)))
    rows += [(99, 1, "bm25", 3.0, 0), (98, 1, "semantic", None, 1), (98, 2, "bm25", float("nan"), 2), (1, 5, "hybrid", 9.0, 3), (None, 1, "bm25", 1.0, 4)]
    return rows + rows[:20]


def test_heavy_walk_and_ranks_equal_the_light_path(spark):
    df = spark.createDataFrame(hits(3, {1: 60, 2: 15}), "query_id long, chunk_id long, source string, score double, x long")
    q = spark.createDataFrame([(1, 0.3), (2, None)], "query_id long, alpha double")
    sources = ["bm25", "semantic"]
    weights = q.selectExpr("query_id", "coalesce(alpha, 0.5) as w_semantic", "1 - coalesce(alpha, 0.5) as w_bm25")
    out = []
    for floor in (10**6, 30):
        ranks = ranked_sources(df.where("query_id < 3"), "query_id", "chunk_id", "source", "score", sources, floor)
        walked = rank_walk(ranks, weights, "query_id", "chunk_id", sources, steps=5, heavy_floor=floor)
        out.append({(x["query_id"], x["chunk_id"]): (x["rank_bm25"], x["rank_semantic"], round(x["walk"], 6)) for x in walked.collect()})
    assert out[0] == out[1] and len(out[0]) > 70


def test_fused_top_equals_brute_force(spark):
    rows = hits(4, {1: 30, 2: 4, 3: 1})
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, source string, score double, x long")
    q = spark.createDataFrame([(1, 0.3), (1, 0.3), (2, None)], "query_id long, alpha double")
    best = defaultdict(dict)
    for qid, c, s, v, _ in rows:
        s = s.strip().lower()
        if qid is not None and s in ("bm25", "semantic") and v is not None and v == v:
            best[qid, s][c] = max(v, best[qid, s].get(c, -1))
    want = set()
    for qid in {k[0] for k in best}:
        if (qid, "bm25") in best and (qid, "semantic") in best:
            a = {1: 0.3}.get(qid, 0.5)
            sums = defaultdict(float)
            for s, w in (("semantic", a), ("bm25", 1 - a)):
                for n, (c, _) in enumerate(sorted(best[qid, s].items(), key=lambda t: (-t[1], t[0])), 1):
                    sums[c] += w / (60 + n)
            want |= {(qid, c) for c in sorted(sums, key=lambda c: (-round(sums[c], 12), c))[:5]}
    assert {(x["query_id"], x["chunk_id"]) for x in fused_top(df, q).collect()} == want
    assert fused_top(df.limit(0), q).count() == 0
    walked = walk_top(df, q, 3).collect()
    assert {x["query_id"] for x in walked} == {k for k, _ in want} and max(x["place"] for x in walked) == 3
    for qid in {x["query_id"] for x in walked}:
        mass = [x["walk"] for x in sorted(walked, key=lambda x: x["place"]) if x["query_id"] == qid]
        assert mass == sorted(mass, reverse=True)
    assert walk_top(df.limit(0), q).count() == 0


def test_large_groups_take_the_same_steps_as_small_ones(spark, monkeypatch):
    from stratalith.llm import rankmix

    r = random.Random(6)
    a, b = r.sample(range(1, 25), 24), r.sample(range(1, 25), 24)
    ranks = spark.createDataFrame([(1, i, a[i], b[i] if b[i] < 16 else None) for i in range(24)], "g long, i long, rank_a long, rank_b long")
    weights = spark.createDataFrame([(1, 0.7, 0.3)], "g long, w_a double, w_b double")
    kept, written = rankmix.materialise, []
    monkeypatch.setattr(rankmix, "materialise", lambda df: written.append(1) or kept(df))
    walk = lambda floor: {x["i"]: x["walk"] for x in rank_walk(ranks, weights, "g", "i", ["a", "b"], damping=0.3, steps=60, heavy_floor=floor).collect()}
    light = walk(10**6)
    assert walk(1) == pytest.approx(light, rel=1e-9) and len(written) < 30
