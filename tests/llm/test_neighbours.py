"""Problem 1: exact semantics on small tables, recall against brute force on a larger one."""

import numpy as np
import pytest

from stratalith.llm import neighbours
from stratalith.llm.neighbours import nearest, similar_pairs
from stratalith.llm.quantise import fit


def brute(rows, k, least):
    rows = {i: np.array(v, np.float64) for i, v in rows}
    ids = sorted(rows)
    u = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    s = u @ u.T
    out = {}
    for a, i in enumerate(ids):
        order = sorted((-round(s[a, b], 12), j) for b, j in enumerate(ids) if j != i)[:k]
        out[i] = [j for c, j in order if -c >= least]
    return out


def clustered(n, seed=3, dim=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, dim))
    x = centres[r.integers(0, len(centres), n)] + 0.25 * r.normal(size=(n, dim))
    return [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(x)]


def test_small_collection_is_exact_with_copies_and_dirt(spark):
    rows = clustered(60)
    rows += [(100 + i, rows[3][1]) for i in range(12)] + [(200, rows[5][1])]
    dirt = [(900, None), (901, [1.0] * 63), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [None] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    df = spark.createDataFrame(rows + rows[:9] + dirt, "vec_id bigint, embedding array<float>")
    got = {}
    for x in nearest(df, 5).orderBy("vec_id", "rank").collect():
        got.setdefault(x["vec_id"], []).append(x["neighbour"])
    assert got == brute(rows, 5, -1)
    pairs = {(min(a, b), max(a, b)) for a, v in brute(rows, 5, 0.85).items() for b in v}
    assert {tuple(x) for x in similar_pairs(df).collect()} == pairs


def test_recall_on_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "MEMBER_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 400)
    rows = clustered(3000, 9)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(x["vec_id"], x["neighbour"]) for x in nearest(df, 5, 0.7).collect()}
    want = {(a, b) for a, v in brute(rows, 5, 0.7).items() for b in v}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    exact = {(x["vec_id"], x["neighbour"]) for x in nearest(df, 5, 0.7, probes=None).collect()}
    assert exact == want


def test_a_third_of_all_rows_in_one_tight_cluster(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEMBER_BLOCK", 100)
    r = np.random.default_rng(5)
    rows = clustered(1400, 4)
    tight = r.normal(size=64) + 0.02 * r.normal(size=(700, 64))
    rows += [(5000 + i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(tight)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(x["vec_id"], x["neighbour"]) for x in nearest(df, 5, 0.7).collect()}
    want = {(a, b) for a, v in brute(rows, 5, 0.7).items() for b in v}
    assert len(got & want) >= 0.95 * len(want)


def test_codes_order_like_exact_distances():
    x = np.array([v for _, v in clustered(800)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = fit(x, 4, books=6, words=32)
    assert len(q.cells) == 4 and q.cells.nearest(x, 9).shape == (len(x), 4)
    many = fit(x, 40 * 40, books=2, words=8).cells  # more words than the beam looks at
    assert many.nearest(x[:5], 16).shape == (5, 16) and sorted(many.nearest(x[:2], len(many))[1]) == list(range(len(many)))
    centres = (many.first[:, None] + many.second[None]).reshape(len(many), -1)
    best = ((x[:50, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (many.nearest(x[:50], 1)[:, 0] == best).mean() > 0.9
    codes, lengths = q.encode(x)
    back = q.decode(codes)
    assert np.allclose(lengths, (back**2).sum(1), atol=1e-4)
    assert np.allclose(q.distances(x[:9], codes, lengths), lengths[None, :] - 2 * x[:9] @ back.T, atol=1e-3)
    assert ((x - back) ** 2).sum(1).mean() < 0.5 * ((x - x.mean(0)) ** 2).sum(1).mean()


@pytest.mark.parametrize("rows", [[], [(1, [1.0] * 64)]])
def test_too_few_rows(spark, rows):
    assert nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).count() == 0
