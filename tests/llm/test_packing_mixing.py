"""Problems 8 and 9: whole results, bounds against brute force, shares within their tolerance."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.mixing import feasible_total, mix, rake, shares
from stratalith.llm.packing import container_use, difference, fill_containers, pack
from stratalith.llm.sizes import PIECE, count_tokens, encoding, with_sizes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40), st.integers(1, 7))
def test_differencing_keeps_every_item_once(sizes, ways):
    groups = difference(sizes, ways)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes))) and len(groups) <= max(ways, 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_pack_stays_within_capacity(sizes):
    groups = pack(sizes, 50)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= 50 for g in groups)


def test_differencing_is_nearly_even_and_packing_nearly_full():
    r = random.Random(1)
    sizes = [r.randint(1, 400) for _ in range(500)]
    sums = [sum(sizes[i] for i in g) for g in difference(sizes, 20)]
    assert max(sums) - min(sums) <= 20
    assert len(pack(sizes, 2048)) <= -(-sum(sizes) // 2048) + 1


def test_fill_containers_contract(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1, 5, 60, 100, 101, 250, 1000])) for i in range(3000)] + [(9001, None), (9002, 0), (None, 5), (7, 1)]
    rows = [x for x in rows if x[0] != 7] + [(7, 1), (7, 1)]
    items = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id bigint, tokens bigint, container string")
    specs = spark.createDataFrame([("s", 100), ("s", 100), ("l", 700), ("bad", 0), ("null", None)], "spec_name string, capacity int")
    out = fill_containers(items, specs).collect()
    want = {(a, b) for a, b in rows if a is not None and b}
    for spec, cap in (("s", 100), ("l", 700)):
        mine = [x for x in out if x["spec_name"] == spec]
        per, use = defaultdict(int), defaultdict(int)
        for x in mine:
            per[x["doc_id"]] += x["tokens"]
            use[x["container"]] += x["tokens"]
        assert dict(per) == dict(want) and max(use.values()) <= cap
        parts = Counter(x["doc_id"] for x in mine)
        assert all(parts[d] == -(-t // cap) for d, t in want)
    assert {x["spec_name"] for x in out} == {"s", "l"}
    assert all(x["used"] > 0.9 for x in container_use(fill_containers(items, specs)).collect())
    assert fill_containers(items.limit(0), specs).count() == 0


def test_sizes_of_whole_texts(spark):
    enc = encoding()
    long = ("word " * 3 + "\n  x ") * (PIECE // 10)
    assert count_tokens(long, enc) == len(enc.encode_ordinary(long)) and count_tokens("x" * 3 * PIECE, enc) > 1000
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {x["doc_id"]: x["tokens"] for x in with_sizes(df).collect()} == {1: 2, 2: 0, 3: 0}


def test_rake_meets_sources_and_keeps_other_marginals():
    r = np.random.default_rng(0)
    source, lang = np.repeat([0, 1, 2], 4), np.tile([0, 1, 2, 3], 3)
    tokens = r.integers(100, 1000, 12).astype(float)
    targets = np.array([300.0, 500.0, 200.0])
    x = rake(tokens, np.full(12, 9.0), source, targets, [lang])
    assert np.allclose(np.bincount(source, x * tokens), targets)
    supply = np.bincount(lang, tokens) / tokens.sum()
    assert np.allclose(np.bincount(lang, x * tokens) / 1000, supply, atol=1e-3)
    capped = rake(tokens, np.full(12, 0.1), source, targets, [lang])
    assert (capped <= 0.1 + 1e-12).all()
    assert feasible_total(np.array([10.0, 0, 30]), np.array([0.5, 0.2, 0.5]), np.array([2.0, 1, 1])) == pytest.approx(40)


def test_mix_contract(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["Web ", "web", "wiki", "forum", None, "other"]), r.choice(["en", "EN", None, "de-XX"]), f"web/t{i % 5}/a.md", r.randint(20, 900)) for i in range(4000)]
    rows += [(9000, "web", "en", None, None), (9001, "web", "en", None, 0), (None, "web", "en", None, 5), (0, *rows[0][1:])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, source string, lang string, doc_path string, tokens bigint, copies int")
    targets = spark.createDataFrame([("web", 0.5, 1), ("wiki", 0.3, 3), ("forum", 0.1, 1), ("none", 0.1, 2), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mix(docs, targets)
    got = mixed.collect()
    caps = {"web": 1, "wiki": 3, "forum": 1}
    assert len({x["doc_id"] for x in got}) == len(got) and all(1 <= x["copies"] <= caps[x["source"]] for x in got)
    reached = {x["source"]: x["share"] for x in shares(mixed, targets).collect()}
    for s, t in (("web", 5 / 9), ("wiki", 3 / 9), ("forum", 1 / 9), ("none", 0)):
        assert reached[s] == pytest.approx(t, abs=0.01)
    more = shares(mix(docs, targets, total=10**7), targets).collect()
    assert {x["source"]: x["tokens"] for x in more}["wiki"] == 3 * sum(x[4] for x in rows[:4000] if x[1] == "wiki")
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


def test_the_cluster_rakes_large_cell_tables_to_the_same_rates(spark, monkeypatch):
    from stratalith.llm import mixing

    r = random.Random(5)
    cells = [(s, l, t, r.randint(1, 900)) for s in ("web", "wiki", "forum") for l in ("en", "de") for t in ("a", "b", "c") if r.random() < 0.9]
    share, caps = {"web": 4000.0, "wiki": 3000.0, "forum": 900.0}, {"web": 1.0, "wiki": 3.0, "forum": 1.0}
    code = np.array([list(share).index(c[0]) for c in cells])
    number = lambda k: np.unique([c[k] for c in cells], return_inverse=True)[1]
    want = rake(np.array([c[3] for c in cells], float), np.array([caps[c[0]] for c in cells]), code, np.array(list(share.values())), [number(1), number(2)], 6)
    got = mixing.rake_cluster(spark.createDataFrame(cells, "source string, lang string, topic string, tok bigint"), share, caps, 6)
    rates = {tuple(x)[:3]: x["rate"] for x in got.collect()}
    assert [rates[c[:3]] for c in cells] == pytest.approx(want, rel=1e-6)
    monkeypatch.setattr(mixing, "CELLS", 0)
    monkeypatch.setattr(mixing, "rake_cluster", lambda *a, f=mixing.rake_cluster: f(*a, 2))
    docs = spark.createDataFrame([(i, r.choice(["web", "wiki"]), "en", f"x/{i % 3}/a", r.randint(5, 9)) for i in range(600)], "doc_id bigint, source string, lang string, doc_path string, tokens bigint")
    targets = spark.createDataFrame([("web", 0.25, 2), ("wiki", 0.75, 4)], "source string, target_share double, max_repeats int")
    assert {x["source"]: x["share"] for x in shares(mix(docs, targets), targets).collect()} == pytest.approx({"web": 0.25, "wiki": 0.75}, abs=0.01)


def test_p9_takes_its_size_from_the_supply(spark, monkeypatch):
    from stratalith.llm import queries

    docs = [(i, "web" if i % 4 else "forum", "en", f"web/t{i % 3}/a.md", "word " * (40 + i % 7)) for i in range(800)] + [(9000, "Wiki ", "en", "wiki/t/a.md", "word " * 30)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id bigint, source string, lang string, doc_path string, text string"),
        "mix_targets": spark.createDataFrame([("web", 0.5, 2), ("forum", 0.3, 4), ("wiki", 0.2, 4)], "source string, target_share double, max_repeats int"),
    }
    monkeypatch.setattr(queries, "table", lambda spark, d, name: tables[name])
    supply = Counter()
    for x in with_sizes(tables["documents"]).collect():
        supply[x["source"].strip().lower()] += x["tokens"]
    have = sum(supply.values())
    got = {x["source"]: x for x in queries.p9_shares(spark, "").collect()}
    assert got["web"]["tokens"] == pytest.approx(0.5 * have, rel=0.01) and got["forum"]["tokens"] == pytest.approx(0.3 * have, rel=0.01)
    assert got["wiki"]["tokens"] == 4 * supply["wiki"] and got["wiki"]["share"] < 0.01
