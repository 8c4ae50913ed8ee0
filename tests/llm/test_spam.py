"""Problem 10: segments, statistics against brute force, and each sort of page."""

import math
import random
from collections import Counter

import pytest

from stratalith.llm import spam
from stratalith.llm.segments import segments, words_of
from stratalith.llm.spam import spam_documents, spam_shares

rng = random.Random(5)
NOUNS = "index layout filter cursor schema batch token route shard query vector parser".split()


def prose(n):
    forms = ["The {} behind the {} waits for the {} to load, as the tests show.", "A {} without a {} is skipped, and the summary says how many were left out.", "Please do not change the {} by hand because the next run of the {} will write it again.", "Each {} has a start and an end line, so a {} can point at the exact place."]
    return " ".join(_fill(rng.choice(forms)) for _ in range(n))


def _fill(form):
    while "{}" in form:
        form = form.replace("{}", rng.choice(NOUNS), 1)
    return form


SALAD = " ".join(rng.choice(["cheap", "index", "tool", "buy", "shard", "online", "best"]) for _ in range(150))
PAGES = {
    "salad": SALAD,
    "mock": "Looking for shard tool? Our shard tool is the shard tool for any shard tool. " * 12,
    "links": "\n".join(f"https://a{i}.example/x" for i in range(30)),
    "labels": "\n".join(f"- [shard tool](https://a{i}.example/x)" for i in range(30)),
    "tags": " ".join(f"#ShardTool{c}" for c in "ABCDEFGHIJKL"),
    "items": "\n".join(f"Shard Tool B{i} - {i}4.99 - cheap free - SKU {i}77" for i in range(20)),
}
FINE = {
    "explained": "\n".join(f"- [shard](https://a{i}.example/x) - {_fill('The {} behind the {} waits for the {} to load, as the tests show.')}" for i in range(12)),
    "references": prose(20) + "\n\n" + "\n".join(f"[{i}] https://a{i}.example/x" for i in range(9)),
    "code": "How to call it:\n```\n" + "shard.push(shard);\n" * 60 + "```\n",
    "table": "| shard | tool |\n|---|---|\n" + "| shard tool | shard tool |\n" * 40,
    "trace": prose(2) + "\n" + "    at openShard (shard/tool.ts:3:4)\n" * 40,
}


@pytest.fixture(scope="module")
def shares(spark):
    docs = [(i, prose(rng.randint(3, 30))) for i in range(300)]
    names = list(PAGES) + list(FINE)
    docs += [(1000 + i, (PAGES | FINE)[n]) for i, n in enumerate(names)]
    docs += [(2000, None), (2001, ""), (2002, " \n "), (None, "x y"), (2003, prose(3000))]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id bigint, text string, share double")
    got = {x["doc_id"]: x["share"] for x in spam_shares(df).collect()}
    return names, got, docs


def test_kinds_of_pages(shares):
    names, got, _ = shares
    for i, n in enumerate(names):
        assert (got[1000 + i] > 0.5) == (n in PAGES), (n, got[1000 + i])
    assert all(got[i] < 0.5 for i in range(300)) and got[2003] < 0.5
    assert not {2000, 2001, 2002, None} & set(got)


def test_statistics_equal_brute_force(spark, shares, monkeypatch):
    _, got, docs = shares
    parts = {d: segments(t) for d, t in docs if d is not None and t}
    n = sum(1 for p in parts.values() if p)
    cw, cp = Counter(), Counter()
    for p in parts.values():
        cw.update({w for s in p if s.kind != "other" for w in s.words})
        cp.update({x for s in p if s.kind != "other" for x in zip(s.words, s.words[1:])})
    for d, p in parts.items():
        dn = Counter(x for s in p if s.kind != "other" for x in zip(s.words, s.words[1:]))
        size, items = sum(dn.values()), sum(s.kind == "item" for s in p)
        bad = all_ = 0
        for s in p:
            if s.kind == "head":
                continue
            all_ += s.chars
            kind = "prose" if s.kind == "item" and items < 3 else s.kind
            pairs = list(zip(s.words, s.words[1:])) if s.kind != "other" else []
            mean = sum(math.log(n * cp[x] / (cw[x[0]] * cw[x[1]])) for x in pairs) / len(pairs) if pairs else 0
            rep = sum(dn[x] >= 4 and dn[x] >= 0.008 * size and cp[x] <= max(1, 0.02 * n) for x in pairs)
            if kind in ("link", "tag", "item") or kind == "prose" and (len(pairs) >= 7 and mean < -2 or rep > 0.3 * len(pairs)):
                bad += s.chars
        if all_:
            assert got[d] == pytest.approx(bad / all_), d
    monkeypatch.setattr(spam, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(a, b) for a, b in docs], "doc_id bigint, text string")
    assert {x["doc_id"]: x["share"] for x in spam_shares(df).collect()} == pytest.approx(got)


def test_copies_are_judged_like_a_single_page(spark, monkeypatch):
    r = random.Random(8)
    pages = {"mock": PAGES["mock"], "salad": " ".join(r.choice(NOUNS) for _ in range(200))}
    docs = [(i, prose(12)) for i in range(120)]
    copied = [(1000 + 100 * k + i, text) for k, text in enumerate(pages.values()) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lambda rows: {x["doc_id"]: x["share"] for x in spam_shares(frame(rows)).collect()}
    single = found(docs + copied[::60])
    many = found(docs + copied + copied[:3] + docs[:2])
    assert many == pytest.approx({d: single[d] for d, _ in docs} | {d: single[1000 + 100 * k] for k in (0, 1) for d in range(1000 + 100 * k, 1060 + 100 * k)})
    assert {d for d, v in many.items() if v > 0.5} == {d for d, _ in copied}
    monkeypatch.setattr(spam, "BROADCAST_ROWS", 0)
    assert found(docs + copied) == pytest.approx(many)


def test_stuffing_counts_in_texts_of_any_length(spark):
    r = random.Random(9)

    def page(phrases, times):
        fixed = [" ".join("".join(r.choices("bcdfgklmnprst", k=6)) for _ in range(2)) for _ in range(phrases)]
        return " ".join(p for _ in range(times) for p in r.sample(fixed, phrases)) + "."

    pages = {1000: page(20, 10), 1001: page(200, 100), 1002: page(400, 60)}
    docs = [(i, prose(12)) for i in range(100)] + [(2000, prose(1200))]
    df = spark.createDataFrame([*docs, *pages.items()], "doc_id bigint, text string")
    got = {x["doc_id"]: x["share"] for x in spam_shares(df).collect()}
    assert {d for d, v in got.items() if v > 0.5} == set(pages)


def test_empty_table_and_words(spark):
    assert spam_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert words_of("L'index de 3 Übungen, foo_bar") == ["l'index", "de", "3", "übungen", "foo", "bar"]
