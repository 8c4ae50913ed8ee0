"""Literal expectations of the expression builders and driver-side functions."""

import pytest
from pyspark.sql import functions as F

from stratalith.functions import intent, lines, paths, text, vectors


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


def test_tokens(spark):
    want = ["gethttpresponse", "get", "http", "response", "my_func", "my", "func"]
    assert text.tokenize_str("getHTTPResponse my_func") == want
    assert col(spark, "getHTTPResponse my_func", text.tokenize) == want
    for t in ("_x", "a1B2c", "XMLHttp2Request", "__init__", "é über9", "", "fooBar_baz", "A"):
        assert col(spark, t, text.tokenize) == text.tokenize_str(t)
    assert text.split_identifier_str("_x") == ["_x"]


@pytest.mark.parametrize(
    "query,alpha",
    [("MyService", 0.25), ("parse_json", 0.25), ("parse hunk header", 0.35), ("how does routing work", 0.65), ("request lifecycle architecture", 0.65), ("how is the request handled?", 0.65), ("useSession hook", 0.45), ("request validation and error handling", 0.55)],
)
def test_semantic_weight(query, alpha):
    assert intent.semantic_weight(query) == alpha
    assert intent.semantic_weight(query, 0.7) == 0.7
    with pytest.raises(ValueError):
        intent.semantic_weight(query, 1.5)


def test_intent():
    i = intent.intent("where is the public API of ChunkStore tested in test block")
    assert {"public_api", "test"} <= i.wants and "chunkstore" in i.identifiers and i.about_paths
    assert intent.symbol_name("a::b.c") == "b.c" and intent.symbol_name("a.b.c") == "c" and intent.symbol_name(" x ") == "x"


@pytest.mark.parametrize(
    "source,lang,want",
    [
        ("// a\n\nfn f() {}\n/* b\n c */\nlet x = 1; // d\n", "rust", (6, 1, 3)), ("/* a /* b */ c */\n", "rust", (1, 0, 1)), ("/* a /* b */ c */\n", "go", (1, 0, 0)), ('let u = "http://x";\n', "rust", (1, 0, 0)),
        ("x = 1", "python", (1, 0, 0)), ("", "python", (0, 0, 0)), ("/*\n\n*/\n", "c", (3, 1, 2)), ("# a\nx = '#'\n", "python", (2, 0, 1)), ("fn f<'a>(x: &'a str) {} // b\n", "rust", (1, 0, 0)), ("{\n  \n}", "json", (3, 1, 0)), ("<!-- a\nb -->\n<p>\n", "html", (3, 0, 2)),
        ('let s = "a\n// b\n";\n', "rust", (3, 0, 0)),
    ],
)
def test_count_lines(source, lang, want):
    assert lines.count_lines(source, lang) == want


def test_line_stats_and_detection(spark):
    df = spark.createDataFrame([(b"// a\nx\n", "rust"), (None, "rust"), (b"a\n", None)], "c binary, l string")
    got = [tuple(r["s"]) if r["s"] else None for r in df.select(lines.line_stats("c", "l").alias("s")).collect()]
    assert got[0] == (2, 0, 1) and got[2] == (1, 0, 0) and (got[1] is None or got[1] == (None, None, None))
    names = {"a/Dockerfile": "dockerfile", "Makefile": "make", "a.txt": None, "a.RS": "rust", "b.tsx": "tsx", "LICENSE": None, "a.log": None}
    for name, want in names.items():
        assert col(spark, name, lines.detect) == want


def test_paths(spark):
    assert col(spark, "a/b/c/d/MyFile.test.ts", paths.stem) == "myfile.test" and col(spark, ".env", paths.stem) == ".env"
    assert col(spark, "a/b/c/d/e.ts", paths.last_dirs) == ["b", "c", "d"] and col(spark, "e.ts", paths.last_dirs) == []
    for path, kind, want in [("tests/a.py", "test", True), ("a/b_test.go", "test", True), ("atests/a.py", "test", False), ("docs/x", "docs", True), ("a/README.md", "docs", True), ("a/vendor/x", "vendor", True), ("vendors/x", "vendor", False), ("a/gen/x", "generated", True), ("a.pb.go", "generated", True), ("a.d.ts", "types", True), ("legacy/a", "compat", True), ("examples/a", "examples", True)]:
        assert col(spark, path, lambda c, k=kind: paths.is_kind(c, k)) == want, (path, kind)
    for glob, yes, no in [("*.rs", "a.rs", "b/a.rs"), ("**/*.rs", "b/a.rs", "b/a.go"), ("src/**", "src/a/b", "lib/a"), ("a?.{ts,js}", "ab.js", "abc.js"), ("[!a]*.c", "b.c", "a.c")]:
        rx = paths.glob_regex(glob)
        assert col(spark, yes, lambda c: c.rlike(rx)) and not col(spark, no, lambda c: c.rlike(rx))
    for p in ("vendor/a", "x/vendor/a", "vendor", "x/vendor"):
        assert not col(spark, p, lambda c: paths.exclude(c, ["vendor"]))
    assert col(spark, "vendors/a", lambda c: paths.exclude(c, ["vendor"]))
    assert col(spark, "a/b", lambda c: paths.under(c, ["a/"])) and not col(spark, "ab/b", lambda c: paths.under(c, ["a"])) and col(spark, "x", lambda c: paths.under(c, [""]))
    for bad in ("", "/etc", "../x", "a/../b", "C:\\x"):
        with pytest.raises(ValueError):
            paths.valid_relative(bad)


def test_word_matches(spark):
    for a, b, want in [("caches", "cache", True), ("conf", "config", True), ("co", "config", False), ("a", "b", False)]:
        assert col(spark, a, lambda c: paths.word_matches(c, F.lit(b))) == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.dot(vectors.unit(F.col("a")), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in got] == [pytest.approx(0.6), 0.0]


@pytest.mark.parametrize("content,want", [("class Foo {", True), ("  pub fn foo()", False), ("def Foo(", True), ("type a::Foo\n", True), ("create table Foo (", True), ("classFoo {", False), ("class Foobar", False)])
def test_definition_regex(spark, content, want):
    assert col(spark, content, lambda c: c.rlike(intent.definition_regex(["Foo"]))) == want
