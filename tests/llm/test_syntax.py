"""Problem 2: derivatives against exact parsers where Python has one, and literals elsewhere."""

import ast
import json
from pathlib import Path

import pyarrow.dataset as ds
import pytest

from stratalith.llm.syntax.check import check, language_of
from stratalith.llm.syntax.derivatives import Grammar
from stratalith.llm.validity import invalid_rates, syntax_verdicts

VALID = {
    "python": [
        "", "# only a comment\n", "x = [i for i in range(3) if i]\n", "def f(a, *, b: int = 1, **k) -> None:\n    return a\n", "async def f():\n    async with a as b, c:\n        await d\n",
        "match x:\n    case {'a': [1, *r], **k} if r:\n        pass\n    case Point(x=0) | None as p:\n        pass\n", "a, *b = c = yield_ = d\nx: int = 3\nx += 1\n", "try:\n    pass\nexcept* E as e:\n    raise X from e\nfinally:\n    pass\n",
        "print(f'{a!r:>{w}}', *b, sep='')\nlambda *a, k=1, **q: (yield_)\n", "class A[T](B, metaclass=M):\n\n    @d.e(1)\n    def f(self): ...\n", "if (n := 3) > 2: pass\nelif not a: pass\nelse:\n  pass", "x = '''a\n<<<<<<< HEAD\n'''\n",
        "with (open(a) as b, c): pass\n", "for i, in x: a[1:2, ..., ::3] = 1j\n", "type = 3\nmatch = type\nprint(match)\n",
    ],
    "javascript": [
        "", "#!/usr/bin/env node\nlet a = 1\nlet b = a\n++b\n", "const re = /[({]x\\)?/g, d = a / b / c;", "const f = async ({ a, b: [c] = [] }, ...r) => { await 1 }", "for await (const x of y()) { if (x) continue; else break }",
        "export default class extends A { #p = 1; static { } get x() { return this.#p } static async *g() { yield* h() } 'q' = 2 }", "const s = `a ${b + `${c}`} } {`;", "import d, { x as y } from 'm'; export * as z from 'q'",
        "label: for (;;) { do x++; while (x < 3) break label }", "!function(g){g.exports={a:1e2,w:!0}}(s);q.x=h&&h.x||{}", "return_ = x\n(y)", "const o = { ...a, get b() { return 1 }, async c() {}, [d]: 1, e, 'f': 2, 3: 4 };", "if (a) b; else c\nswitch (x) { case 1: default: }", "a?.b?.[c]?.(d) ?? e", "[a, b] = [b, a]; ({ a, b } = c)",
    ],
    "typescript": [
        "interface A<T> extends B { x?: Record<string, T[]>; readonly [k: string]: unknown; f(a: number): void\n new (x: A): A }", "type X = { [K in keyof T]?: T[K] } & (A | B)[] | ((x: number) => void)", "export abstract class A<T extends B = C> implements D { constructor(private readonly x: number, y?: string) { super() } abstract f(): void; static z!: number; }",
        "const f = <T,>(x: T): x is string => x as any satisfies U; g<A>(b); const h = a! as B", "enum E { A = 1, B, 'c' = 3 } declare module 'm' { export const x: number }", "function f(this: A, x: string): asserts x is 'a';\nfunction f(x) { return x }", "export type { A } from './a'; import type { B } from './b'", "type C = T extends [infer H, ...infer R] ? H : never; let x: typeof a.b; let t: [a: string, b?: number]", "const PATTERN: RegExp = /[({]batch\\)?/g;\nlet v = a < b, w = c > d;",
    ],
    "rust": [
        "", "#![allow(dead_code)]\n#[derive(Debug, Clone)]\npub struct A<'a, T: B + 'a = C> where T: D { pub x: &'a str, y: HashMap<String, Vec<u64>> }", "fn f(&mut self, x: &[u32]) -> Option<u64> { if x == y { return 1; } let z = A { x, ..y }; for i in 0..n { z.push(i) } match z { Some(ref a) if *a > 1 => {} 1..=3 | 'a' => (), _ => return None } x? }",
        "const S: &str = r#\"\n<<<<<<< \"HEAD\n\"#; /* a /* nested */ b */", "impl<T> Iterator for X<T> { type Item = T; fn next(&mut self) -> Option<Self::Item> { self.0.take().map(|x| x as u32 + 1) } }", "macro_rules! m { ($a:expr) => { $a + 1 }; } println!(\"{}\", 1);", "fn f() { let Some(x) = y else { return }; let c = move |a: u8, b| -> u8 { a }; 'l: loop { break 'l 3 }; if let Some(x) = a && b {} vec![1, 2].iter().collect::<Vec<_>>(); }", "pub(crate) async unsafe fn f<const N: usize>(x: impl Fn(u8) -> u8 + 'static, y: Box<dyn A>) where for<'a> F: Fn(&'a u8) {}", "use a::{b::{self, C as D}, *}; mod x; trait T: A { const X: u8 = 1; fn f(); }",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T struct {\n\ta, b string `json:\"a\"`\n\t*E\n}\n\nfunc (t *T) f(a []int, b ...string) (x int, err error) {\n\tif v, ok := m[k]; ok {\n\t\treturn\n\t} else if x {\n\t}\n\tfor i := range a {\n\t\tgo func() { c <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\treturn T{a: 1, b: []int{1, 2}}, nil\n}\n", "package a\n\nvar x = map[string][]T{\n\t\"a\": {{1}, {2}},\n}\n\nfunc f[K comparable, V int | ~string](k K) {\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\t}\nL:\n\tfor {\n\t\tbreak L\n\t}\n}\n", "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar s = `a\n=======\n`\n",
    ],
    "java": [
        "package a.b;\n\nimport java.util.*;\n\n/** doc */ public final class A<T extends B & C> extends D implements E<F[]> { private static final int[] X = {1, 2}; static { } A(int x, String... y) throws G { this.x = x; } <U> void f() { for (var a : b) { if (a instanceof H h && h.i()) continue; } List<Map<String, int[]>> q = new ArrayList<>() { }; q.stream().map(String::valueOf).filter((x) -> x > 1).toList(); int y = (int) z + (A) w; } }", "sealed interface S permits A, B { int f(); default void g() { } } record P(int x, @N String y) implements S { P { } } enum E { A(1) { void f() { } }, B; int x; }", "class A { String t = \"\"\"\n  a \"b\n  \"\"\"; int f(Object o) { return switch (o) { case 1, 2 -> 3; default -> { yield 4; } }; } @Override public void g() { try (var r = h()) { } catch (A | B e) { throw e; } finally { } synchronized (this) { a[i++] += b ? c : d; } } }",
    ],
    "c": [
        "", "#include <stdio.h>\n#define X(a) \\\n  ((a) + 1)\n#if X\n#endif\n\ntypedef struct a { int x : 3; char y[64]; } a_t;\nstatic const char *f(int a, const char *b, ...) { for (int i = 0; i < n; i++) { g(i, (a_t *)p); } return b ? b[1] : \"x\" \"y\"; }\nint (*fp)(void) = 0;\nenum e { A = 1, B, };\nint t[] = { [0] = 1, 2 };\n", "unsigned long long f(size_t n) { a_t x = { .x = 1 }; a * b; do { x.y->z++; } while (*p); goto out; out: switch (c) { case 'a': break; default: ; } return sizeof(int) + sizeof x; }\n",
    ],
    "json": ["{}", ' [1, -2.5e3, "a\\u00e9\\n", {"x": null, "y": [true, false]}]\n', "3"],
}
INVALID = {
    "python": ["def f(:\n  pass\n", "x = (1\n", "if x\n  y\n", "a = 'b\n", "def f():\nreturn 1\n", "  x\n", "f() = 1\n", "a + b = 2\n", "x = 9c1\n", "print(“a”)\n", "<<<<<<< HEAD\n", "x = \"\"\"a\n", "{{ name }}(x) = 1\n", "a b\n", "for x in y:\n", "package a;\n\nclass A {}\n", "import a from b\n", "not = 1\n"],
    "javascript": ["let x: number = 1", "const x;", "f(", "a b", "}", "`a ${b", "/* a", "const a = 'b", "{\"a\": 1, \"b\": 2}", "if (a { b }", "interface A { }", "function <%= x %>() {}", "x = {{ a }} b", "import x", "a + b = c"],
    "typescript": ["function f(x: number {}", "type A = ;", "class A { f( }", "const x = {", "def f(x):\n  pass\n", "let a: Map<string, number = b", "use a::b;"],
    "rust": ["fn f() { let x = ; }", "fn f( {}", "pub(crate fn f() {}", "fn @@N@@() {}", "fn f() { a b }", "struct A { x: u8", "/* a /* b */", "import a from 'b';", "fn f() { \"abc }", "package a\n"],
    "go": ["func f() {}\n", "package a\n\nfunc f( {\n}\n", "package a\n\nfunc f() {\n\tx := \n}\n", "package a\n\nfunc f() {\n\tg(“a”)\n}\n", "package a\n\nfunc f()\n{\n", "package a\n\nvar s = `a\n", "package a\n\n=======\n", "package a\n\nfunc f() {\n\tif x == T{1} {\n\t}\n"],
    "java": ["class A { int f( { } }", "class A { void f() { int x = 1 } }", "class A { String s = \"a; }", "class A {", "function f() {}", "class A { void f() { a b c; } }", "{\"a\": 1}", "class A { void f() { } static int g() { "],
    "c": ["int f( {", "int main() { return 0 }", "#includ <a>\n", "#if A\n", "int f() { x = ; }", "char *s = \"a;\n", "<<<<<<< HEAD\n", "static int @@NAME@@(int x) { }", "int a = 1;\n}\n", "/* a"],
    "json": ["", "{\"a\": 1,}", "[1 2]", "{a: 1}", "01", "{\"a\": 'b'}", "[1", "// c\n{}", "NaN", "\"a\nb\""],
}


@pytest.mark.parametrize("lang", VALID)
def test_valid_texts(lang):
    for text in VALID[lang]:
        assert check(text, lang).valid, (text, check(text, lang))


@pytest.mark.parametrize("lang", INVALID)
def test_invalid_texts(lang):
    for text in INVALID[lang]:
        assert not check(text, lang).valid, text


def test_reason_tells_truncation_from_a_failing_token():
    assert check("def f(a,", "python").reason == "truncated"
    assert check("int f(void) { return 1;", "c").reason == "truncated"
    v = check("a b", "javascript")
    assert (v.reason, v.offset) == ("token", 2)


def test_own_library_agrees_with_the_exact_python_parser():
    for path in Path(ast.__file__).parent.glob("[a-j]*.py"):
        text = path.read_text("utf-8", "replace")
        if len(text) > 60_000:
            continue
        assert check(text, "python").valid, (path, check(text, "python"))


def test_test_tables_agree_with_exact_parsers():
    rows = ds.dataset("/root/testdata/sf0.01/files.parquet").to_table(columns=["rel_path", "content"]).to_pylist()
    for r in rows:
        lang = language_of(r["rel_path"])
        if lang in ("python", "json"):
            try:
                ast.parse(r["content"]) if lang == "python" else json.loads(r["content"])
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            assert check(r["content"].decode("utf-8", "replace"), lang).valid == ok, r["rel_path"]


FORMATS = [
    "f'{a!r:>{w}}'", "f'{a['b']}'", "f'{{}} {x=}'", r"rf'\d{x}\''", r"f'\N{BULLET} {x}'", "f\"{f'{f\"{1}\"}'}\"", "f'{x:%H:%M}'", "f'{(lambda x: 1)}'", "f'{a != b}'", "f'''a''b'''", "f'{x = !r:^20}'", "f'{*a,}'",
    "f'{ {1:2}[1] }'", "f'''{\na\n:>10}\n'''", "f'{x:=5}'", "f'a' 'b' f\"{c}\"", "f'{a b}'", "f'{}'", "f'{a'", "f'}'", "f'{a!x}'", "f'{lambda x: 1}'", "f'a\n'", "f'{a!}'", "f'{a)}'", "f'''{a}", "f'{x:{y}'", "f'{a[}'",
]


@pytest.mark.parametrize("text", FORMATS)
def test_format_texts_agree_with_the_exact_parser(text):
    try:
        ast.parse(text + "\n")
        ok = True
    except SyntaxError:
        ok = False
    assert check(text + "\n", "python").valid == ok


NESTS = {
    "json": lambda n: '[{"a": ' * n + "1" + "}]" * n, "go": lambda n: "package a\n\nvar x = " + "f((" * n + "1" + "))" * n + "\n", "java": lambda n: "class A { L<" + "L<" * n + "T" + ">" * n + "> x = " + "(f(" * n + "1" + "))" * n + "; }",
    "rust": lambda n: "fn f(x: " + "Vec<" * n + "u8" + ">" * n + ") { " + "{ match x { _ => { (" * n + "1" + ") } } }" * n + " }", "c": lambda n: "int x = " + "f((" * n + "1" + "))" * n + "; int f() { " + "if (x) {" * n + "}" * n + " }",
    "javascript": lambda n: "x = " + "f([(function () { return (" * n + "1" + ") })])" * n + ";", "typescript": lambda n: "let x: " + "A<" * n + "B" + ">" * n + " = " + "{a: [" * n + "1" + "]}" * n + ";", "python": lambda n: "x = " + "f([(" * n + "1" + ")])" * n + "\n",
}


@pytest.mark.parametrize("lang", NESTS)
def test_deep_nests_are_valid_and_an_open_one_is_not(lang):
    text = NESTS[lang](3_000)
    assert check(text, lang).valid
    assert not check(text[: len(text) // 2], lang).valid


def test_tables_shrink_within_one_text(monkeypatch):
    from stratalith.llm.syntax import derivatives
    from stratalith.llm.syntax.grammars import grammar

    monkeypatch.setattr(derivatives, "MAX_NODES", 2_000)
    g = grammar("json")
    g.reset()
    before = g.resets
    assert check("[" + ", ".join('{"a": ' * (i % 40) + "1" + "}" * (i % 40) for i in range(3_000)) + "]", "json").valid
    assert not check("[" * 5_000 + "]" * 4_999 + "}", "json").valid
    assert g.resets > before


def test_grammar_tables_reset_when_they_outgrow_their_bound(monkeypatch):
    from stratalith.llm.syntax import derivatives

    g = Grammar("file = 'a' file 'b' | 'c'", "file")
    monkeypatch.setattr(derivatives, "MAX_NODES", 10)
    state = g.fresh()
    for t in "aaaaaacbbbbbb":
        state = g.derive(state, t)
    assert state.nullable
    assert g.fresh() is g.start and len(g.table) < 10


def test_dataframe_contract(spark):
    rows = [
        (1, "r", "a.py", None, b"x = 1\n", 1), (1, "r", "a.py", None, b"x = 1\n", 1), (2, "r", "b.PY", "go", b"x = (\n", 2), (3, None, "c.json", "json", b"", 3),
        (4, "r", "README", None, b"(", 4), (5, "r", None, None, b"(", 5), (6, "r", "d.c", "c", None, 6), (7, "r", "e.go", "go", b"package a\n" + b"// x\n" * 20000, 7), (8, "r", "f.js", None, b"'\xff'", 8),
    ]
    df = spark.createDataFrame(rows, "file_id long, repo string, rel_path string, language string, content binary, valid int")
    got = {x["file_id"]: (x["valid"], x["reason"], x["line"]) for x in syntax_verdicts(df).collect()}
    assert got == {1: (True, None, None), 2: (False, "truncated", 2), 3: (False, "truncated", 1), 4: (None,) * 3, 5: (None,) * 3, 6: (None,) * 3, 7: (True, None, None), 8: (True, None, None)}
    rates = {(x["repo"], x["checked_as"]): (x["files"], x["invalid"], x["rate"]) for x in invalid_rates(df).collect()}
    assert rates["r", "python"] == (2, 1, 0.5) and rates[None, "json"] == (1, 1, 1.0)
    assert syntax_verdicts(df.limit(0)).count() == 0
