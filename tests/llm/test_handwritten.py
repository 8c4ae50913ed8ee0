"""Problem 3: grammar inference is lossless and exhausts pairs; each kind of file and its traps."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm import handwritten
from stratalith.llm.handwritten import Library, file_origins, handwritten_chunks, judge, shared_rules
from stratalith.llm.repair import expand, fingerprints, infer, lengths, reuse, shapes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_repair_round_trip(tokens):
    g = infer(tokens, 4)
    assert [t for s in g.sequence for t in expand(g, s)] == tokens
    assert [len(expand(g, 4 + i)) for i in range(len(g.rules))] == lengths(g)
    pairs = Counter(p for p in zip(g.sequence, g.sequence[1:]) if p[0] != p[1])
    assert max(pairs.values(), default=0) <= 1


WRITTEN = """import tools
from kit import Thing

def load(path, limit=None):
    with open(path) as f:
        rows = [line.split(',') for line in f if line.strip()]
    if limit is not None:
        rows = rows[:limit]
    total = sum(len(r) for r in rows)
    print('rows', len(rows), 'cells', total)
    return Thing(rows, total=total, source=path)

def merge(a, b, key='id'):
    seen = {x[key]: x for x in a}
    for y in b:
        if y[key] in seen and seen[y[key]]['at'] > y['at']:
            continue
        seen[y[key]] = dict(y, merged=True)
    return sorted(seen.values(), key=lambda z: z[key])
"""
rng = random.Random(3)
CONSTS = "".join(f"pub const {rng.choice('ABCDEFG')}{i}_X: u32 = {i * 7};\n" for i in range(30))
MINI = "".join(f"function {a}{i}(n,t){{for(var r=0;r<n.length;r++)t.push(n[r].k{i});return t}}" for i, a in enumerate("abcdefghij"))
TABLE = "values = [\n" + "".join("    " + ", ".join(str(rng.randint(-999, 99999)) for _ in range(10)) + ",\n" for _ in range(30)) + "]\n"
BASE64 = 'export default "data:x;base64,' + "".join(rng.choice("ABCDEFGHabcdefghijklmnop0123456789+/") for _ in range(900)) + '";\n'
LOCK = '{\n "lockVersion": 3,\n "packages": {\n' + ",\n".join(f'  "m/{i}": {{"version": "1.{i}", "integrity": "sha-{rng.randrange(16**24):024x}"}}' for i in range(20)) + "\n }\n}\n"
LIB = """import os
import struct


class Reader:
    limit = 4096

    def __init__(self, handle, order='<'):
        self.handle, self.order = handle, order
        self.offset = 0

    def take(self, fmt):
        size = struct.calcsize(self.order + fmt)
        data = self.handle.read(size)
        if len(data) != size:
            raise EOFError('short read at %d' % self.offset)
        self.offset += size
        return struct.unpack(self.order + fmt, data)

    def skip(self, count):
        self.handle.seek(count, os.SEEK_CUR)
        self.offset += count
        return self.offset <= self.limit
"""

CASES = [
    ("a/b.py", WRITTEN, None), ("a/b.py", "", None), ("a/vendors/b.py", WRITTEN, None), ("a/external_api.py", WRITTEN, None), ("a/x_pb2.py", WRITTEN, None), ("a/generated/b.py", WRITTEN, None),
    ("a/b.py", "# Ported by hand from the old generated client; please edit freely.\n" + WRITTEN, None), ("a/b.py", "# Emits the 'DO NOT EDIT' and '@generated' banner for stubs.\n" + WRITTEN, None),
    ("a/b.py", WRITTEN + "print('Code generated by x. DO NOT EDIT.')\n", None), ("a/b.js", "// " + "one very long remark; " * 60 + "\nlet a = 1;\nfunction f(x) {\n  return x + a;\n}\n", None), ("c/settings.json", '{"a": [1, 2], "b": {"c": "d e"}}', None),
    ("a/b.py", "# Code generated by wire 3. DO NOT EDIT.\n" + WRITTEN, "generated"), ("a/b.rs", "// Automatisch erzeugt aus x.sql - bitte nicht von Hand bearbeiten.\nfn f() {}\n", "generated"), ("a/b.c", "/*\n * @generated by kit from x\n */\nint a;\n", "generated"),
    ("a/b.py", WRITTEN + "\n# Autogenerated by forge, do not touch\n# checksum 59925744efe40af3\n", "generated"), ("a/b.c", "int f(void);\n/* This file was automatically generated from x.idl. */\n", "generated"), ("a/b.h", "#ifndef A\nint f(void);\n#endif\n", None), ("a/b.py", WRITTEN + "\n# Emits the '@generated' banner.\n", None),
    ("a/b.rs", CONSTS, "generated"), ("a/package-lock.json", LOCK, "lock"), ("a/other.json", LOCK, "lock"), ("a/b.js", MINI, "minified"), ("a/b.js", "/*! kit v3 */\n" + MINI, "minified"), ("a/b.py", TABLE, "data"), ("a/b.ts", BASE64, "data"),
    ("a/vendor/b.py", WRITTEN, "vendored"), ("node_modules/x/b.js", "let a = 1", "vendored"), ("a\\third_party\\b.py", WRITTEN, "vendored"), ("a/copy.py", LIB.replace("limit", "most"), "copied"), ("a/copy.py", LIB, "copied"),
]


@pytest.mark.parametrize("path,text,want", CASES)
def test_kinds_of_files(path, text, want):
    raw = shapes(LIB.replace("Reader", "Object"))[0]
    assert judge(path, text, Library([(7, raw, fingerprints(raw))]))[0] == want


def test_reuse_tells_tables_from_code():
    assert reuse(shapes(CONSTS)[1]).cover > 0.9 > 0.5 > reuse(shapes(WRITTEN)[1]).cover
    assert reuse([]).ratio == 1.0


def test_dataframe_contract(spark):
    rows = [(1, "r", "a.py", WRITTEN.encode(), 1), (1, "r", "a.py", WRITTEN.encode(), 1), (2, None, "vendor/x.c", b"", 2), (3, "r", None, CONSTS.encode(), 3), (4, "r", "n.py", None, 4), (5, "r", "c.py", LIB.encode(), 5), (6, "r", "l.go", b"package a\n" * 20000, 6)]
    files = spark.createDataFrame(rows, "file_id long, repo string, rel_path string, content binary, reason int")
    lib = spark.createDataFrame([(9, LIB), (9, LIB), (8, None)], "lib_id long, content string")
    got = {x["file_id"]: (x["reason"], x["lib_id"]) for x in file_origins(files, lib).collect()}
    assert got[1] == (None, None) and got[2][0] == "vendored" and got[3][0] == "generated" and got[4] == (None, None) and got[5] == ("copied", 9)
    assert file_origins(files.limit(0), lib.limit(0)).count() == 0
    chunks = spark.createDataFrame([(1, "r", "a.py"), (2, None, "vendor/x.c"), (3, "r", "c.py"), (4, "s", "c.py")], "chunk_id long, repo string, file_path string")
    assert {x[0] for x in handwritten_chunks(chunks, file_origins(files, lib)).select("chunk_id").collect()} == {1, 4}


def test_a_library_beyond_one_pass_finds_the_same_copies(spark, monkeypatch):
    files = spark.createDataFrame([(1, "r", "a.py", WRITTEN.encode()), (2, "r", "b.py", LIB.replace("limit", "most").encode()), (3, "r", "c.py", LIB.encode()), (4, "r", "d.py", None)], "file_id long, repo string, rel_path string, content binary")
    lib = spark.createDataFrame([(i, LIB.replace("Reader", f"R{i}") if i < 6 else WRITTEN.replace("rows", f"x{i}").replace("total", f"t{i}")) for i in range(9)], "lib_id long, content string")
    once = sorted(map(str, file_origins(files, lib).collect()))
    monkeypatch.setattr(handwritten, "LIBRARY_MB", type("Small", (int,), {"__lshift__": lambda self, n: 2_000})(1))
    assert sorted(map(str, file_origins(files, lib).collect())) == once and len(once) == 4


def test_shared_rules_count_repositories(spark):
    own = "".join(f"alpha{i} = beta{i} + alpha{i} + beta{i}\n" for i in range(30)) + "gamma = delta(gamma, delta(gamma, delta(gamma)))\n" * 4
    rows = [(i, f"r{i}", "a.py", WRITTEN.encode()) for i in range(3)] + [(7, "r0", "b.py", WRITTEN.encode()), (8, None, "c.py", own.encode()), (9, "r9", "d.py", b"x = 1\n"), (9, "r9", "d.py", b"x = 1\n")]
    files = spark.createDataFrame(rows, "file_id long, repo string, rel_path string, content binary")
    lib = spark.createDataFrame([], "lib_id long, content string")
    got = {x["file_id"]: x for x in shared_rules(files, lib).collect()}
    rules = len(set(fingerprints(shapes(WRITTEN)[0])))
    assert len(got) == 6 and all(got[i]["rules"] == rules and got[i]["share"] == 1.0 for i in (0, 1, 2, 7))
    assert got[8]["rules"] > 0 and got[8]["shared"] == 0 and (got[9]["rules"], got[9]["share"]) == (0, 0.0)
    assert shared_rules(files.limit(0), lib).count() == 0
