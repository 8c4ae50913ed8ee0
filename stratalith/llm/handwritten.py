"""Generated, minified or vendored source files, and data saved as code.

Re-Pair grammars over token sequences give the evidence: a rule of a line's length whose copies
cover most of a file marks generated tables; literals that no grammar shortens mark data; rules
shared with known third-party files mark copies. Reading the head comment, the folder and the
line shape covers files whose text alone looks written by hand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalith.llm.repair import fingerprints, infer, number, reuse, shapes
from stratalith.operators.scale import lookup_join, materialise, spread

COVER = 0.7  # share of tokens under copies of one rule from which a file counts as generated
LEAST_TOKENS = 40  # shorter files say nothing by their grammar
COPY = 0.5  # shingle similarity from which a file counts as a copy of a library file
LIBRARY_MB = 8  # of library texts (some 100 MB as tokens) are sent to the executors at once; a larger library goes in several passes
MINIFIED = 0.45  # symbols of the grammar per token below which long lines count as minified
REPOS = 3  # repositories in which a rule must occur to count as shared

# Folders in which third-party code is kept.
_FOLDERS = re.compile(r"(?:^|/)(?:_?vendor|vendored|third[_-]?party|external|externals|node_modules|bower_components|jspm_packages|Godeps|site-packages)/", re.I)

# What generators say of their output in the file's first comment.
_MADE = re.compile(
    r"code generated by|auto[- ]?generated|automatically (?:generated|created|produced)|<auto-generated|@generated\b|generated (?:from|by|with|using|code|file)"
    r"|this (?:file|code) (?:is|was|has been) (?:\w+ )?(?:generated|produced|created)|machine[- ]generated|produced by \w+|output (?:of|for) \S+|regenerate with|(?:erzeugt|generiert|erstellt) (?:aus|von|durch|mit)"
    r"|(?:produit|généré|genere|engendré) (?:par|à partir|automatiquement)|généré|generado (?:por|a partir|automáticamente)|gerado (?:por|automaticamente)|generato (?:da|automaticamente)",
    re.I,
)
_HANDS_OFF = re.compile(
    r"do not (?:edit|modify|touch|change)|don't (?:edit|modify|touch)|not (?:be )?edit(?:ed)?|edit \S+ instead|changes? (?:are|is|will be|made here)[\w ]*(?:lost|overwritten|discarded)|will be (?:lost|overwritten)"
    r"|overwritten|regenerate|nicht (?:von hand |manuell )?(?:bearbeiten|ändern|editieren)|ne pas (?:modifier|éditer|toucher)|no (?:editar|modificar|tocar)|não (?:editar|modificar)|non modificare|checksum [0-9a-f]{8}",
    re.I,
)
# Signs that the comment speaks of generated code but the file is kept by hand.
_BY_HAND = re.compile(r"ported by hand|by hand from|edit freely|kept by hand|hand[- ](?:written|kept|maintained)|(?:emits?|writes?|prints?|adds?) the ['\"`]|maintained manually|feel free to edit|no longer generated|formerly generated|originally generated|was once generated", re.I)
_HEAD = re.compile(r"\s*(?:#![^\n]*\n)?((?:\s*(?:(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|pragma)\b)|--)[^\n]*(?:\n|$)|/\*[\s\S]*?\*/))+)")
_DOCSTRING = re.compile(r'\s*(?:"""([\s\S]*?)"""|\'\'\'([\s\S]*?)\'\'\')')
_COMMENTS = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?://|\#)[^\n]*|/\*[\s\S]*?\*/""")
_COMMENT_LINE = re.compile(r"[ \t]*(?://|#(?!\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma)\b)|--)")
_GENERATED = re.compile(r"generat|erzeugt|produ|génér|gener", re.I)
_SCRIPTS = frozenset(["js", "mjs", "cjs", "ts", "mts", "jsx", "tsx", "css"])
_HASH = re.compile(r"[0-9a-f]{16,}|[A-Za-z0-9+/]{24,}={0,2}")


def head_comment(text: str) -> str:
    m = _HEAD.match(text)
    head = m.group(1) if m else ""
    doc = _DOCSTRING.match(text, m.end() if m else 0)
    return head + (doc.group(1) or doc.group(2) or "" if doc else "")


def tail_comment(text: str) -> str:
    """The comment with which the file ends."""
    text = text.rstrip()
    if text.endswith("*/"):
        return text[max(0, text.rfind("/*")) :]
    at = len(text)
    while at > 0:
        start = text.rfind("\n", 0, at) + 1
        if not _COMMENT_LINE.match(text, start):
            break
        at = start - 1
    return text[max(0, at) :].strip()


def banner(text: str) -> bool:
    """The first or last comment says that a tool made the file, and not that people keep it."""
    for part in (head_comment(text), tail_comment(text)):
        if part and not _BY_HAND.search(part) and _MADE.search(part) and (_HANDS_OFF.search(part) or _GENERATED.search(part)):
            return True
    return False


def minified(text: str, ext: str, ratio: float) -> bool:
    """Script that stands on lines no person writes and whose grammar is far smaller than that of
    code people wrote: the few short names recur, so rules are reused everywhere."""
    if ext not in _SCRIPTS or ratio >= MINIFIED:
        return False
    code = _COMMENTS.sub(lambda m: "''" if m.group(1) else " ", text)
    code = code.strip()
    if len(code) < 200:
        return False
    lines = [x for x in code.split("\n") if x.strip()]
    long = sum(len(x) for x in lines if len(x) > 200)
    names = re.findall(r"[^\W\d]\w*", code)
    # arrays of numbers have long lines too, but hardly a name
    return long > 0.6 * len(code) and len(names) > 0.05 * len(code)


def blob(raw: list[str], shape: list[str], size: int) -> bool:
    """Most of the text is literals, and no grammar makes these much shorter."""
    literals = [r for r, s in zip(raw, shape) if s in ("N", "S")]
    chars = sum(map(len, literals))
    if size < 400 or chars < 0.5 * size:
        return False
    texts = [r for r, s in zip(raw, shape) if s == "S" and len(r) >= 40 and " " not in r]
    if sum(map(len, texts)) > 0.5 * size:
        ids, base = number(list("".join(t[1:-1] for t in texts)))
        g = infer(ids, base)
        return (len(g.sequence) + 2 * len(g.rules)) / len(ids) > 0.35
    numbers = [r for r, s in zip(raw, shape) if s == "N"]
    if sum(map(len, numbers)) < 0.4 * size or len(numbers) < 80:
        return False
    ids, base = number(numbers)
    g = infer(ids, base)
    return (len(g.sequence) + 2 * len(g.rules)) / len(ids) > 0.6


def locked(text: str, cover: float) -> bool:
    """Resolved dependencies: one entry shape over and over, each with an incompressible digest."""
    entries = text.count("\n")
    return cover > 0.4 and entries > 3 and len(_HASH.findall(text)) >= 0.4 * entries and bool(re.search(r'"[^"]*(?:lock|integrity|resolved|checksum|digest|sha\d*)[^"]*"\s*:', text, re.I))


def shingles(raw: list[str], k: int = 5) -> frozenset[int]:
    return frozenset(hash(tuple(raw[i : i + k])) for i in range(len(raw) - k + 1))


class Library:
    """Known third-party files (lib_id, tokens, rule fingerprints): rules find candidates, shingles
    settle them. Rules and tokens are inferred once by ``library_index``, not here."""

    def __init__(self, files: list[tuple[int, list[str], list[int]]]):
        self.by_rule: dict[int, list[int]] = {}
        self.texts: dict[int, list[str]] = {}
        for lib_id, raw, rules in files:
            self.texts[lib_id] = raw
            for rule in rules:
                self.by_rule.setdefault(rule, []).append(lib_id)
        self._sets: dict[int, frozenset[int]] = {}

    def copied(self, raw: list[str], rules: list[int]) -> tuple[int | None, float]:
        """(library file of which these tokens are a copy, perhaps with small changes, similarity).

        Candidates share a rule; every candidate is compared exactly, none is cut off. Ties go to
        the smaller lib_id."""
        found = sorted({lib for rule in set(rules) for lib in self.by_rule.get(rule, ())})
        best, most, mine = None, 0.0, None
        for lib in found:
            a, b = len(raw), len(self.texts[lib])
            if min(a, b) < COPY * max(a, b) * 0.8:
                continue
            if mine is None:
                mine = shingles(raw)
            if lib not in self._sets:
                self._sets[lib] = shingles(self.texts[lib])
            both = len(mine & self._sets[lib])
            similar = both / max(1, len(mine) + len(self._sets[lib]) - both)
            if similar >= COPY and similar > most:
                best, most = lib, similar
        return best, most


def judge(path: str, text: str, library: Library) -> tuple[str | None, float, float, int | None, float, list[int]]:
    """(reason or None for hand-written, grammar ratio, rule cover, lib_id, similarity, rules)."""
    path = (path or "").replace("\\", "/")
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    raw, shape = shapes(text)
    use = reuse(shape)
    rules = fingerprints(raw) if len(raw) >= LEAST_TOKENS else []
    lib, similar = library.copied(raw, rules)
    if _FOLDERS.search(path):
        why = "vendored"
    elif lib is not None:
        why = "copied"
    elif ext == "json":
        why = "lock" if locked(text, use.cover) else None
    elif banner(text):
        why = "generated"
    elif minified(text, ext, use.ratio):
        why = "minified"
    elif blob(raw, shape, len(text)):
        why = "data"
    elif len(raw) >= LEAST_TOKENS and use.cover >= COVER and not _BY_HAND.search(head_comment(text)) and _entries(raw, shape):
        why = "generated"
    else:
        why = None
    return why, use.ratio, use.cover, lib, similar, sorted(set(rules))


def _entries(raw: list[str], shape: list[str]) -> bool:
    """The copies state values and end alike (constants, cases, stubs), as prose does not."""
    values = sum(s in ("N", "S") for s in shape)
    names = sum(s == "I" for s in shape)
    return values >= 0.02 * len(shape) and names < 0.6 * len(shape) and len(set(raw)) > 0.05 * len(raw)


_KEYS = ["file_id", "repo", "rel_path"]
_FOUND = "reason string, ratio double, cover double, lib_id bigint, similar double, rules array<bigint>"
_KINDS = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]


def _judge_batches(shared):
    state: list[Library] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.append(Library(shared.value))
        for batch in batches:
            rows = [
                judge(p, c.decode("utf-8", "replace"), state[0]) if c is not None else (None,) * len(_KINDS)
                for p, c in zip(batch["rel_path"].to_pylist(), batch["content"].to_pylist())
            ]
            cols = list(zip(*rows)) if rows else [[]] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in _KEYS), *[pa.array(list(c), k) for c, k in zip(cols, _KINDS)]], [*_KEYS, *(x.split()[0] for x in _FOUND.split(", "))])

    return run


def _library_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = [shapes(t)[0] for t in batch["content"].to_pylist()]
        rules = [sorted(set(fingerprints(r))) if len(r) >= LEAST_TOKENS else None for r in raws]
        kept = [r if f is not None else None for r, f in zip(raws, rules)]
        yield pa.RecordBatch.from_arrays([batch["lib_id"], batch["bytes"], pa.array(kept, pa.list_(pa.string())), pa.array(rules, pa.list_(pa.int64()))], ["lib_id", "bytes", "raw", "rules"])


def library_index(library: DataFrame) -> DataFrame:
    """(lib_id, bytes, raw, rules) of the library files that are long enough to compare, written
    once: their grammars are inferred here and nowhere else."""
    rows = library.where(F.col("content").isNotNull() & F.col("lib_id").isNotNull()).select(
        F.col("lib_id").cast("bigint").alias("lib_id"), F.octet_length("content").cast("bigint").alias("bytes"), F.col("content").cast("string").alias("content")
    ).distinct()
    indexed = rows.mapInArrow(_library_batches, "lib_id bigint, bytes bigint, raw array<string>, rules array<bigint>")
    return materialise(indexed.where(F.col("rules").isNotNull()))


def judged(files: DataFrame, library: DataFrame, *wanted: str) -> DataFrame:
    """The ``wanted`` columns of ``file_origins``, of ``similar``, the similarity to lib_id, and of
    ``rules``, the hashes of the file's own grammar rules, once per distinct file row."""
    columns = [F.col("file_id").cast("bigint").alias("file_id"), "repo", "rel_path", F.col("content").cast("binary").alias("content")]
    index = library_index(library)
    size = index.agg(F.sum("bytes")).first()[0] or 0
    passes = max(1, -(-size // (LIBRARY_MB << 20)))
    schema = f"file_id bigint, repo string, rel_path string, {_FOUND}"
    spark, out = files.sparkSession, None
    for n in range(passes):
        part = index.where(F.pmod(F.xxhash64("lib_id"), F.lit(passes)) == n).select("lib_id", "raw", "rules").orderBy("lib_id").collect()  # LIBRARY_MB of texts
        shared = spark.sparkContext.broadcast([(r["lib_id"], list(r["raw"]), list(r["rules"])) for r in part])
        once = spread(files.select(*columns)).mapInArrow(_judge_batches(shared), schema)
        if passes == 1:
            return once.select(*_KEYS, *wanted).distinct()
        out = once if out is None else out.unionByName(once)
    # a file is judged in every pass; the pass with the most similar library file speaks for it
    order = Window.partitionBy(*_KEYS, "ratio", "cover", "rules").orderBy(F.col("similar").desc_nulls_last(), F.col("lib_id").asc_nulls_last())
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).select(*_KEYS, *wanted)


def file_origins(files: DataFrame, library: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, reason, ratio, cover, lib_id) once per distinct file row.

    ``reason`` is vendored, copied, lock, generated, minified or data; null means written by hand
    (or null content). Empty files are written by hand; a null path has no folder or extension.
    Repeated rows count once, extra columns are ignored, an empty library finds no copies.

    One narrow pass over whole texts in Arrow batches for every LIBRARY_MB of library texts; the
    library's grammars are inferred once."""
    return judged(files, library, "reason", "ratio", "cover", "lib_id")


def shared_rules(files: DataFrame, library: DataFrame, repos: int = REPOS) -> DataFrame:
    """(file_id, repo, rel_path, reason, rules, shared, share): how many grammar rules a file has and
    how many of them occur in files of at least ``repos`` repositories, third-party code and shared
    templates alike. Files without rules have share 0; a null repository counts as one.

    Rules are counted in a table of their own, combined before the shuffle; a rule in very many
    files is joined by broadcast (``lookup_join``), so no task holds it."""
    rows = materialise(judged(files, library, "reason", "rules"))
    each = rows.select(*_KEYS, F.explode("rules").alias("rule"))
    per_repo = each.groupBy("rule", "repo").agg(F.count(F.lit(1)).alias("n"))
    counts = per_repo.groupBy("rule").agg(F.count(F.lit(1)).alias("in_repos"), F.sum("n").alias("n"))
    met = lookup_join(each, materialise(counts), ["rule"], "n")
    per_file = met.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("in_repos") >= repos).alias("shared"))
    a, b = rows.select(*_KEYS, "reason").distinct(), per_file.withColumnsRenamed({k: f"_{k}" for k in _KEYS})
    same = a["file_id"].eqNullSafe(b["_file_id"]) & a["repo"].eqNullSafe(b["_repo"]) & a["rel_path"].eqNullSafe(b["_rel_path"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, same, "left").select(
        *_KEYS, "reason", zero("n_rules").alias("rules"), zero("shared").alias("shared"), F.round(F.coalesce(F.col("shared") / F.col("n_rules"), F.lit(0.0)), 6).alias("share")
    )


def handwritten_chunks(chunks: DataFrame, origins: DataFrame) -> DataFrame:
    """``chunks`` of files that are not known to be made otherwise (an anti-join on repo and path)."""
    made = origins.where(F.col("reason").isNotNull()).select(F.col("repo").alias("_r"), F.col("rel_path").alias("_p")).distinct()
    cond = chunks["repo"].eqNullSafe(made["_r"]) & (chunks["file_path"] == made["_p"])
    return chunks.join(made, cond, "left_anti")
