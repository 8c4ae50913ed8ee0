"""What a query asks for: semantic weight, keywords, identifiers and wishes about paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from stratalith.functions.text import STOPWORDS, tokenize_str

# Shapes of a symbol, and of a symbol within a text.
SYMBOL = re.compile(r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$")
EMBEDDED = re.compile(r"\b(?:[A-Z][a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+|[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]*[A-Za-z0-9])\b")
ARCHITECTURE = (" architecture", " design", " flow", " lifecycle", " pipeline")
QUESTIONS = ("how ", "what ", "where ", "when ", "why ", "which ", "who ")
STEM_TRIGGERS = "public api config schema builder worker reporter snapshot state task type error parser serializer deserializer router request response".split()
PUBLIC_WORDS = frozenset("api public function functions builder builders".split())
WISHES = {
    "test": "test tests spec assert expect fixture mock getbytext", "docs": "doc docs documentation readme changelog help usage guide", "vendor": "vendor thirdparty grammar",
    "generated": "generated codegen", "types": "declaration declarations typedef types type", "public_api": "public api barrel export exports", "component": "component components",
    "hook": "hook hooks", "route": "route routes loader params", "schema": "schema schemas model models", "config": "config configuration settings", "model": "model models",
    "cli": "cli command commands", "cache": "cache caches cached",
}
PHRASES = {"test": ("test file", "test block"), "types": (".d.ts",), "public_api": ("public api",)}
WEIGHTS = (("symbol", 0.25), ("question", 0.65), ("mixed", 0.45), ("keywords", 0.35), ("other", 0.55))


def is_symbol(query: str) -> bool:
    return bool(SYMBOL.match(query.strip()))


def query_class(query: str) -> str:
    low = query.strip().lower()
    if is_symbol(query):
        return "symbol"
    if any(w in low for w in ARCHITECTURE) or low.startswith(("how does ", "how are ")) or low.endswith("?") or low.startswith(QUESTIONS):
        return "question"
    if EMBEDDED.search(query) or any(is_symbol(re.sub(r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "", p)) for p in query.split()):
        return "mixed"
    return "keywords" if 1 <= len([w for w in tokenize_str(query) if len(w) > 1 and w not in STOPWORDS][:4]) <= 3 else "other"


def semantic_weight(query: str, alpha: float | None = None) -> float:
    """An explicit weight wins; it must lie in [0, 1], where the rerank's window form is exact."""
    if alpha is None:
        return dict(WEIGHTS)[query_class(query)]
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    return alpha


def symbol_name(query: str) -> str:
    """The part after the last separator, of the first separator kind that occurs."""
    for sep in ("::", "\\", "->", "."):
        if sep in query:
            return query.rsplit(sep, 1)[1]
    return query.strip()


@dataclass(frozen=True)
class Intent:
    query: str
    keywords: list[str]
    identifiers: list[str]
    wants: frozenset[str] = field(default_factory=frozenset)

    @property
    def about_paths(self) -> bool:
        return bool(self.identifiers) or 1 <= len(self.keywords) <= 4 or bool(self.wants)


def intent(query: str) -> Intent:
    tokens = tokenize_str(query)
    keywords = list(dict.fromkeys(w for w in tokens if len(w) > 1 and w not in STOPWORDS))
    found = [m.lower() for m in EMBEDDED.findall(query)]
    for part in query.split():
        part = re.sub(r"^[^A-Za-z0-9_.]+|[^A-Za-z0-9_.]+$", "", part)
        if len(part) > 2 and is_symbol(part):
            found.append(symbol_name(part).lower())
    low = query.strip().lower()
    from_keywords = ("test", "docs", "vendor", "generated", "types", "public_api")
    wants = {
        w for w, words in WISHES.items()
        if set(words.split()) & set(keywords if w in from_keywords else tokens) or any(p in low for p in PHRASES.get(w, ()))
    }
    return Intent(query, keywords, list(dict.fromkeys(found)), frozenset(wants))


# Words that open a definition.
DEFINING = ["class", "module", "defmodule", "def", "interface", "struct", "enum", "trait", "type", "func", "function", "object", "abstract class", "data class", "fn", "fun", "package", "namespace", "protocol", "record", "typedef"]
DEFINING_SQL = ["CREATE TABLE", "CREATE VIEW", "CREATE PROCEDURE", "CREATE FUNCTION"]


def definition_regex(names: list[str]) -> str:
    """A regex without look-around for a definition of one of ``names``."""
    some = "|".join(re.escape(n) for n in sorted(names))
    tail = r"\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*\$?(?:" + some + r")(?:\s|[<({:\[;]|$)"
    return rf"(?m:(?:^|\s)(?:{'|'.join(DEFINING)}){tail})|(?im:(?:^|\s)(?:{'|'.join(DEFINING_SQL)}){tail})"
