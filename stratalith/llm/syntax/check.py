"""Is a text valid in its language? The driver loop over tokens and derivatives."""

from __future__ import annotations

from typing import NamedTuple

from stratalith.llm.syntax.grammars import EXTENSIONS, grammar
from stratalith.llm.syntax.lexers import tokens


class Verdict(NamedTuple):
    valid: bool | None  # None: no language is known for the extension
    reason: str | None  # "token" (empty derivative) or "truncated" (end state not nullable)
    offset: int | None  # where the failing token begins, in characters


# After these words ECMAScript ends the statement at a line break.
_RESTRICTED = frozenset(["return", "break", "continue", "throw"])


def language_of(path: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def check(text: str, lang: str) -> Verdict:
    """Derive the language by each token in turn.

    ECMAScript's semicolon insertion is stated in derivatives as well: where the next token gives
    an empty derivative and a line break or ``}`` stands before it, a semicolon is tried first."""
    g = grammar(lang)
    state, empty = g.fresh(), g.empty
    derive, table, ecma = g.derive, g.table, lang in ("javascript", "typescript")
    prev = ""
    for cls, offset, newline in tokens(text, lang):
        nxt = state.by.get(cls)
        if ecma and newline and (prev in _RESTRICTED or cls in ("++", "--")):
            ended = derive(state, ";")
            if ended is not empty:
                state, nxt = ended, None
        if nxt is None:
            if cls == "CUT":
                return Verdict(False, "truncated", offset)
            nxt = derive(state, cls)
            if len(table) > g.limit:
                nxt = g.lighten(nxt)
                empty, table = g.empty, g.table
        if nxt is empty:
            if ecma and cls != "ERR" and (newline or cls == "}" or prev == ")"):
                # after ")" only the end of do-while may omit it, which its rule allows itself
                ended = derive(state, ";") if newline or cls == "}" else empty
                nxt = derive(ended, cls) if ended is not empty else empty
            if nxt is empty:
                return Verdict(False, "token", offset)
        state, prev = nxt, cls
    if not state.nullable and ecma:
        state = derive(state, ";")
    return Verdict(True, None, None) if state.nullable else Verdict(False, "truncated", len(text))
