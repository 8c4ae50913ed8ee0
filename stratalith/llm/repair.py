"""Re-Pair grammars of token sequences.

The most frequent pair of neighbouring symbols becomes a rule, again and again, until no pair
occurs twice. Positions are linked, so a replacement touches only its neighbours and the whole
inference takes time near the length of the sequence.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from hashlib import blake2b
from typing import NamedTuple


class Grammar(NamedTuple):
    sequence: list  # the start rule: terminals and rule numbers
    rules: list  # rule i (symbol ``base + i``) is a pair of symbols
    base: int
    uses: list  # occurrences of each rule in the text


def infer(tokens: list[int], base: int) -> Grammar:
    """Re-Pair over terminals 0..base-1. Ties go to the pair met first, so equal texts have equal
    grammars. A replacement makes pairs with its own new symbol only, so these are gathered apart
    and kept where they occur twice."""
    seq = list(tokens)
    n = len(seq)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    where: dict[tuple[int, int], set[int]] = {p: set() for p, c in Counter(zip(seq, seq[1:])).items() if c > 1}
    for i, pair in enumerate(zip(seq, seq[1:])):
        spots = where.get(pair)
        if spots is not None and not (pair[0] == pair[1] and i - 1 in spots and seq[i - 1] == pair[0]):
            spots.add(i)  # of aaa only the first aa counts
    heap = [(-len(s), k, p) for k, (p, s) in enumerate(where.items()) if len(s) > 1]
    ticks = len(where)
    heapq.heapify(heap)
    rules, uses = [], []
    while heap:
        count, k, pair = heapq.heappop(heap)
        spots = where.get(pair)
        if spots is None:
            continue
        if -count != len(spots):
            if len(spots) > 1:
                heapq.heappush(heap, (-len(spots), k, pair))
            continue
        symbol = base + len(rules)
        done = 0
        fresh: dict[tuple[int, int], set[int]] = {}
        first, second = pair
        for i in sorted(spots):
            j = right[i]
            if seq[i] != first or j >= n or seq[j] != second:
                continue
            before, after = left[i], right[j]
            if before >= 0:
                old = (seq[before], first)
                gone = where.get(old) or fresh.get(old)
                if gone:
                    gone.discard(before)
            if after < n:
                old = (second, seq[after])
                gone = where.get(old) or fresh.get(old)
                if gone:
                    gone.discard(j)
                left[after] = i
            seq[i], seq[j] = symbol, -1
            right[i] = after
            done += 1
            if before >= 0:
                new = (seq[before], symbol)
                spot = fresh.get(new)
                if spot is None:
                    fresh[new] = {before}
                elif not (new[0] == symbol and left[before] in spot):
                    spot.add(before)
            if after < n:
                new = (symbol, seq[after])
                spot = fresh.get(new)
                if spot is None:
                    fresh[new] = {i}
                elif not (new[1] == symbol and before in spot):
                    spot.add(i)
        del where[pair]
        rules.append(pair)
        uses.append(done)
        for new, spot in fresh.items():
            if len(spot) > 1:
                where[new] = spot
                heapq.heappush(heap, (-len(spot), ticks, new))
                ticks += 1
    start, i = [], 0
    while i < n:
        start.append(seq[i])
        i = right[i]
    return Grammar(start, rules, base, uses)


def lengths(g: Grammar) -> list[int]:
    """Terminals under each rule."""
    out: list[int] = []
    for a, b in g.rules:
        out.append((1 if a < g.base else out[a - g.base]) + (1 if b < g.base else out[b - g.base]))
    return out


def expand(g: Grammar, symbol: int) -> list[int]:
    out, stack = [], [symbol]
    while stack:
        s = stack.pop()
        if s < g.base:
            out.append(s)
        else:
            stack.extend(reversed(g.rules[s - g.base]))
    return out


_TOKEN = re.compile(r"""(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<num>(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?))|(?P<name>[^\W\d]\w*)|(?P<op>[^\w\s])""")


def shapes(text: str) -> tuple[list[str], list[str]]:
    """(raw tokens, their shapes): names become I, numbers N, texts S; short words stay."""
    raw, shape = [], []
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m.group()
        raw.append(value)
        shape.append("S" if kind == "str" else "N" if kind == "num" else "I" if kind == "name" and value not in _WORDS else value)
    return raw, shape


# Words that give a line its shape in some language.
_WORDS = frozenset("pub const static let var fn func def class struct enum interface type import from use return if else for while in of function public private final int char void case default".split())


def number(tokens: list[str]) -> tuple[list[int], int]:
    ids: dict[str, int] = {}
    return [ids.setdefault(t, len(ids)) for t in tokens], len(ids)


class Reuse(NamedTuple):
    ratio: float  # symbols of the grammar per token
    cover: float  # largest share of tokens that the copies of one rule of five or more tokens cover


def reuse(shape: list[str]) -> Reuse:
    if not shape:
        return Reuse(1.0, 0.0)
    ids, base = number(shape)
    g = infer(ids, base)
    size = lengths(g)
    cover = max((u * s for u, s in zip(_total_uses(g), size) if s >= 5 and u >= 4), default=0) / len(ids)
    return Reuse((len(g.sequence) + 2 * len(g.rules)) / len(ids), min(1.0, cover))


def _total_uses(g: Grammar) -> list[int]:
    """Occurrences of each rule in the text, inside other rules too."""
    total = [0] * len(g.rules)
    for s in g.sequence:
        if s >= g.base:
            total[s - g.base] += 1
    for i in range(len(g.rules) - 1, -1, -1):
        for s in g.rules[i]:
            if s >= g.base:
                total[s - g.base] += total[i]
    return total


_PRIME, _STEP = (1 << 61) - 1, 0x1F3D5B79A2C4E6F1 % ((1 << 61) - 1)
_hashes: dict[str, int] = {}


def _hash(token: str) -> int:
    h = _hashes.get(token)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[token] = int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % _PRIME
    return h


def fingerprints(raw: list[str], least: int = 3) -> list[int]:
    """61-bit hashes of the texts of all rules of ``least`` or more tokens. The hash is that of the
    tokens in order, whatever pairs a grammar cuts them into, and follows from those of the pair."""
    ids, base = number(raw)
    g = infer(ids, base)
    value = [_hash(t) for t in dict.fromkeys(raw)]
    step, size = [_STEP] * base, [1] * base
    out = []
    for a, b in g.rules:
        value.append((value[a] * step[b] + value[b]) % _PRIME)
        step.append(step[a] * step[b] % _PRIME)
        size.append(size[a] + size[b])
        if size[-1] >= least:
            out.append(value[-1])
    return out
