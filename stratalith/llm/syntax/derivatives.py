"""Memoised parsing with derivatives over token streams.

A language expression is hash-consed: equal expressions are one node, so a node's derivative by a
token class is computed once and kept (``node.by``). Nonterminals are references whose derivative
is that of their rule; repetition is primitive, so rules need no left recursion and no fixed point
is sought while deriving. Sequences lean right, so a derivative touches the first factors only
and the rest is shared. An empty derivative marks the failing token; an end state that is not
nullable means that the text stops early.
"""

from __future__ import annotations

import re


class Node:
    __slots__ = ("kind", "a", "b", "nullable", "by")

    def __init__(self, kind, a, b, nullable):
        self.kind, self.a, self.b, self.nullable, self.by = kind, a, b, nullable, {}


TOK, SEQ, ALT, REF, STAR, NOTFIRST, ANYBUT, EMPTY_, EPS_ = range(9)
MAX_NODES = 400_000

_META = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<name>\w+)|(?P<op>%\?|%|[()|*+?!~]))")


class Grammar:
    """Rules in EBNF text: one ``name = ...`` per line, continued on indented lines.

    ``X % 's'`` is a list with separators, ``X %? 's'`` may be empty and may end with one.
    ``!( 'a' 'b' ) X`` is X not starting with one of these tokens, ``~( 'a' )`` any other token.
    Upper-case names and quoted words are token classes."""

    def __init__(self, text: str, start: str, flags: frozenset[str] = frozenset()):
        self.start_name = start
        self.rules_text: dict[str, str] = {}
        name = None
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("--"):
                continue
            if line[0].isspace():
                self.rules_text[name] += " " + line.strip()
            else:
                name, _, body = line.partition("=")
                name = name.strip()
                if "@" in name:  # rule for one dialect only
                    name, _, flag = name.partition("@")
                    if flag not in flags:
                        name = "_unused"
                self.rules_text[name] = body.strip()
        self._null = self._nullables()
        self.reset()

    def reset(self) -> None:
        self.table: dict = {}
        self.bodies: dict[str, Node] = {}
        self.empty = Node(EMPTY_, None, None, False)
        self.eps = Node(EPS_, None, None, True)
        self.start = self.ref(self.start_name)
        self.limit = MAX_NODES
        self.resets = getattr(self, "resets", -1) + 1

    # ---- construction -------------------------------------------------
    def _mk(self, kind, a, b, nullable) -> Node:
        key = (kind, a, b)
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(kind, a, b, nullable)
        return node

    def tok(self, t):
        return self._mk(TOK, t, None, False)

    def ref(self, name):
        return self._mk(REF, name, None, name in self._null)

    def seq(self, a, b):
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        parts = []
        while a.kind == SEQ:
            parts.append(a.a)
            a = a.b
        b = self._mk(SEQ, a, b, a.nullable and b.nullable)
        for p in reversed(parts):
            b = self._mk(SEQ, p, b, p.nullable and b.nullable)
        return b

    def _options(self, nodes) -> set:
        flat = set()
        for n in nodes:
            if n.kind == ALT:
                flat |= n.a
            elif n is not self.empty:
                flat.add(n)
        return flat

    def _shared(self, flat: set, rests: bool) -> list:
        """Groups of options that agree in their rest (or in their first factor): (what is shared,
        the options, what differs)."""
        groups: dict = {}
        for n in flat:
            if n.kind == SEQ:
                groups.setdefault(n.b if rests else n.a, []).append(n)
        if not rests:
            for n in flat & groups.keys():
                groups[n].append(n)
        return [
            (k, same, [n.a if rests else n.b if n.kind == SEQ else self.eps for n in same]) for k, same in groups.items() if len(same) > 1
        ]

    def alt(self, nodes):
        """Options with one rest share it, so ambiguity inside a construct stays inside it; options
        with one first factor share that, so a nest read in two ways is derived once. Sharing goes
        as deep as the text nests, hence the explicit stack of (options, stage, groups, group)."""
        stack, made = [[self._options(nodes), 0, None, None]], None
        while True:
            frame = stack[-1]
            flat = frame[0]
            if made is not None:
                flat.add(self.seq(made, frame[3]) if frame[1] == 1 else self.seq(frame[3], made))
                made = None
            while not frame[2] and frame[1] < 2:
                frame[1] += 1
                frame[2] = self._shared(flat, frame[1] == 1) if len(flat) > 1 else None
            if frame[2]:
                frame[3], same, differ = frame[2].pop()
                flat.difference_update(same)
                stack.append([self._options(differ), 0, None, None])
                continue
            stack.pop()
            if not flat:
                made = self.empty
            elif len(flat) == 1:
                made = next(iter(flat))
            else:
                made = self._mk(ALT, frozenset(flat), None, any(n.nullable for n in flat))
            if not stack:
                return made

    def star(self, a):
        return self.eps if a in (self.empty, self.eps) else self._mk(STAR, a, None, True)

    # ---- rules --------------------------------------------------------
    def body(self, name) -> Node:
        node = self.bodies.get(name)
        if node is None:
            node = self.bodies[name] = self._parse(self.rules_text[name])
        return node

    def _parse(self, text):
        items, pos = [], 0
        while pos < len(text):
            m = _META.match(text, pos)
            if not m or m.end() == pos:
                if text[pos:].strip():
                    raise ValueError(f"bad rule: {text[pos:]!r}")
                break
            items.append((m.lastgroup, m.group(m.lastgroup)))
            pos = m.end()
        self._items, self._at = items, 0
        node = self._alt()
        assert self._at == len(items), (text, items[self._at:])
        return node

    def _peek(self):
        return self._items[self._at] if self._at < len(self._items) else (None, None)

    def _alt(self):
        options = [self._seq()]
        while self._peek() == ("op", "|"):
            self._at += 1
            options.append(self._seq())
        return self.alt(options)

    def _seq(self):
        parts = []
        while self._peek()[0] and self._peek() not in (("op", "|"), ("op", ")")):
            parts.append(self._post())
        node = self.eps
        for p in reversed(parts):
            node = self.seq(p, node)
        return node

    def _set(self):
        self._at += 1
        words = []
        while self._peek() != ("op", ")"):
            words.append(self._peek()[1].strip("'"))
            self._at += 1
        self._at += 1
        return frozenset(words)

    def _post(self):
        kind, v = self._peek()
        self._at += 1
        if kind == "lit":
            node = self.tok(v[1:-1])
        elif kind == "name":
            node = self.tok(v) if v.isupper() else self.ref(v)
        elif v == "(":
            node = self._alt()
            self._at += 1
        elif v == "!":
            banned = self._set()
            inner = self._post()
            node = self._mk(NOTFIRST, banned, inner, inner.nullable)
        elif v == "~":
            node = self._mk(ANYBUT, self._set(), None, False)
        else:
            raise ValueError(v)
        while self._peek()[0] == "op" and self._peek()[1] in "*+?%%?":
            op = self._peek()[1]
            self._at += 1
            if op == "*":
                node = self.star(node)
            elif op == "+":
                node = self.seq(node, self.star(node))
            elif op == "?":
                node = self.alt([node, self.eps])
            else:
                sep = self._post()
                many = self.seq(node, self.star(self.seq(sep, node)))
                node = many if op == "%" else self.alt([self.eps, self.seq(many, self.alt([sep, self.eps]))])
        return node

    def _nullables(self) -> frozenset[str]:
        """Rules that match nothing at all, by iteration to the least fixed point."""
        null: frozenset[str] = frozenset()
        while True:
            self._null = null
            self.table, self.empty, self.eps = {}, Node(EMPTY_, None, None, False), Node(EPS_, None, None, True)
            found = frozenset(n for n, t in self.rules_text.items() if n != "_unused" and self._parse(t).nullable)
            if found == null:
                return null
            null = found

    # ---- derivatives --------------------------------------------------
    def derive(self, node: Node, t: str) -> Node:
        """The derivative of ``node`` by ``t``. States nest as deep as the text does, so the nodes
        whose derivatives are still missing wait on an explicit stack."""
        d = node.by.get(t)
        if d is not None:
            return d
        stack = [node]
        while stack:
            n = stack[-1]
            if t in n.by:
                stack.pop()
                continue
            kind = n.kind
            if kind == TOK:
                d = self.eps if n.a == t else self.empty
            elif kind == ANYBUT:
                d = self.empty if t in n.a or t == "ERR" else self.eps
            elif kind == NOTFIRST and t in n.a or kind in (EMPTY_, EPS_):
                d = self.empty
            else:
                if kind == ALT:
                    needs = n.a
                elif kind == REF:
                    needs = (self.body(n.a),)
                elif kind == NOTFIRST:
                    needs = (n.b,)
                elif kind == SEQ and n.a.nullable:
                    needs = (n.a, n.b)
                else:
                    needs = (n.a,)
                missing = [m for m in needs if t not in m.by]
                if missing:
                    stack.extend(missing)
                    continue
                if kind == ALT:
                    d = self.alt([m.by[t] for m in needs])
                elif kind == SEQ:
                    d = self.seq(n.a.by[t], n.b)
                    if n.a.nullable:
                        d = self.alt([d, n.b.by[t]])
                elif kind == STAR:
                    d = self.seq(n.a.by[t], n)
                else:
                    d = needs[0].by[t]
            n.by[t] = d
            stack.pop()
        return node.by[t]

    def fresh(self) -> Node:
        """The start state; tables that outgrew their bound are dropped first."""
        if len(self.table) > MAX_NODES:
            self.reset()
        return self.start

    def lighten(self, state: Node) -> Node:
        """``state`` in tables that hold no more than it needs, where they outgrew their bound
        within one text. The bound follows the state where that alone exceeds half of it."""
        if len(self.table) <= self.limit:
            return state
        old_empty, old_eps = self.empty, self.eps
        self.reset()
        new = {old_empty: self.empty, old_eps: self.eps}
        stack = [state]
        while stack:
            n = stack[-1]
            if n in new:
                stack.pop()
                continue
            inner = n.a if n.kind == ALT else (n.a, n.b) if n.kind == SEQ else (n.a,) if n.kind == STAR else (n.b,) if n.kind == NOTFIRST else ()
            missing = [m for m in inner if m not in new]
            if missing:
                stack.extend(missing)
                continue
            a, b = n.a, n.b
            if n.kind == ALT:
                a = frozenset(new[m] for m in n.a)
            elif n.kind in (SEQ, STAR):
                a, b = new[n.a], None if n.b is None else new[n.b]
            elif n.kind == NOTFIRST:
                b = new[n.b]
            new[n] = self._mk(n.kind, a, b, n.nullable)
            stack.pop()
        self.limit = max(MAX_NODES, 2 * len(self.table))
        return new[state]
