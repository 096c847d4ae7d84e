"""Memoised parsing with derivatives.

The derivative of a grammar by a token is the grammar of what may follow that
token. A text is parsed by taking derivatives token after token: if one is
empty, that token can't stand there; if the last one isn't nullable, the text
ends too early. Expressions are shared by structure, and every derivative is
kept with its expression, so a token usually costs one look-up, in this file
and in all later ones of the same worker.

A grammar is text, one rule a line: ``Name = body``. In a body, ``'x'`` is a
token, ``|`` separates choices, and ``? * +`` follow an item or a group in
parentheses. Rules must not be left-recursive.
"""

from __future__ import annotations

import re

MAX_NODES = 300_000  # then the shared expressions are built anew, which bounds a worker's memory


class Node:
    __slots__ = ("kind", "a", "b", "nullable", "d")

    def __init__(self, kind, a=None, b=None, nullable=False):
        self.kind, self.a, self.b, self.nullable, self.d = kind, a, b, nullable, {}


class Grammar:
    def __init__(self, text: str, start: str):
        self.text, self.start_name = text, start
        self.build()

    def build(self) -> None:
        self.table: dict = {}
        self.empty, self.eps = Node("empty"), Node("eps", nullable=True)
        self.rules: dict[str, Node] = {}
        self.refs: dict[str, Node] = {}
        parsed = {}
        for line in self.text.splitlines():
            if line.strip() and not line.lstrip().startswith("#"):
                name, body = line.split("=", 1)
                parsed[name.strip()] = re.findall(r"'[^']+'|\w+|[()|?*+]", body)
        self.nulls = self._nullable_rules(parsed)
        for name, words in parsed.items():
            self.rules[name] = self._body(words)
        missing = set(self.refs) - set(self.rules)
        if missing:
            raise ValueError(f"no rules for {sorted(missing)}")
        self.start = self.ref(self.start_name)

    def _nullable_rules(self, parsed) -> set[str]:
        """Rules that derive the empty text, found by running to a fixpoint."""
        found: set[str] = set()
        while True:
            self.nulls, before = found, len(found)
            self.table, self.refs = {}, {}
            found = {n for n, w in parsed.items() if self._body(w).nullable}
            if len(found) == before:
                self.table, self.refs = {}, {}
                return found

    # Construction, shared by structure.

    def _make(self, kind, a, b, nullable):
        key = (kind, a if isinstance(a, (str, frozenset)) else id(a), id(b))
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(kind, a, b, nullable)
        return node

    def tok(self, name):
        return self._make("tok", name, None, False)

    def ref(self, name):
        if name not in self.refs:
            self.refs[name] = Node("ref", name, nullable=name in self.nulls)
        return self.refs[name]

    def seq(self, a, b):
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        parts = []
        while a.kind == "seq":
            parts.append(a.a)
            a = a.b
        parts.append(a)
        for x in reversed(parts):
            b = self._make("seq", x, b, x.nullable and b.nullable)
        return b

    def alt(self, *nodes):
        flat: dict[int, Node] = {}
        for n in nodes:
            for x in (n.b if n.kind == "alt" else (n,)):
                if x is not self.empty:
                    flat[id(x)] = x
        # Choices that begin alike share their begin, so that nested texts keep few choices side by side.
        heads: dict[int, list[Node]] = {}
        for x in flat.values():
            heads.setdefault(id(x.a if x.kind == "seq" else x), []).append(x)
        if len(heads) < len(flat):
            flat = {}
            for own in heads.values():
                x = own[0]
                if len(own) > 1:
                    x = self.seq(x.a if x.kind == "seq" else x, self.alt(*[y.b if y.kind == "seq" else self.eps for y in own]))
                flat[id(x)] = x
        if not flat:
            return self.empty
        if len(flat) == 1:
            return next(iter(flat.values()))
        key = ("alt", frozenset(flat))
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node("alt", None, tuple(flat.values()), any(x.nullable for x in flat.values()))
        return node

    def rep(self, a):
        return self._make("rep", a, None, True)

    def _body(self, words):
        def choice(i):
            options, items = [], []
            while i < len(words) and words[i] != ")":
                w = words[i]
                if w == "|":
                    options.append(items)
                    items = []
                    i += 1
                    continue
                if w == "(":
                    node, i = choice(i + 1)
                else:
                    node = self.tok(w[1:-1]) if w[0] == "'" else self.ref(w)
                i += 1
                while i < len(words) and words[i] in "?*+":
                    if words[i] == "?":
                        node = self.alt(node, self.eps)
                    else:
                        node = self.rep(node) if words[i] == "*" else self.seq(node, self.rep(node))
                    i += 1
                items.append(node)
            options.append(items)
            built = []
            for items in options:
                node = self.eps
                for x in reversed(items):
                    node = self.seq(x, node)
                built.append(node)
            return self.alt(*built), i

        return choice(0)[0]

    # Derivatives.

    def derive(self, node, t):
        """The derivative of ``node`` by token ``t``, kept with the node."""
        found = node.d.get(t)
        if found is None:
            kind = node.kind
            if kind == "tok":
                found = self.eps if node.a == t else self.empty
            elif kind == "seq":
                found = self.seq(self.derive(node.a, t), node.b)
                if node.a.nullable:
                    found = self.alt(found, self.derive(node.b, t))
            elif kind == "alt":
                found = self.alt(*[self.derive(x, t) for x in node.b])
            elif kind == "rep":
                found = self.seq(self.derive(node.a, t), node)
            elif kind == "ref":
                found = self.derive(self.rules[node.a], t)
            else:
                found = self.empty
            node.d[t] = found
        return found

    def begin(self):
        if len(self.table) > MAX_NODES:
            self.build()
        return self.start
