"""Generalised LL parsing with a graph-structured stack.

A grammar maps each non-terminal to its alternatives, tuples of symbols; every
symbol that is no non-terminal is a token kind, ``ANY`` any token that is no
bracket. Alternatives run side by side as descriptors (rule, place in it, stack
node, position); calls of one non-terminal at one position share one stack
node, so ambiguous and left-recursive grammars end and stay polynomial.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

Rules = Mapping[str, list[tuple[str, ...]]]
BRACKETS = frozenset("()[]{}")


def parse(rules: Rules, start: str, kind_at: Callable[[int], str | None], at: int, watch: tuple[str, ...] = ()) -> tuple[set[int], dict[str, set[tuple[int, int]]]]:
    """All positions where a ``start`` that begins at ``at`` can end, and the (begin, end) of the watched non-terminals.

    ``kind_at`` gives the kind of the token at a position, None past the end.
    """
    stack: dict[tuple[str, int], tuple[list, set[int]]] = {}
    seen: set = set()
    todo: list = []

    def call(name: str, pos: int, back) -> None:
        node = (name, pos)
        entry = stack.get(node)
        if entry is None:
            entry = stack[node] = ([], set())
            for body in rules[name]:
                add((body, 0, node, pos))
        entry[0].append(back)
        for end in list(entry[1]):
            if back:
                add((*back, end))

    def add(descriptor) -> None:
        if descriptor not in seen:
            seen.add(descriptor)
            todo.append(descriptor)

    call(start, at, None)
    while todo:
        body, dot, node, pos = todo.pop()
        while True:
            if dot == len(body):
                backs, ends = stack[node]
                if pos not in ends:
                    ends.add(pos)
                    for back in list(backs):
                        if back:
                            add((*back, pos))
                break
            symbol = body[dot]
            if symbol in rules:
                call(symbol, pos, (body, dot + 1, node))
                break
            kind = kind_at(pos)
            if kind is None or kind != symbol and not (symbol == "ANY" and kind not in BRACKETS and kind != "STOP"):
                break
            dot, pos = dot + 1, pos + 1
    spans = {w: {(n[1], e) for n, (_, ends) in stack.items() if n[0] == w for e in ends} for w in watch}
    return stack[(start, at)][1], spans
