"""Byte patterns compiled into minimal deterministic automata (transition arrays)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

Node = tuple  # ("set", bytes) | ("cat", nodes) | ("alt", nodes) | ("rep", node, least, most or None)


class _Reader:
    """Reads literals, escapes, classes, groups, alternatives and the quantifiers ? + * {m} {m,} {m,n}."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    def sequence(self) -> Node:
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.quantified(self.atom()))
        return ("cat", items)

    def atom(self) -> Node:
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text}")
            return inner
        if c == "[":
            members: set[int] = set()
            while self.peek() != "]":
                low = high = self.byte(self.take())
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    high = self.byte(self.take())
                members |= set(range(low, high + 1))
            self.take()
            return self.symbols(members)
        return self.symbols({self.byte(c)})

    def byte(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError(f"only ASCII in patterns: {self.text}")
        return ord(c)

    def symbols(self, members: set[int]) -> Node:
        if self.any_case:
            members |= {ord(chr(b).swapcase()) for b in members if chr(b).isalpha()}
        return ("set", frozenset(members))

    def quantified(self, node: Node) -> Node:
        mark = self.peek()
        if mark and mark in "?+*":
            self.take()
            return ("rep", node, int(mark == "+"), 1 if mark == "?" else None)
        if mark == "{":
            end = self.text.index("}", self.at)
            least, comma, most = self.text[self.at + 1 : end].partition(",")
            self.at = end + 1
            return ("rep", node, int(least), int(most) if most else None if comma else int(least))
        return node


def parse(pattern: str, any_case: bool = False) -> Node:
    reader = _Reader(pattern, any_case)
    node = reader.alternatives()
    if reader.peek():
        raise ValueError(f"unbalanced group in {pattern}")
    return node


@dataclass
class Positions:
    """Position automaton: one state for each symbol of the patterns, no empty moves."""

    symbols: list[frozenset[int]] = field(default_factory=list)
    follow: list[set[int]] = field(default_factory=list)

    def add(self, node: Node) -> tuple[bool, set[int], set[int]]:
        """(may be empty, first positions, last positions) of ``node``, whose positions are appended."""
        kind = node[0]
        if kind == "set":
            self.symbols.append(node[1])
            self.follow.append(set())
            return False, {len(self.symbols) - 1}, {len(self.symbols) - 1}
        if kind == "alt":
            parts = [self.add(n) for n in node[1]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind == "cat":
            return self._chain([self.add(n) for n in node[1]])
        _, inner, least, most = node
        parts = [self.add(inner) for _ in range(most if most is not None else max(least, 1))]
        if most is None:
            for p in parts[-1][2]:
                self.follow[p] |= parts[-1][1]
        return self._chain([(p[0] or i >= least, p[1], p[2]) for i, p in enumerate(parts)])

    def _chain(self, parts: list[tuple[bool, set[int], set[int]]]) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for e, f, l in parts:
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else set(l)
            empty = empty and e
        return empty, first, last

    def backwards(self) -> list[set[int]]:
        before: list[set[int]] = [set() for _ in self.follow]
        for p, after in enumerate(self.follow):
            for q in after:
                before[q].add(p)
        return before


@dataclass(frozen=True)
class Table:
    """Transition array over byte classes; states are multiples of ``width``, accepting ones come last.

    State 0 is the start; ``dead`` is a state without a way out, or -1. ``accepts`` gives, for each
    accepting state, the numbers of the patterns that end there.
    """

    classes: bytes
    width: int
    moves: list[int]
    accepting: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def determinise(
    symbols: Sequence[frozenset[int]], follow: Sequence[set[int]], first: set[int], last: Sequence[set[int]], anywhere: bool
) -> Table:
    """Subset construction, then minimisation by partition refinement.

    ``anywhere``: a pattern may begin at every byte, so the start positions are entered again at each step.
    """
    signature: dict[tuple[bool, ...], int] = {}
    classes = bytes(signature.setdefault(tuple(b in s for s in symbols), len(signature)) for b in range(256))
    width = len(signature)
    member = [[p for p, on in enumerate(key) if on] for key in signature]
    reads = [frozenset(m) for m in member]
    start: frozenset[int] = frozenset({-1})  # before the first byte
    numbers, rows, sets = {start: 0}, [], [start]
    while len(rows) < len(sets):
        state = sets[len(rows)]
        ahead = set(first) if anywhere or state == start else set()
        for p in state:
            if p >= 0:
                ahead |= follow[p]
        row = []
        for c in range(width):
            target = frozenset(ahead & reads[c])
            if target not in numbers:
                numbers[target] = len(sets)
                sets.append(target)
            row.append(numbers[target])
        rows.append(row)
    moves = np.array(rows)
    ends = [tuple(r for r, l in enumerate(last) if l & s) for s in sets]
    names: dict[tuple[int, ...], int] = {}
    block = np.array([names.setdefault(e, len(names)) for e in ends])
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    chosen = {int(b): s for s, b in reversed(list(enumerate(block)))}  # the first state of each block
    order = sorted(chosen, key=lambda b: (bool(ends[chosen[b]]), b != block[0], b))
    place = {b: i * width for i, b in enumerate(order)}
    flat = [place[int(block[t])] for b in order for t in moves[chosen[b]]]
    accepts = {place[b]: ends[chosen[b]] for b in order if ends[chosen[b]]}
    dead = [place[b] for b in order if not ends[chosen[b]] and all(block[t] == b for t in moves[chosen[b]])]
    return Table(classes, width, flat, min(accepts, default=len(flat)), accepts, dead[0] if dead else -1)


def forward(nodes: Sequence[Node]) -> Table:
    """One automaton for all patterns, each of which may begin anywhere."""
    positions, first, last = Positions(), set(), []
    for node in nodes:
        _, f, l = positions.add(node)
        first |= f
        last.append(l)
    return determinise(positions.symbols, positions.follow, first, last, True)


def backward(node: Node) -> Table:
    """Automaton that reads the bytes of a match of one pattern from its end."""
    positions = Positions()
    _, first, last = positions.add(node)
    return determinise(positions.symbols, positions.backwards(), last, [first], False)
