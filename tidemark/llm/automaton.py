"""Regular expressions to one minimal deterministic automaton over bytes.

Subset construction over the union of all rules, then partition refinement; the result is
a transition array (states x 256).  Supported syntax: literals, ``\\xHH`` and ``\\`` escapes,
classes with ranges and negation, groups, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))


class _Parser:
    """Parses to nested tuples: ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, lo, hi)."""

    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def parse(self):
        node = self._alt()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in {self.s!r}")
        return node

    def _peek(self):
        return self.s[self.i] if self.i < len(self.s) else ""

    def _alt(self):
        arms = [self._cat()]
        while self._peek() == "|":
            self.i += 1
            arms.append(self._cat())
        return arms[0] if len(arms) == 1 else ("alt", *arms)

    def _cat(self):
        parts = []
        while self._peek() and self._peek() not in "|)":
            parts.append(self._repeat(self._atom()))
        return ("cat", *parts)

    def _atom(self):
        c = self._peek()
        self.i += 1
        if c == "(":
            node = self._alt()
            if self._peek() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            return self._class()
        if c == ".":
            return ("set", ANY - {10})
        return ("set", self._folded({self._escaped() if c == "\\" else ord(c)}))

    def _escaped(self) -> int:
        c = self._peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def _class(self):
        negate = self._peek() == "^"
        self.i += negate
        chars: set[int] = set()
        first = True
        while first or self._peek() != "]":
            first = False
            c = self._peek()
            self.i += 1
            lo = self._escaped() if c == "\\" else ord(c)
            hi = lo
            if self._peek() == "-" and self.i + 1 < len(self.s) and self.s[self.i + 1] != "]":
                self.i += 1
                c = self._peek()
                self.i += 1
                hi = self._escaped() if c == "\\" else ord(c)
            chars.update(range(lo, hi + 1))
        self.i += 1
        chars = self._folded(chars)
        return ("set", ANY - chars if negate else chars)

    def _folded(self, chars) -> frozenset:
        if self.fold:
            chars = {y for x in chars for y in {x, ord(chr(x).lower()), ord(chr(x).upper())} if x < 128} | set(chars)
        return frozenset(x for x in chars if x < 256)

    def _repeat(self, node):
        while (c := self._peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                lo, _, hi = self.s[self.i : end].partition(",")
                bounds = (int(lo), int(lo) if "," not in self.s[self.i : end] else (int(hi) if hi else None))
                self.i = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node


def reverse(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    parts = [reverse(x) for x in node[1:]]
    return (kind, *(parts[::-1] if kind == "cat" else parts))


def parse(pattern: str, fold: bool = False):
    return _Parser(pattern, fold).parse()


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Append ``node`` after ``start``; its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1:]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1:]:
                arm = self.state()
                self.empty[start].append(arm)
                self.empty[self.add(x, arm)].append(end)
            return end
        _, inner, lo, hi = node
        for _ in range(lo):
            start = self.add(inner, start)
        if hi is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            end = self.state()
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(hi - lo):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def compile_rules(nodes: list, anywhere: bool) -> tuple[np.ndarray, list[frozenset]]:
    """The minimal automaton of all rules: transitions (states x 256, start 0, -1 dead), rules accepted by state.

    ``anywhere``: a match may begin at any byte; otherwise only at the first.
    """
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for k, node in enumerate(nodes):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.add(node, begin)] = k
    if anywhere:
        nfa.moves[root].append((ANY, root))
    # bytes that no set tells apart move alike
    marks = np.zeros((256, 0), bool)
    sets = {s for m in nfa.moves for s, _ in m}
    marks = np.array([[b in s for s in sets] for b in range(256)])
    _, sample, group = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    group = group.ravel()

    closed = [nfa.closure([s]) for s in range(len(nfa.moves))]
    #: for each class of bytes and state, the states one byte leads to
    step = [
        {s: frozenset().union(*to) for s, moves in enumerate(nfa.moves) if (to := [closed[t] for chars, t in moves if int(b) in chars])}
        for b in sample
    ]
    first = closed[root]
    index, todo, rows = {first: 0}, [first], []
    for here in todo:
        row = []
        for moves in step:
            to = frozenset().union(*[moves[s] for s in here if s in moves])
            if not to:
                row.append(-1)
                continue
            if to not in index:
                index[to] = len(index)
                todo.append(to)
            row.append(index[to])
        rows.append(row)
    accepts = [frozenset(ends[s] for s in states if s in ends) for states in index]
    # minimisation: refine the partition by accepted rules until the moves agree
    table = np.array(rows)
    names = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block = np.array([names[a] for a in accepts])
    while True:
        moved = np.where(table < 0, -1, block[table])
        _, new = np.unique(np.column_stack([block, moved]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    order = {b: i for i, b in enumerate(dict.fromkeys(block.tolist()))}  # state 0 stays the start
    block = np.array([order[b] for b in block.tolist()])
    small = np.full((block.max() + 1, table.shape[1]), -1)
    small[block] = np.where(table < 0, -1, block[table])
    kept: list[frozenset] = [frozenset()] * (block.max() + 1)
    for b, a in zip(block, accepts, strict=True):
        kept[b] = a
    return small[:, group].astype(np.int32), kept


def linked_rows(table: np.ndarray, accepts: list[frozenset]) -> list[list]:
    """The array as rows that hold the next row for each byte, and at 256 the rules accepted.

    One byte then costs one list lookup.  A dead state leads to a row without a way out.
    """
    dead: list = [None] * 257
    dead[:256] = [dead] * 256
    dead[256] = frozenset()
    rows: list[list] = [[None] * 257 for _ in accepts]
    for row, moves, rules in zip(rows, table.tolist(), accepts, strict=True):
        row[:256] = [rows[t] if t >= 0 else dead for t in moves]
        row[256] = rules
    rows.append(dead)
    return rows
