"""Regular expressions over bytes, compiled to one minimal deterministic automaton.

The syntax is the usual one for literals, ``.``-free classes, groups,
alternatives, ``? * + {m} {m,} {m,n}``, ``\\xHH`` and ``(?i:...)``.  Several
rules are compiled together: Thompson's construction gives one
nondeterministic automaton, subset construction a deterministic one over the
classes of bytes that no rule tells apart, and partition refinement merges
states of equal behaviour.
"""

from __future__ import annotations

import numpy as np

_ALL = (1 << 256) - 1


def _bits(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


class _Parser:
    """Builds the nondeterministic automaton: eps[s] are free moves, step[s] is (byte set, next)."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def rule(self, pattern: str, backward: bool = False) -> tuple[int, int]:
        """backward: for the rule's matches read from their ends."""
        self.text, self.at, self.fold, self.backward = pattern, 0, False, backward
        first, last = self.build(self.either())
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} at {self.at} in {pattern!r}")
        return first, last

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("seq", items)

    def atom(self):
        c = self.take()
        if c == "(":
            was = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            inner = self.either()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.take()
            self.fold = was
            return inner
        if c == "[":
            return ("set", self.members())
        return ("set", self.cased(_bits([self.byte(c)])))

    def byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def cased(self, members: int) -> int:
        if self.fold:
            for a in range(65, 91):
                if members >> a & 1 or members >> (a + 32) & 1:
                    members |= 1 << a | 1 << (a + 32)
        return members

    def members(self) -> int:
        negated = self.peek() == "^"
        self.at += negated
        out = 0
        while (c := self.take()) != "]":
            low = high = self.byte(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.byte(self.take())
            out |= _bits(range(low, high + 1))
        return self.cased(out) ^ (_ALL if negated else 0)

    def repeated(self, item):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                item = ("rep", item, int(low), (int(high) if high else None) if comma else int(low))
            else:
                item = ("rep", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def build(self, item) -> tuple[int, int]:
        first = last = self.state()
        if item[0] == "set":
            last = self.state()
            self.step[first] = (item[1], last)
        elif item[0] == "seq":
            for x in reversed(item[1]) if self.backward else item[1]:
                a, b = self.build(x)
                self.eps[last].append(a)
                last = b
        elif item[0] == "or":
            last = self.state()
            for x in item[1]:
                a, b = self.build(x)
                self.eps[first].append(a)
                self.eps[b].append(last)
        else:
            _, inner, low, high = item
            for _ in range(low):
                a, b = self.build(inner)
                self.eps[last].append(a)
                last = b
            end = self.state()
            if high is None:
                a, b = self.build(inner)
                self.eps[last] += [a, end]
                self.eps[b] += [a, end]
            else:
                for _ in range(high - low):
                    a, b = self.build(inner)
                    self.eps[last] += [a, end]
                    last = b
                self.eps[last].append(end)
            last = end
        return first, last


class Automaton:
    """moves: one row of 256 next states for each state; accepts: bits of the rules that end in each state; state 0 is dead, 1 the first."""

    def __init__(self, rules: list[str], anywhere: bool = False, backward: bool = False) -> None:
        """anywhere: a match may begin at any byte, not at the first alone. backward: bytes are read from the last to the first."""
        self.backward = backward
        p = _Parser()
        ends = {}
        start = p.state()
        for i, rule in enumerate(rules):
            first, last = p.rule(rule, backward)
            p.eps[start].append(first)
            ends[last] = 1 << i
        sets = {s for s in p.step if s}
        classes = self._classes({m for m, _ in sets})
        moves, accepts = self._subsets(p, start, ends, classes, anywhere)
        self.moves, self.accepts = self._minimal(moves, accepts, classes)
        self.rows: list[list] = [[] for _ in self.moves]
        for row, to in zip(self.rows, self.moves.tolist(), strict=True):
            row.extend(self.rows[s] for s in to)
        for row, bits in zip(self.rows, self.accepts, strict=True):
            row.append(bits)

    @staticmethod
    def _classes(sets: set[int]) -> np.ndarray:
        """The class of each byte: bytes in the same sets share one."""
        seen: dict[tuple, int] = {}
        ordered = sorted(sets)
        return np.array([seen.setdefault(tuple(s >> b & 1 for s in ordered), len(seen)) for b in range(256)])

    @staticmethod
    def _subsets(p: _Parser, start: int, ends: dict[int, int], classes: np.ndarray, anywhere: bool) -> tuple[list[list[int]], list[int]]:
        closed: dict[int, frozenset[int]] = {}

        def closure(s: int) -> frozenset[int]:
            if s not in closed:
                found, todo = {s}, [s]
                while todo:
                    for t in p.eps[todo.pop()]:
                        if t not in found:
                            found.add(t)
                            todo.append(t)
                closed[s] = frozenset(t for t in found if p.step[t] or t in ends)
            return closed[s]

        sample = [int(np.flatnonzero(classes == c)[0]) for c in range(classes.max() + 1)]
        origin = closure(start)
        dead: frozenset[int] = frozenset()
        number = {dead: 0, origin: 1}
        order, moves = [dead, origin], []
        for states in order:
            row = []
            for b in sample:
                to: set[int] = set(origin) if anywhere else set()
                for s in states:
                    if (step := p.step[s]) and step[0] >> b & 1:
                        to |= closure(step[1])
                key = frozenset(to)
                if key not in number:
                    number[key] = len(order)
                    order.append(key)
                row.append(number[key])
            moves.append(row)
        accepts = []
        for states in order:
            bits = 0
            for s in states:
                bits |= ends.get(s, 0)
            accepts.append(bits)
        return moves, accepts

    @staticmethod
    def _minimal(moves: list[list[int]], accepts: list[int], classes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        to = np.array(moves)
        _, block = np.unique(np.array(accepts), return_inverse=True)
        count = 0
        while len(np.unique(block)) != count:
            count = len(np.unique(block))
            _, block = np.unique(np.column_stack((block[:, None], block[to])), axis=0, return_inverse=True)
            block = block.reshape(-1)
        # The dead state is 0 and the first 1, others by their earliest member.
        rank: dict[int, int] = {}
        for s in range(len(to)):
            rank.setdefault(int(block[s]), len(rank))
        new = np.array([rank[int(x)] for x in block])
        out = np.zeros((len(rank), to.shape[1]), np.int32)
        kept = [0] * len(rank)
        for s in range(len(to)):
            out[new[s]] = new[to[s]]
            kept[new[s]] = accepts[s]
        return out[:, classes], kept

    def seen(self, data: bytes) -> int:
        """Bits of the rules with a match somewhere (of an ``anywhere`` automaton): one pass, one look-up a byte."""
        row, bits = self.rows[1], 0
        for b in reversed(data) if self.backward else data:
            row = row[b]
            if row[256]:
                bits |= row[256]
        return bits

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, bits) of the bytes at which a match of some rule begins, from the last (of an ``anywhere``, ``backward`` automaton): one pass."""
        out, row = [], self.rows[1]
        for i, b in enumerate(reversed(data), 1):
            row = row[b]
            if row[256]:
                out.append((len(data) - i, row[256]))
        return out

    def longest(self, data: bytes, at: int, rule_bits: int = -1) -> int:
        """Where the longest match of the rules that begins at ``at`` ends; -1 without one."""
        row, dead, end = self.rows[1], self.rows[0], -1
        for i in range(at, len(data)):
            row = row[data[i]]
            if row is dead:
                break
            if row[256] & rule_bits:
                end = i + 1
        return end
