"""Byte regexes compiled to minimal deterministic automata.

The syntax covers what scan rules need: literals, ``[...]`` classes with ranges
and ``^``, ``\\xNN`` and escaped punctuation, groups, ``|``, ``* + ?`` and
``{m}``, ``{m,}``, ``{m,n}``.  Every rule becomes a small nondeterministic
automaton; subset construction over byte classes (bytes that no rule tells
apart) and partition refinement give one transition array for all rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

RESET = 0xFF  # never part of UTF-8; no class holds it, so it leads back to the start


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"{self.p!r} ends too early")
        self.i += 1
        return c

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while self.peek() and self.peek() in "*+?{":
            c = self.take()
            if c == "{":
                lo, _, hi = (body := self.until("}")).partition(",")
                low, high = int(lo), (int(lo) if "," not in body else int(hi) if hi else None)
            else:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            node = ("rep", node, low, high)
        return node

    def until(self, end: str) -> str:
        at = self.p.index(end, self.i)
        body, self.i = self.p[self.i : at], at + 1
        return body

    def byte(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
        if ord(c) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(c)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"no ) in {self.p!r}")
            return node
        if c == "[":
            self.take()
            negated = self.peek() == "^"
            if negated:
                self.take()
            held: set[int] = set()
            while self.peek() != "]":
                a = self.byte()
                if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                    self.take()
                    held |= set(range(a, self.byte() + 1))
                else:
                    held.add(a)
            self.take()
            return ("set", frozenset(set(range(RESET)) - held if negated else held))
        if c in "*+?{":
            raise ValueError(f"nothing to repeat at {self.i} in {self.p!r}")
        return ("set", frozenset([self.byte()]))


class _Nfa:
    """States with empty moves and one byte-set move each."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds ``node`` after ``start``; the state at its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.move[start] = (node[1], end)
            return self._fresh(end)
        if kind == "cat":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for branch in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(branch, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, self._fresh(start))
        if high is None:
            loop = self._fresh(start)
            first = self._fresh(loop)
            self.empty[self.build(inner, first)].append(loop)
            return self._fresh(loop)
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.build(inner, self._fresh(start))
        self.empty[start].append(end)
        return end

    def _fresh(self, state: int) -> int:
        new = self.state()
        self.empty[state].append(new)
        return new

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte class]`` is the next state; state 0 is the start.

    ``accepts`` and ``alive`` have one bit a rule: a match of the rule ends at
    this byte, a match of the rule may be under way.
    """

    classes: np.ndarray  # byte -> class, uint8
    table: np.ndarray  # (states, classes) int32; -1 where a one-rule automaton dies
    accepts: np.ndarray
    alive: np.ndarray


def compile_rules(patterns: list[str], searching: bool = True) -> Automaton:
    """One minimal automaton for all patterns.

    ``searching``: a match may begin at any byte (every step adds the starts).
    Otherwise matches begin at the first byte and the automaton can die.
    """
    nfa = _Nfa()
    starts, ends = [], []
    for p in patterns:
        starts.append(nfa.state())
        ends.append(nfa.build(_Parser(p).parse(), starts[-1]))
    first = nfa.closure(starts)
    owner = np.searchsorted(np.array(starts), np.arange(len(nfa.empty)), side="right") - 1
    sets = list(dict.fromkeys(m[0] for m in nfa.move if m))
    told = np.zeros((256, len(sets)), dtype=np.uint8)
    for j, s in enumerate(sets):
        told[sorted(s), j] = 1
    kinds, classes = np.unique(told, axis=0, return_inverse=True)
    classes = classes.reshape(-1)
    holds = {s: [bool(kinds[c, j]) for c in range(len(kinds))] for j, s in enumerate(sets)}

    index, order, rows = {first: 0}, [first], []
    for current in order:
        moves = [nfa.move[s] for s in current if nfa.move[s]]
        row = []
        for c in range(len(kinds)):
            reached = {t for held, t in moves if holds[held][c]}
            if not reached and not searching:
                row.append(-1)
                continue
            nxt = nfa.closure(reached) | first if searching else nfa.closure(reached)
            if nxt not in index:
                index[nxt] = len(order)
                order.append(nxt)
            row.append(index[nxt])
        rows.append(row)
    table = np.array(rows, dtype=np.int32)
    accepts = np.array([sum(1 << r for r, e in enumerate(ends) if e in s) for s in order], dtype=np.int64)
    alive = np.array([sum({1 << int(owner[x]) for x in s - first}) for s in order], dtype=np.int64)
    return _minimised(classes.astype(np.uint8), table, accepts, alive)


def _minimised(classes, table, accepts, alive) -> Automaton:
    """States that no continuation tells apart become one (partition refinement)."""
    _, part = np.unique(np.stack([accepts, alive], 1), axis=0, return_inverse=True)
    part = part.reshape(-1)
    while True:
        nexts = np.where(table >= 0, part[table], -1)
        _, finer = np.unique(np.concatenate([part[:, None], nexts], 1), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    _, leader = np.unique(part, return_index=True)
    order = np.argsort(leader)  # state 0 stays the start
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    leader = leader[order]
    nexts = table[leader]
    return Automaton(classes, np.where(nexts >= 0, number[part[nexts]], -1).astype(np.int32), accepts[leader], alive[leader])


def run(auto: Automaton, data: np.ndarray, lane: int = 1024) -> np.ndarray:
    """The state after every byte of ``data``, from the start state.

    The bytes are cut into lanes that step together, one gather a byte position.
    A lane first assumes the start state; lanes whose predecessor ended
    elsewhere run again from there until they meet the states already found.
    """
    n, k = len(data), auto.table.shape[1]
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    lanes = -(-n // lane)
    padded = np.full(lanes * lane, RESET, dtype=np.uint8)
    padded[:n] = data
    steps = np.ascontiguousarray(auto.classes[padded].reshape(lanes, lane).T).astype(np.int32)
    flat = (auto.table * k).reshape(-1)
    found = np.empty((lane, lanes), dtype=np.int32)
    state = np.zeros(lanes, dtype=np.int32)
    for j in range(lane):
        state = flat[state + steps[j]]
        found[j] = state
    entered = np.zeros(lanes, dtype=np.int32)
    while True:
        entry = np.concatenate([np.zeros(1, dtype=np.int32), found[-1, :-1]])
        redo = np.flatnonzero(entry != entered)
        if not len(redo):
            break
        entered[redo] = entry[redo]
        state = entry[redo]
        for j in range(lane):
            state = flat[state + steps[j, redo]]
            differ = state != found[j, redo]
            redo, state = redo[differ], state[differ]
            if not len(redo):
                break
            found[j, redo] = state
    return (found.T.reshape(-1)[:n]) // k


def longest_match(auto: Automaton, data: bytes, start: int, stop: int) -> int:
    """End of the longest match of a one-rule automaton that begins at ``start``; -1 if none."""
    state, end, table, classes = 0, -1, auto.table, auto.classes
    for i in range(start, stop):
        state = table[state, classes[data[i]]]
        if state < 0:
            break
        if auto.accepts[state]:
            end = i + 1
    return end
