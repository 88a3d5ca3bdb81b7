"""Regular expressions as minimal deterministic byte automata.

The patterns take literals, ``\\xHH`` and escaped characters, classes with ranges, groups, ``(?i:...)``,
``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}`` over ASCII.  ``compile_rules`` builds one Thompson
automaton of all rules, makes it deterministic by subset construction over byte classes and merges equal
states by partition refinement.  The result is a transition array that one pass over bytes follows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_OPEN_END = -1


class _Nfa:
    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.edges: list[list[tuple[int, int]]] = []  # (bit set of bytes, target)

    def state(self) -> int:
        self.eps.append([])
        self.edges.append([])
        return len(self.eps) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class _Parser:
    """Pattern text to a tree of ('set', bits), ('cat', xs), ('or', xs) and ('rep', x, low, high)."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unread pattern: {self.text[self.at :]!r}")
        return tree

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, atom):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                atom = ("rep", atom, int(low), (int(high) if high else _OPEN_END) if comma else int(low))
            else:
                atom = ("rep", atom, int(c == "+"), 1 if c == "?" else _OPEN_END)
        return atom

    def atom(self):
        c = self.take()
        if c == "(":
            outer = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            tree = self.choice()
            if self.take() != ")":
                raise ValueError("a group is not closed")
            self.fold = outer
            return tree
        if c == "[":
            bits = 0
            while self.peek() != "]":
                low = self.character()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    for x in range(low, self.character() + 1):
                        bits |= self.bit(x)
                else:
                    bits |= self.bit(low)
            self.take()
            return ("set", bits)
        self.at -= 1
        return ("set", self.bit(self.character()))

    def character(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def bit(self, x: int) -> int:
        both = {x, ord(chr(x).lower()), ord(chr(x).upper())} if self.fold else {x}
        return sum(1 << y for y in both)


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [_reversed(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    return tree


def _add(nfa: _Nfa, tree, start: int) -> int:
    """Adds what ``tree`` matches after ``start``; the state behind it."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.edges[start].append((tree[1], end))
        return end
    if kind == "cat":
        for x in tree[1]:
            start = _add(nfa, x, start)
        return start
    if kind == "or":
        end = nfa.state()
        for x in tree[1]:
            first = nfa.state()
            nfa.eps[start].append(first)
            nfa.eps[_add(nfa, x, first)].append(end)
        return end
    _, inner, low, high = tree
    for _ in range(low):
        start = _add(nfa, inner, start)
    if high == _OPEN_END:
        loop, end = nfa.state(), nfa.state()
        nfa.eps[start].append(loop)
        nfa.eps[_add(nfa, inner, loop)].append(loop)
        nfa.eps[loop].append(end)
        return end
    end = nfa.state()
    for _ in range(high - low):
        nfa.eps[start].append(end)
        start = _add(nfa, inner, start)
    nfa.eps[start].append(end)
    return end


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte]`` is the next state, ``accepts[state]`` the numbers of the rules that end there.

    State numbers rise from states that accept nothing to those that do; ``first_accepting`` parts them.
    ``dead`` is the state without a way to accept, or -1.
    """

    table: np.ndarray
    accepts: tuple[tuple[int, ...], ...]
    start: int
    first_accepting: int
    dead: int

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        state, found = self.start, (start if self.start >= self.first_accepting else -1)
        for i in range(start, len(data)):
            state = self.table[state, data[i]]
            if state == self.dead:
                break
            if state >= self.first_accepting:
                found = i + 1
        return found

    def earliest(self, data: bytes, end: int, least: int) -> int:
        """Of an automaton of reversed patterns: the first start from ``least`` of a match with this end, or -1."""
        state, found = self.start, -1
        for i in range(end - 1, least - 1, -1):
            state = self.table[state, data[i]]
            if state == self.dead:
                break
            if state >= self.first_accepting:
                found = i
        return found


def compile_rules(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """One automaton of all ``patterns``; with ``anywhere`` a match may begin at every byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for number, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        first = nfa.state()
        nfa.eps[root].append(first)
        ends[_add(nfa, _reversed(tree) if backwards else tree, first)] = number
    # Bytes that no edge tells apart share a class.
    bits = sorted({b for edges in nfa.edges for b, _ in edges})
    classes: dict[tuple[bool, ...], int] = {}
    of_byte = [classes.setdefault(tuple(bool(b >> x & 1) for b in bits), len(classes)) for x in range(256)]
    sample = {c: x for x, c in reversed(list(enumerate(of_byte)))}
    always = nfa.closure([root]) if anywhere else frozenset()
    first = nfa.closure([root])
    number = {first: 0}
    order, rows = [first], []
    for states in order:  # grows while it is read
        row = []
        for c in range(len(classes)):
            moved = {t for s in states for b, t in nfa.edges[s] if b >> sample[c] & 1}
            target = nfa.closure(moved) | always
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        rows.append(row)
    moves = np.array(rows, np.int64).reshape(len(order), len(classes))
    accepts = [tuple(sorted({ends[s] for s in states if s in ends})) for states in order]
    kinds = {a: i for i, a in enumerate(sorted(set(accepts)))}
    block = np.array([kinds[a] for a in accepts])
    while True:  # states stay together while they lead to the same blocks
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count = int(finer.max()) + 1
    any_state = np.zeros(count, np.int64)
    any_state[finer] = np.arange(len(order))
    small = finer[moves[any_state]]
    own = [accepts[s] for s in any_state]
    new = np.empty(count, np.int64)
    new[sorted(range(count), key=lambda s: (bool(own[s]), s))] = np.arange(count)
    table = np.empty((count, 256), np.int64)
    table[new] = new[small][:, of_byte]
    accepted: list[tuple[int, ...]] = [()] * count
    for s in range(count):
        accepted[new[s]] = own[s]
    dead = [s for s in range(count) if not accepted[s] and (table[s] == s).all()]
    return Automaton(
        table,
        tuple(accepted),
        int(new[finer[0]]),
        sum(not a for a in accepted),
        dead[0] if dead and not anywhere else -1,
    )
