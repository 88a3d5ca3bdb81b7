"""Context-tree weighting over bytes, for counts that are already gathered.

A byte is eight binary decisions (the nodes of its bits' prefix tree); each decision has a context tree over the preceding
bytes, most recent first.  A node of that tree has the Krichevsky-Trofimov block probability Pe of its zeros and
ones, and Pw = (Pe + product of its children's Pw) / 2.  The weight of stopping at a node, given its context is
reached, is Pe / (2 Pw); a bit's probability is the mix of the KT estimates along its context path with
these weights.  The model is the one that context-tree weighting has after reading all counted bytes.

A key is a context and the next byte as a number: most recent byte highest, next byte lowest.  Contexts with the same two most
recent bytes are computed together, so shards by these two bytes are independent from depth 2 on; depths 0 and 1 have
at most 257 * 255 nodes and are summed from all shards.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from motifold.llm.tokens import U, inverse

LN2 = float(np.log(2.0))
#: Depth from which a shard holds whole subtrees.
SHARED = 2
_SMALL = 4096


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, _SMALL)
    half = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(k - 0.5))])
    whole = np.concatenate([[0.0], np.cumsum(np.log(k))])
    return half, whole


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT block probability of so many zeros and ones in any order."""
    half, whole = _tables()

    def gamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
        out = table[np.minimum(n, _SMALL - 1)]
        large = n >= _SMALL
        if large.any():
            out[large] = _stirling(n[large] + shift)
        return out

    return gamma(zeros, half, 0.5) + gamma(ones, half, 0.5) - gamma(zeros + ones, whole, 1.0) - np.log(np.pi)


class Level:
    """All nodes of one depth: rows are (context, next byte), and eight lists of nodes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.node: list[np.ndarray] = []  # per bit, the node of each row
        self.zeros: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.first: list[np.ndarray] = []  # per bit, the first row of each node
        for bit in range(8):
            prefix = keys >> U(8 - bit)
            new = np.ones(len(keys), bool)
            new[1:] = prefix[1:] != prefix[:-1]
            first = np.flatnonzero(new)
            self.first.append(first)
            self.node.append(np.cumsum(new) - 1)
            one = (keys >> U(7 - bit) & U(1)).astype(bool)
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            ones = np.add.reduceat(np.where(one, counts, 0), first) if len(first) else counts[:0]
            self.zeros.append(total - ones)
            self.ones.append(ones)
        self.weight: list[np.ndarray] = [None] * 8  # log Pw
        self.stop: list[np.ndarray] = [None] * 8  # share of the node's own estimate


def weigh(zeros, ones, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """log Pw of nodes and the weight of stopping there; ``below`` sums the children's log Pw, None for leaves."""
    own = log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - LN2
    return both, np.exp(own - LN2 - both)


class Subtrees:
    """The context trees below depth 2 of the contexts in ``keys`` (sorted, distinct), with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.levels = {depth: Level(keys, counts)}
        self.up: dict[int, np.ndarray] = {}  # per depth, the row of the next shorter context of each row
        for d in range(depth - 1, SHARED - 1, -1):
            longer = self.levels[d + 1]
            shorter = longer.keys >> U(16) << U(8) | longer.keys & U(255)
            distinct, row = inverse(shorter)
            self.up[d + 1] = row
            self.levels[d] = Level(distinct, np.bincount(row, longer.counts, len(distinct)).astype(np.int64))
        for d in range(depth, SHARED - 1, -1):
            level = self.levels[d]
            for bit in range(8):
                below = None
                if d < depth:
                    longer = self.levels[d + 1]
                    parent = level.node[bit][self.up[d + 1][longer.first[bit]]]
                    below = np.bincount(parent, longer.weight[bit], len(level.first[bit]))
                level.weight[bit], level.stop[bit] = weigh(level.zeros[bit], level.ones[bit], below)

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per depth-1 node (most recent byte * 256 + prefix with a leading one): zeros, ones, sum of log Pw."""
        level = self.levels[SHARED]
        size = 1 << 16
        sums = [np.zeros(size), np.zeros(size), np.zeros(size)]
        for bit in range(8):
            key = level.keys[level.first[bit]]
            at = ((key >> U(16)) << U(8) | (key & U(255)) >> U(8 - bit) | U(1 << bit)).astype(np.int64)
            for total, own in zip(sums, (level.zeros[bit], level.ones[bit], level.weight[bit]), strict=True):
                total += np.bincount(at, own, size)
        at = np.flatnonzero(sums[0] + sums[1])
        return at, sums[0][at], sums[1][at], sums[2][at]

    def log2(self, top: "Top") -> np.ndarray:
        """Binary logarithm of the probability of each row's byte after its context."""
        keys = self.levels[self.depth].keys
        recent = (keys >> U(8 * self.depth) & U(255)).astype(np.int64)
        out = np.zeros(len(keys))
        for bit in range(8):
            one = (keys >> U(7 - bit) & U(1)).astype(bool)
            mixed, row = np.zeros(len(keys)), np.arange(len(keys))
            for d in range(self.depth, SHARED - 1, -1):
                level = self.levels[d]
                node = level.node[bit][row]
                zeros, ones = level.zeros[bit][node], level.ones[bit][node]
                chance = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
                stop = level.stop[bit][node]  # 1 at the full depth
                mixed = stop * chance + (1 - stop) * mixed
                if d > SHARED:
                    row = self.up[d][row]
            prefix = ((keys & U(255)) >> U(8 - bit) | U(1 << bit)).astype(np.int64)
            for node, chance_of_one, stop in (
                (recent * 256 + prefix, top.one, top.stop),
                (prefix, top.root_one, top.root_stop),
            ):
                chance = np.where(one, chance_of_one[node], 1 - chance_of_one[node])
                mixed = stop[node] * chance + (1 - stop[node]) * mixed
            out += np.log2(mixed)
        return out


class Top:
    """Depths 0 and 1 from the sums of all shards' ``Subtrees.top``."""

    def __init__(self, at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        size = 1 << 16
        n0, n1, low = (np.zeros(size) for _ in range(3))
        n0[at], n1[at], low[at] = zeros, ones, below
        weight, self.stop = weigh(n0.astype(np.int64), n1.astype(np.int64), low)
        self.one = (n1 + 0.5) / (n0 + n1 + 1)
        seen = n0 + n1 > 0
        r0, r1 = n0.reshape(256, 256).sum(axis=0), n1.reshape(256, 256).sum(axis=0)
        below_root = np.where(seen, weight, 0).reshape(256, 256).sum(axis=0)
        _, self.root_stop = weigh(r0.astype(np.int64), r1.astype(np.int64), below_root)
        self.root_one = (r1 + 0.5) / (r0 + r1 + 1)


def padded(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with zero bytes between them: the keys of all bytes and of one zero after each text, and, per text,
    the number of keys before it."""
    texts = len(offsets) - 1
    shift = depth * np.arange(1, texts + 1)
    wide = np.zeros(len(data) + depth * (texts + 1), np.uint8)
    inside = np.ones(len(wide), bool)
    for i in range(depth):
        inside[offsets[:-1] + shift - depth + i] = False
    inside[len(wide) - depth :] = False
    wide[inside] = data
    scored = inside
    scored[offsets[1:] + shift] = True
    at = np.flatnonzero(scored)
    keys = np.zeros(len(at), U)
    for back in range(1, depth + 1):
        keys = keys << U(8) | wide[at - back]
    return keys << U(8) | wide[at], offsets + np.arange(texts + 1), at
