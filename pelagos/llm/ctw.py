"""Context-tree weighting over bytes, each byte decomposed into eight binary decisions."""

from __future__ import annotations

import numpy as np

from .bytesvec import mix
from .lookup import Lookup

#: Bytes of context at most; a gram is those and the byte that follows.
DEPTH = 5
_U8 = np.uint64(8)


def log_factorials(n: np.ndarray) -> np.ndarray:
    """log of Gamma(n + 1/2) by Stirling's series, shifted so that it is exact to 1e-10 from n = 0 on."""
    x = n.astype(np.float64) + 0.5
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _log_gamma_next(n: np.ndarray) -> np.ndarray:
    """log n!"""
    x = n.astype(np.float64) + 1.0
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift[small] -= np.log(x[small])
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def block_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_factorials(zeros) + log_factorials(ones) - _log_gamma_next(zeros + ones) - 1.1447298858494002


class Level:
    """The contexts of one depth: ``keys`` (context bytes, nearest first, then the byte that follows) in order, and their bit nodes.

    ``node[:, j]`` is the node of an entry's bit j, which all entries with the same context and the same j leading
    bits share. ``zeros`` and ``ones`` count what followed there.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        n = len(keys)
        self.node = np.empty((n, 8), dtype=np.int64)
        self.ids, zeros, ones = [], [], []
        base = 0
        for j in range(8):
            head = keys >> np.uint64(8 - j)  # the context and the leading bits
            new = np.ones(n, dtype=bool)
            new[1:] = head[1:] != head[:-1]
            at = np.flatnonzero(new)
            self.node[:, j] = base + np.cumsum(new) - 1
            bit = (keys >> np.uint64(7 - j)) & np.uint64(1) == 1
            ones.append(np.add.reduceat(np.where(bit, counts, 0), at) if n else np.zeros(0, np.int64))
            zeros.append(np.add.reduceat(np.where(bit, 0, counts), at) if n else np.zeros(0, np.int64))
            # a node's name: the context, then a one and the leading bits
            context = keys[at] >> _U8
            self.ids.append((context << _U8) | np.uint64(1 << j) | (head[at] & np.uint64((1 << j) - 1)))
            base += len(at)
        self.ids = np.concatenate(self.ids)
        self.zeros, self.ones = np.concatenate(zeros), np.concatenate(ones)

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts with one context byte less, the farthest."""
        keys = ((self.keys >> np.uint64(16)) << _U8) | (self.keys & np.uint64(255))
        return summed(keys, self.counts)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], (np.add.reduceat(counts, at) if len(at) else counts)


def parent_ids(ids: np.ndarray) -> np.ndarray:
    """The names of the same bit nodes with one context byte less."""
    return ((ids >> np.uint64(16)) << _U8) | (ids & np.uint64(255))


def find_nodes(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(names, kind="stable")
    return order[np.searchsorted(names[order], wanted)]


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, least: int) -> list[Level]:
    """The levels from ``depth`` down to ``least``, from the counts of the deepest one's grams."""
    out = [Level(keys, counts)]
    for _ in range(depth - least):
        out.append(Level(*out[-1].shorter()))
    return out


def weigh_up(of: list[Level], below: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """From the deepest level up: each node's log weighted probability, log weight of its own estimate, and place of its parent.

    ``below``: log products of the children's weighted probabilities at the first level, which is then no leaf.
    """
    weighted, own, parents = [], [], []
    for i, level in enumerate(of):
        kt = block_kt(level.zeros, level.ones)
        if i:
            parents.append(find_nodes(level.ids, parent_ids(of[i - 1].ids)))
            children = np.bincount(parents[-1], weights=weighted[-1], minlength=len(kt))
        else:
            children = below
        if children is None:
            weighted.append(kt)
            own.append(np.zeros(len(kt)))
        else:
            both = np.logaddexp(kt, children) - np.log(2)
            weighted.append(both)
            own.append(kt - np.log(2) - both)
    return weighted, own, parents


def mix_down(of: list[Level], own: list[np.ndarray], parents: list[np.ndarray], above: tuple[np.ndarray, np.ndarray] | None = None):
    """From the shallowest level down: at each node the probability of a one, mixed over its context's depths so far.

    ``above``: for each node of the shallowest level what the depths above contribute to it, and the weight they
    leave. Returns the probabilities by level, shallow first (a context that goes no deeper uses its last), and
    the same two arrays for the children of the deepest level.
    """
    given, left = above if above is not None else (np.zeros(len(of[-1].ones)), np.ones(len(of[-1].ones)))
    out = []
    for i in range(len(of) - 1, -1, -1):
        kt = (of[i].ones + 0.5) / (of[i].ones + of[i].zeros + 1)
        out.append(given + left * kt)
        w = np.exp(own[i])
        given, left = given + left * w * kt, left * (1 - w)
        if i:
            given, left = given[parents[i - 1]], left[parents[i - 1]]
    return out, (given, left)


def code_lengths(level: Level, p_one: np.ndarray) -> np.ndarray:
    """Per entry and bit j the log10 probability of its leading j + 1 bits."""
    out = np.empty((len(level.keys), 8), dtype=np.float32)
    total = np.zeros(len(level.keys))
    for j in range(8):
        p = p_one[level.node[:, j]]
        bit = (level.keys >> np.uint64(7 - j)) & np.uint64(1) == 1
        total += np.log10(np.where(bit, p, 1 - p))
        out[:, j] = total
    return out


class Tree:
    """Mixed code lengths of all contexts by depth, and the log10 probability of grams under them."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        self.tables = tables  # by depth: keys in order, code lengths of their leading bits
        keys, lengths = tables[-1]
        self._deepest = Lookup(mix(keys), lengths[:, 7] if len(keys) else np.zeros(0))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """A gram met in training has its value; another one's bits are each coded at the deepest context that has their node."""
        at = self._deepest.find(mix(grams))
        out = self._deepest.values[np.maximum(at, 0)].astype(np.float64) if len(self._deepest.values) else np.zeros(len(grams))
        new = np.flatnonzero(at < 0)
        if len(new):
            out[new] = self._unmet(grams[new])
        return out

    def _unmet(self, grams: np.ndarray) -> np.ndarray:
        total, done = np.zeros(len(grams)), np.zeros(len(grams), dtype=np.int64)
        deepest = len(self.tables) - 1
        for depth in range(deepest, -1, -1):
            keys, lengths = self.tables[depth]
            if not len(keys):
                continue
            key = ((grams >> np.uint64(8 * (deepest - depth) + 8)) << _U8) | (grams & np.uint64(255))
            # the neighbours in order share the most leading bits with the wanted byte
            right = np.searchsorted(keys, key)
            shared, nearest = np.full(len(grams), -1), np.zeros(len(grams), dtype=np.int64)
            for x in (np.minimum(right, len(keys) - 1), np.maximum(right - 1, 0)):
                differ = ((keys[x] ^ key) & np.uint64(255)).astype(np.int64)
                lead = np.where(differ == 0, 8, 8 - np.frexp(np.maximum(differ, 1))[1])
                lead = np.where(keys[x] >> _U8 == key >> _U8, lead, -1)
                nearest = np.where(lead > shared, x, nearest)
                shared = np.maximum(lead, shared)
            use = np.flatnonzero((shared >= done) & (done < 8))
            i = np.arange(len(use))
            sums = np.concatenate([np.zeros((len(use), 1)), lengths[nearest[use]]], axis=1)
            to, since = shared[use], done[use]
            total[use] += sums[i, to] - sums[i, since]
            # at the node where the byte leaves the ones met before it takes the other branch
            other = 1 - 10.0 ** (sums[i, np.minimum(to + 1, 8)] - sums[i, np.minimum(to, 8)])
            total[use] += np.where(to < 8, np.log10(np.maximum(other, 1e-9)), 0)
            done[use] = np.minimum(to + 1, 8)
        return total - (8 - done) * np.log10(2)
