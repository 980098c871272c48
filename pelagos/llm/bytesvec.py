"""Vectorised work on many texts at once: their bytes lie end to end in one numpy array."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: White space between words: space and the bytes 9 to 13.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        base = 0x5851F42D4C957F2D
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[:] = pair
    return _POWERS[0][:n], _POWERS[1][:n]


def in_blocks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if len(texts) > start:
        yield start, len(texts)


class Words:
    """The words of a block of texts: ``hash`` (64 bits), ``size`` (bytes) and ``doc`` (index of the text) of each.

    Letters A-Z are lower-cased unless told otherwise. ``breaks`` marks the bytes that part words; ``gap`` line
    ends stand before each text, which starts at ``text_at`` in ``data``. Words start at ``start``.
    """

    def __init__(self, texts: list[bytes], lower: bool = True, breaks: np.ndarray = IS_SPACE, gap: int = 1):
        sep = b"\n" * gap
        data = np.frombuffer(sep + sep.join(texts) + b"\n", dtype=np.uint8)
        data = LOWER[data] if lower else data
        space = breaks[data]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        stops = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        up, down = _powers(len(data))
        values = _BYTE_VALUES[data]
        values[space] = 0
        values *= up
        self.data, self.start, self._down = data, starts, down
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        self.size = stops - starts
        self.hash = mix((self._sums[stops] - self._sums[starts]) * down[starts])
        sizes = np.array([len(t) + gap for t in texts], dtype=np.int64)
        self.text_at = np.cumsum(sizes) - sizes + gap
        self.doc = np.searchsorted(self.text_at, starts, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes of the words that have as many, and which words those are."""
        which = np.flatnonzero(self.size >= n)
        at = self.start[which]
        return mix((self._sums[at + n] - self._sums[at]) * self._down[at]), which


def binary_column(batch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def nonempty(batches: Iterable) -> Iterator:
    return (b for b in batches if b.num_rows)
