"""Words of many texts as numbers, by whole-array operations on their bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 21:  # longer texts are rare; their tables aren't kept
            _powers[base] = have
    return have[:n]


class Words:
    """Words (runs of anything but ASCII white space) of texts: start and end in ``data``, text number, 64-bit hash."""

    def __init__(self, texts: list[str | None], lower: bool):
        raw = [t.encode() if t else b"" for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        space = SPACE[self.data]
        before = np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))  # per text, its first word; and the end
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(raw)), self.count)
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, n), dtype=np.uint64)])
        moved = (total[self.end] - total[self.start]) * _power(_BASE_INVERSE, n)[self.start]
        self.hash = mixed(moved + (self.end - self.start).astype(np.uint64))
