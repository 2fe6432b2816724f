"""Content anchors of byte strings: where equal long windows must agree.

A window of ``WINDOW`` bytes picks its smallest ``GRAM``-byte hash, the
leftmost on ties. Equal windows pick the same place in them, so two equal
windows always meet at an anchor with the same bytes around it, wherever they
lie. About one byte in 85 of ordinary text is an anchor.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES, OTHER = (np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64) for seed in (20240229, 20250131))
_POS_MASK = _U((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Hashes:
    """Hashes of any byte intervals of one buffer, from running sums of byte value times base power.

    ``table``: the values of bytes; hashes by ``OTHER`` are independent of those by the usual table.
    """

    _power = _back = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTES):
        n = len(data) + 1
        if len(Hashes._power) < n:
            Hashes._power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
            Hashes._back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(table[data] * Hashes._power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * Hashes._back[start] + length * _U(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * Hashes._back[:n]


def anchors(data: np.ndarray, hashes: Hashes, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings ``[start, end)`` in ``data``, ascending: position, first and last start of the windows that pick it.

    ``starts`` ascend and strings don't overlap; a string shorter than
    ``window`` has no anchor. ``data`` must be shorter than 16 MiB.
    """
    span = window - GRAM + 1
    if len(data) < window:
        return (np.empty(0, np.int64),) * 3
    keys = hashes.grams(GRAM) * _U(0xC2B2AE3D27D4EB4F)
    keys &= ~_POS_MASK
    keys |= np.arange(len(keys), dtype=np.uint64)
    least, width = keys, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    inside = np.zeros(len(least) + 1, np.int32)  # a window must not run over a string's end
    long = ends - starts >= window
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - window + 1, -1)
    begin = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    picked = (least[begin] & _POS_MASK).astype(np.int64)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(picked)), bool), picked[1:] != picked[:-1]]))
    return picked[new], begin[new], begin[np.append(new[1:], len(picked)) - 1] if len(new) else begin
