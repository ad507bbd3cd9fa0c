"""Words of many texts at once, as NumPy arrays: positions, rolling hashes, windows."""

from __future__ import annotations

import functools

import numpy as np

#: The white space of the contracts: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

#: Bytes or hashes that a running sum goes over at once. Workers keep powers for so many from one query to the next.
BLOCK = 1 << 17


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n-1, modulo 2**64."""
    return _powers(int(base), 1 << max(10, (n - 1).bit_length()))[:n]


def _running(x: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sums of x[:k] times the powers of ``base``, for each k from 0."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(base, len(x)), out=total[1:])
    return total


def _polynomial(data: np.ndarray) -> np.uint64:
    """What the bytes of one word add up to before they are mixed, block by block."""
    total = 0
    for a in range(0, len(data), BLOCK):
        part = int(_running(data[a : a + BLOCK].astype(np.uint64) + np.uint64(1), _ODD)[-1])
        total += part * pow(int(_ODD), a, 1 << 64)
    return np.uint64(total % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() touches A-Z only


def slices(texts: list[bytes], most: int):
    """Runs of consecutive texts of about ``most`` bytes together, as (first, past the last)."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class Words:
    """The words of several texts, joined by line feeds.

    ``start`` and ``end`` are byte positions in ``data``; ``first[d]`` is the index of text d's
    first word, ``first[-1]`` the number of words; ``doc`` is each word's text.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, np.uint8)
        gap = SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, from running sums over blocks of words."""
        out = np.zeros(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            base = int(self.start[a])
            b = int(np.searchsorted(self.end, base + BLOCK, side="right"))
            if b == a:  # a word longer than a block
                out[a] = _polynomial(self.data[base : self.end[a]])
                a += 1
                continue
            total = _running(self.data[base : self.end[b - 1]].astype(np.uint64) + np.uint64(1), _ODD)
            start, end = self.start[a:b] - base, self.end[a:b] - base
            out[a:b] = (total[end] - total[start]) * powers(_ODD_INV, len(total))[start]
            a = b
        return mix(out)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1 as they stand, white space between them included."""
        return self.raw[self.start[a] : self.end[b - 1]]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive items; shorter by width-1 than ``h``."""
    out = np.zeros(max(0, len(h) - width + 1), np.uint64)
    step = max(BLOCK - width, width)
    for a in range(0, len(out), step):
        total = _running(h[a : a + step + width - 1], _STEP)
        runs = total[width:] - total[:-width]
        out[a : a + step] = mix(runs * powers(_STEP_INV, len(runs)))
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the half-open spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0
