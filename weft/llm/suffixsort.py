"""Suffixes compared by prefix polynomial hashes.

H(x, n), the hash of n bytes at x, comes from two prefix sums in constant time: modulo 2**64 where a hash only chooses
(:class:`Hashes`), modulo the prime 2**61 - 1 where suffixes are compared (:class:`PrimeHashes`), as powers of two have
known colliding strings.  The common extension of two places, to the right or to the left, is found by binary search on n,
so comparing two suffixes takes a logarithmic number of steps, and a bottom-up mergesort orders all suffixes of many small
buckets at once with array operations.  Extensions that matter are verified byte by byte, so a collision of hashes can't
make a match.
"""

from __future__ import annotations

import numpy as np

#: The hashes' multipliers, the prime, and the seed of the bytes' random values.
BASES, PRIME, SEED = (0x9E3779B97F4A7C15, 0x1342543DE82EF95), (1 << 61) - 1, 20_011
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """H over one buffer, modulo 2**64.  ``powers`` is a dictionary kept by the caller: powers are computed once per worker."""

    def __init__(self, data: np.ndarray, powers: dict) -> None:
        n = len(data)
        have = powers.get("word")
        if have is None or len(have[0]) <= n:
            size = max(1 << 16, 1 << (n + 1).bit_length())
            have = powers["word"] = (_powers(BASES[0], size), _powers(pow(BASES[0], -1, 1 << 64), size))
        values = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.back = have[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * have[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]

    def windows(self, length: int) -> np.ndarray:
        """H of every window of that length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.back[:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo PRIME, by halves of 32 bits, as 2**61 = 1 and 2**64 = 8."""
    half = _U(0xFFFFFFFF)
    a1, a0, b1, b0 = a >> _U(32), a & half, b >> _U(32), b & half
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + (low >> _U(61)) + (low & _U(PRIME)))


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, _times(out, np.full(1, pow(base, len(out), PRIME), np.uint64))))
    return out


class PrimeHashes:
    """H over one buffer, modulo PRIME."""

    def __init__(self, data: np.ndarray, powers: dict) -> None:
        n = len(data)
        have = powers.get("prime")
        if have is None or len(have[0]) <= n:
            size = max(1 << 16, 1 << (n + 1).bit_length())
            have = powers["prime"] = (_prime_powers(BASES[1], size), _prime_powers(pow(BASES[1], -1, PRIME), size))
        values = np.random.default_rng(SEED + 1).integers(1, PRIME, 256, dtype=np.uint64)
        self.back = have[1]
        terms = _times(values[data], have[0][:n])
        high, low = np.cumsum(terms >> _U(32)), np.cumsum(terms & _U(0xFFFFFFFF))  # of halves, which can't overflow
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = _reduced(_times(_reduced(high), np.full(1, 1 << 32, np.uint64)) + _reduced(low))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _times(_reduced(self.sums[start + length] + _U(PRIME) - self.sums[start]), self.back[start])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread, as the low bits of H depend on few bits of the bytes."""
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def common(h: Hashes | PrimeHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int = 1) -> np.ndarray:
    """Length of the common extension of places a and b, ``most`` at most; to the left with step -1."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = h.of(a, middle) == h.of(b, middle) if step > 0 else h.of(a - middle, middle) == h.of(b - middle, middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def _order(h: Hashes | PrimeHashes, data: np.ndarray, a, room_a, b, room_b) -> np.ndarray:
    """-1, 0 or 1 as the suffix at a, of length room_a, comes before, with or after that at b."""
    most = np.minimum(room_a, room_b)
    n = common(h, a, b, most)
    end = n == most
    last = len(data) - 1
    by_byte = np.sign(data[np.minimum(a + n, last)].astype(np.int64) - data[np.minimum(b + n, last)])
    return np.where(end, np.sign(room_a - room_b), by_byte)


def sort_buckets(h: Hashes | PrimeHashes, data: np.ndarray, place: np.ndarray, room: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order of the suffixes (place, room) within their buckets.  Rows of a bucket are contiguous; ``first`` and
    ``size`` are those of each row's bucket.  Bottom-up mergesort: runs of doubling width are merged by ranks."""
    order = np.arange(len(place))
    width, widest = 1, int(size.max(initial=0))
    local = order - first
    while width < widest:
        run = local // width
        other = run ^ 1
        low, high = np.minimum(other * width, size), np.minimum((other + 1) * width, size)
        other_first = low.copy()
        mine, left = order, run < other
        while (open_ := low < high).any():
            i = np.flatnonzero(open_)
            middle = (low[i] + high[i]) // 2
            x, y = mine[i], order[first[i] + middle]
            cmp = _order(h, data, place[y], room[y], place[x], room[x])
            before = np.where(left[i], cmp < 0, cmp <= 0)
            low[i], high[i] = np.where(before, middle + 1, low[i]), np.where(before, high[i], middle)
        to = np.minimum(run, other) * width + (local - run * width) + (low - other_first)
        new = np.empty_like(order)
        new[first + to] = order
        order, width = new, width * 2
    return order
