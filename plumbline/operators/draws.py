"""The pseudo-random draws of Spark ML's forests, value for value: counts of rows in each tree, features tried at each node.

Spark keeps these generators in its JVM. Here they are on NumPy arrays, so that a forest grown elsewhere is the one Spark ML grows
from the same partitions and seed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

_WORD, _SIZE = 0xFFFFFFFF, 624
_M1, _M2, _M3 = 70, 179, 449

#: Words made at once: no word needs one that is less than so many steps older, but for the last one.
_BLOCK = 69

_LCG, _ADD, _LCG_MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


class Poisson:
    """Poisson(1) counts of commons-math's ``PoissonDistribution`` on a ``Well19937c``, in their order."""

    def __init__(self, seed: int):
        seed &= (1 << 64) - 1
        signed = lambda x: x - (1 << 32) if x >> 31 else x
        v = [seed >> 32, seed & _WORD]
        for i in range(2, _SIZE):
            x = signed(v[i - 2])
            v.append((1812433253 * (x ^ (x >> 30)) + i) & _WORD)
        # the generator walks its ring backwards: the oldest word comes first here, and v[0] is the last one made
        self._ring = np.array(v[:0:-1], np.uint32)
        self._last = v[0]
        self._left = np.empty(0)

    def _words(self, n: int) -> np.ndarray:
        """The next n words. ``ring`` has the 623 words that steps left behind, oldest first."""
        blocks = -(-n // _BLOCK)
        ring = np.empty(_SIZE - 1 + blocks * _BLOCK, np.uint32)
        ring[: _SIZE - 1] = self._ring
        out = np.empty(blocks * _BLOCK, np.uint32)
        x, at = self._last, 0
        for b in range(0, blocks * _BLOCK, _BLOCK):
            end = b + _SIZE - 1
            old = lambda k, end=end: ring[end - k : end - k + _BLOCK]  # noqa: E731  what lies k places on, for each step
            z0 = (old(623) & np.uint32(0x80000000)) ^ (old(622) & np.uint32(0x7FFFFFFF))
            m1, m3 = old(_M1), old(_M3)
            e = m1 ^ (m1 >> np.uint32(27))
            z2 = (old(_M2) >> np.uint32(9)) ^ m3 ^ (m3 >> np.uint32(1))
            h = e ^ z2
            # z1 and z3 cancel but for z2
            g = z0 ^ (e << np.uint32(9)) ^ (z2 << np.uint32(21)) ^ (h >> np.uint32(21))
            made = [x]
            for y in g.tolist():
                u = x ^ (x << 25 & _WORD)
                x = y ^ (u << 9 & _WORD) ^ (u >> 21)
                made.append(x)
            all_ = np.array(made, np.uint32)
            before = all_[:-1]
            ring[end : end + _BLOCK] = before ^ (before << np.uint32(25)) ^ h
            out[at : at + _BLOCK] = all_[1:]
            at += _BLOCK
        self._ring, self._last = ring[-(_SIZE - 1) :].copy(), x
        return out

    def _uniforms(self, n: int) -> np.ndarray:
        z = self._words(_BLOCK * 2 * -(-n // _BLOCK))
        z = z ^ ((z << np.uint32(7)) & np.uint32(0xE46E1700))
        z = z ^ ((z << np.uint32(15)) & np.uint32(0x9B868000))
        z = (z >> np.uint32(6)).astype(np.uint64)
        return ((z[::2] << np.uint64(26)) | z[1::2]).astype(np.float64) * 2.0**-52

    def counts(self, n: int) -> np.ndarray:
        """The next n counts: how many uniforms in a row keep their product at exp(-1) or more."""
        floor, out = math.exp(-1.0), []
        while len(out) < n:
            u = np.concatenate([self._left, self._uniforms(2 * (n - len(out)) + 64)])
            # for every place, how many uniforms a count that began there would use
            used, product, going = np.ones(len(u), np.int64), u.copy(), u >= floor
            step = 0
            while going.any():
                step += 1
                used[going] += 1
                product[: len(u) - step] *= u[step:]
                product[max(0, len(u) - step) :] = np.nan  # the uniforms that it needs are not there yet
                used[np.isnan(product)] = 1 << 40
                going &= product >= floor
            use, at, end = used.tolist(), 0, len(u)
            while len(out) < n and at < end and at + use[at] <= end:
                out.append(use[at] - 1)
                at += use[at]
            self._left = u[at:]
        return np.array(out, np.uint8)


class _Shift:
    """Spark's ``XORShiftRandom``, one for each of many seeds."""

    def __init__(self, seeds: np.ndarray):
        data = seeds.astype(np.uint64)
        low = self._hash(data, np.full(len(data), 0x3C074A61, np.uint32))
        self.state = (self._hash(data, low).astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)

    @staticmethod
    def _hash(data: np.ndarray, h: np.ndarray) -> np.ndarray:
        """MurmurHash3 of the eight bytes, highest byte first."""
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        for half in ((data >> np.uint64(32)).astype(np.uint32), (data & np.uint64(_WORD)).astype(np.uint32)):
            k = turn(half.byteswap() * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = h ^ np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return h ^ (h >> np.uint32(16))

    def bits(self, n: int) -> np.ndarray:
        s = self.state
        s = s ^ (s << np.uint64(21))
        s = s ^ (s >> np.uint64(35))
        self.state = s = s ^ (s << np.uint64(4))
        return s & np.uint64((1 << n) - 1)

    def doubles(self) -> np.ndarray:
        high = self.bits(26)
        return ((high << np.uint64(27)) + self.bits(27)).astype(np.float64) * 2.0**-53


def sample_seed(seed: int) -> int:
    """The seed with which the rows are sampled that cut features into bins."""
    return int(_Shift(np.array([seed & ((1 << 64) - 1)], np.uint64)).bits(32).astype(np.uint32).view(np.int32)[0])


class Subsets:
    """The features tried at each node, for one node after the other."""

    def __init__(self, seed: int, features: int, tried: int):
        self.state = (seed ^ _LCG) & _LCG_MASK
        self.features, self.tried = features, tried

    def _longs(self, n: int) -> np.ndarray:
        """``java.util.Random.nextLong``, n times, as unsigned."""
        power = np.cumprod(np.full(2 * n, _LCG, np.uint64))
        added = np.cumsum(np.concatenate([np.ones(1, np.uint64), power[:-1]]))
        states = (power * np.uint64(self.state) + added * np.uint64(_ADD)) & np.uint64(_LCG_MASK)
        self.state = int(states[-1])
        words = (states >> np.uint64(16)).astype(np.uint32)
        return (words[::2].astype(np.uint64) << np.uint64(32)) + words[1::2].view(np.int32).astype(np.int64).view(np.uint64)

    def take(self, n: int) -> np.ndarray:
        """(n, tried) features, in the order in which they are compared."""
        found = np.tile(np.arange(self.tried, dtype=np.int32), (n, 1))
        if n and self.tried < self.features:
            random = _Shift(self._longs(n))
            for item in range(self.tried, self.features):
                place = (random.doubles() * (item + 1)).astype(np.int64)
                hit = np.flatnonzero(place < self.tried)
                found[hit, place[hit]] = item
        return found


def map_order(keys: Sequence[int]) -> list[int]:
    """Small whole numbers in the order in which a Scala map of them is walked."""
    if len(keys) <= 4:
        return sorted(keys, key=lambda k: (k & 15, k))

    def improved(k: int) -> int:
        h = (k + ~(k << 9)) & _WORD
        h ^= h >> 14
        h = (h + (h << 4)) & _WORD
        return h ^ (h >> 10)

    def walk(some: list[tuple[int, int]], shift: int) -> list[int]:
        slots: dict[int, list] = {}
        for h, k in some:
            slots.setdefault((h >> shift) & 31, []).append((h, k))
        ordered = [slots[s] for s in sorted(slots)]
        alone = [s[0][1] for s in ordered if len(s) == 1]
        return alone + [k for s in ordered if len(s) > 1 for k in walk(s, shift + 5)]

    return walk([(improved(k), k) for k in keys], 0)
