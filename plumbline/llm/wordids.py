"""Words of many texts as small integers, so that windows of words can be handled as arrays."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import xxhash

#: Bytes of a text that are split into words at once: only their numbers stay when the next are split.
SLICE_BYTES = 4 << 20


def slices(data: bytes, space: re.Pattern, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, each but the first beginning with a match of ``space``."""
    start = 0
    while len(data) - start > size:
        cut = space.search(data, start + size)
        if cut is None:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:]


class WordIds:
    """Numbers words in the order of their first use."""

    def __init__(self, *known: bytes):
        self.ids: dict[bytes, int] = defaultdict(count().__next__)
        for word in known:
            self.ids[word]  # noqa: B018  the look-up numbers it

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def words(self) -> list[bytes]:
        return list(self.ids)

    def hashes(self, salt: bytes = b"") -> np.ndarray:
        """Two 64-bit halves of a 128-bit hash of each word, one row per number."""
        digest = xxhash.xxh3_128_digest
        return np.frombuffer(b"".join(digest(salt + w) for w in self.ids), "<u8").reshape(-1, 2)


def rolled(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash of each ``width`` neighbouring hashes, by doubling: log2(width) steps over the array."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda k: np.uint64(pow(factor, k, 1 << 64))
    out, done = None, 0  # of the windows of ``done`` hashes
    part, size = hashes, 1
    while True:
        if width & size:
            out = part if out is None else out[: len(part) - done] * power(size) + part[done:]
            done += size
        if done == width:
            return out[:n]
        part = part[:-size] * power(size) + part[size:]
        size *= 2
