"""Sets of hashed word shingles, as flat numpy arrays."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes.

    Words are the runs without ASCII white space, A-Z lower-cased. A text of
    fewer than ``width`` words has its whole sequence as one shingle; one
    without words has none.
    """

    #: Distinct words whose hashes are kept; beyond it all are forgotten.
    KEPT = 200_000

    def __init__(self, width: int):
        self.width = width
        self.mult = mix64(np.arange(1, width + 1, dtype=np.uint64) * _MULT) | np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.hashes = np.zeros(0, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.KEPT:
            self._forget()
        codes = [list(map(self.known.__getitem__, t.encode().lower().split())) if t else [] for t in texts]
        fresh = list(self.known)[len(self.hashes):]
        self.hashes = np.r_[self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))]
        out = []
        for c in codes:
            h = self.hashes[np.asarray(c, np.int64)]
            n = len(h) - self.width + 1
            if n > 0:
                total = h[:n] * self.mult[0]
                for j in range(1, self.width):
                    total = total + h[j:j + n] * self.mult[j]
            else:
                total = np.asarray([np.sum(h * self.mult[:len(h)], dtype=np.uint64) + np.uint64(len(h))] if len(h) else [], np.uint64)
            out.append(np.unique(mix64(total)))
        return out
