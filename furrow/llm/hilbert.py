"""Positions of grid points on a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of integer points (points, dims) below 2 ** bits.

    Walks from the coarsest to the finest bit: at each level the cell's place
    within its parent is a Gray code of the coordinates' bits, and the frame
    is reflected and swapped for the next level (all points together). At most
    63 bits in all.
    """
    x = grid.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        low = high - one
        for d in range(dims):
            turned = (x[d] & high) != 0
            swap = (x[0] ^ x[d]) & low
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = np.where(turned, x[d], x[d] ^ swap)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        flip = np.where(x[-1] & high, flip ^ (high - one), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(level)) & one)
    return key.astype(np.int64)
