"""Places of points on a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of cell numbers from 0 to ``2 ** bits - 1``, as int64.

    The axes are turned into the curve's transposed index by undoing its rotations from the highest bit down, and
    the index is read off bit by bit across the axes. All axes together may have 63 bits.
    """
    points, axes = cells.shape
    if axes * bits > 63:
        raise ValueError("an index has 63 bits at most")
    x = [np.ascontiguousarray(cells[:, axis]).astype(np.int64) for axis in range(axes)]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(axes):
            inverted = (x[axis] >> level & 1).astype(bool)
            swapped = np.where(inverted, 0, (x[0] ^ x[axis]) & below)
            x[0] = np.where(inverted, x[0] ^ below, x[0] ^ swapped)
            x[axis] ^= swapped
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turned = np.zeros(points, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    index = np.zeros(points, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            index = index << 1 | (x[axis] ^ turned) >> level & 1
    return index
