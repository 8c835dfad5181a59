"""Projections of vectors and their places on shifted Hilbert curves (NumPy, used inside Spark tasks)."""

from __future__ import annotations

import numpy as np


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows x axes), each axis ``bits`` wide; axes * bits <= 63.

    Works on whole columns: one pass over the bits undoes the curve's reflections and
    exchanges, a Gray-code pass follows, and the bits of the axes are interleaved.
    """
    axes = cells.shape[1]
    if axes * bits > 63:
        raise ValueError("a curve key holds at most 63 bits")
    x = [cells[:, j].astype(np.int64) for j in range(axes)]
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for j in range(axes):
            reflect = (x[j] & bit) != 0
            exchanged = np.where(reflect, 0, (x[0] ^ x[j]) & low)
            x[0] = np.where(reflect, x[0] ^ low, x[0] ^ exchanged)
            x[j] = x[j] ^ exchanged if j else x[0]
    for j in range(1, axes):
        x[j] = x[j] ^ x[j - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for j in range(axes):
            key = (key << 1) | (((x[j] ^ turn) >> level) & 1)
    return key


class Curves:
    """``count`` orderings of vectors of one length: a random projection to ``axes`` axes, a shift and a curve each."""

    def __init__(self, dim: int, count: int, axes: int, bits: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.axes, self.bits, self.count = axes, bits, count
        # axes of one set of orthogonal directions after another, so that orderings repeat each other little
        need, parts = count * axes, []
        while sum(p.shape[1] for p in parts) < need:
            q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
            parts.append(q)
        self.directions = np.concatenate(parts, axis=1)[:, :need]
        self.shifts = rng.uniform(-0.5, 0.5, need)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Curve keys (rows x orderings) of unit vectors."""
        dim = unit.shape[1]
        # a coordinate of a random unit vector has deviation 1/sqrt(dim); four of them each way, plus the shift, span the grid
        at = (unit @ self.directions) * np.sqrt(dim) / 8.0 + 0.5 + self.shifts / 8.0
        cells = np.clip((at * (1 << self.bits)).astype(np.int64), 0, (1 << self.bits) - 1)
        return np.stack([hilbert_index(cells[:, c * self.axes:(c + 1) * self.axes], self.bits) for c in range(self.count)], axis=1)
