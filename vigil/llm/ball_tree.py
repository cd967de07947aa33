"""A ball tree over the entries of one codebook, asked for the nearest entry of many integer vectors at once.

Distances to balls are taken in floating point and rounded so that no ball is passed over that could hold an entry
at least as near as the best so far (ties are visited, too); the distances to entries are exact integers.
"""

from __future__ import annotations

import numpy as np

LEAF = 2
#: Components up to this size keep squared distances of up to 2,048 components exact in 64 bits; larger ones are Python integers.
SAFE = 1 << 25


def integers(rows: np.ndarray) -> np.ndarray:
    """The integers in 64 bits if their squared distances fit, else as Python integers."""
    if rows.dtype == object and all(-SAFE <= x <= SAFE for x in rows.flat) and rows.shape[-1] <= 2_048:
        return rows.astype(np.int64)
    return rows


class BallTree:
    def __init__(self, entries: np.ndarray):
        """entries: (count, width) integers, in order of their indexes."""
        self.entries = entries
        self.exact = entries.dtype == object
        # Floating point works on multiples of a unit, so that no square overflows.
        self.unit = max(1, int(abs(entries).max())) if self.exact else 1
        self.root = self._build(np.arange(len(entries)))

    def _build(self, at: np.ndarray) -> tuple:
        points = self._floats(self.entries[at], self.unit)
        centre = points.mean(0)
        distance = np.sqrt(((points - centre) ** 2).sum(1))
        # Rounded up: a few units in the last place of everything that went into it.
        radius = float(distance.max()) * (1 + 1e-9) + 1e-6 * (1 + np.abs(points).max() * 1e-6)
        if len(at) <= LEAF:
            return centre, radius, at, None, None
        a = points[distance.argmax()]
        far = ((points - a) ** 2).sum(1)
        b = points[far.argmax()]
        nearer_a = far <= ((points - b) ** 2).sum(1)
        if nearer_a.all() or not nearer_a.any():  # equal points
            nearer_a = np.arange(len(at)) < len(at) // 2
        return centre, radius, None, self._build(at[nearer_a]), self._build(at[~nearer_a])

    def _floats(self, rows: np.ndarray, unit: int) -> np.ndarray:
        return (rows / unit if unit > 1 else rows).astype(np.float64)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query (the lowest of equals), and the squared distance."""
        exact = self.exact or queries.dtype == object
        entries = self.entries.astype(object) if exact else self.entries
        queries = queries.astype(object) if exact else queries
        n, kind = len(queries), object if exact else np.int64
        best, error = np.full(n, -1, np.int64), np.full(n, -1, kind)
        unit = max(self.unit, int(abs(queries).max(initial=0))) if exact else 1
        shrunk = self.unit / unit
        as_float = self._floats(queries, unit)
        size = np.abs(as_float).max(1, initial=0)

        def gap(node: tuple, i: np.ndarray) -> np.ndarray:
            """No more than the distance from the queries to any entry of the ball."""
            to_centre = np.sqrt(((as_float[i] - node[0] * shrunk) ** 2).sum(1))
            return to_centre * (1 - 1e-9) - node[1] * shrunk - 1e-6 * (1 + size[i] * 1e-6)

        def visit(node: tuple, i: np.ndarray) -> None:
            _, _, members, left, right = node
            if members is not None:
                for e in members.tolist():
                    d = ((queries[i] - entries[e]) ** 2).sum(1)
                    better = ((best[i] < 0) | (d < error[i]) | ((d == error[i]) & (e < best[i]))).astype(bool)
                    j = i[better]
                    best[j], error[j] = e, d[better]
                return
            to_left, to_right = gap(left, i), gap(right, i)
            first = to_left <= to_right
            for near, far, to_far, mine in ((left, right, to_right, first), (right, left, to_left, ~first)):
                if not mine.any():
                    continue
                j, bound = i[mine], to_far[mine]
                visit(near, j)
                # Not strict: a ball that touches the best distance may hold an equal entry of lower index.
                open_ = bound <= np.sqrt(self._floats(error[j], unit * unit)) * (1 + 1e-9)
                if open_.any():
                    visit(far, j[open_])

        if n:
            visit(self.root, np.arange(n))
        return best, error
