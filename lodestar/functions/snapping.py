"""The closest of many points for many places of one tile, in NumPy."""

from __future__ import annotations

import numpy as np

# Pairs that are in memory at once.
_PAIRS = 1_000_000


def _closest(places: np.ndarray, points: np.ndarray, rank: np.ndarray, reach: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(distance in units of 1e-9, rank) of the closest point in the nine cells around each place; infinity and the greatest number without any."""
    none = np.iinfo(np.int64).max
    low = np.array([points.real.min(), points.imag.min()])
    cell = lambda z: (np.floor((z.real - low[0]) / width).astype(np.int64), np.floor((z.imag - low[1]) / width).astype(np.int64))
    gx, gy = cell(points)
    rows = int(gy.max()) + 1
    stride = rows + 6  # cells below and above the points stay empty, so rows of cells don't touch
    key = gx * stride + gy + 3
    order = np.argsort(key, kind="stable")
    key, points, rank = key[order], points[order], rank[order]
    cx, cy = cell(places)
    cy = np.clip(cy, -2, rows + 1) + 3
    at = (cx[:, None] + np.array([-1, 0, 1])) * stride + cy[:, None]
    start = np.searchsorted(key, at - 1)
    size = np.searchsorted(key, at + 1, "right") - start
    total = size.sum(axis=1)
    met = np.flatnonzero(total)
    best, who = np.full(len(places), np.inf), np.full(len(places), none)
    upto = np.cumsum(total[met])
    i = 0
    while i < len(met):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _PAIRS, "right")))
        mine, s, n = met[i:j], start[met[i:j]].ravel(), size[met[i:j]].ravel()
        point = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.repeat(np.arange(len(mine)), total[mine])
        first = np.cumsum(total[mine]) - total[mine]
        away = places[mine][place] - points[point]
        d = np.sqrt(away.real * away.real + away.imag * away.imag)
        units = np.where(d <= reach, np.floor(d * 1e9 + 0.5), np.inf)
        best[mine] = np.minimum.reduceat(units, first)
        who[mine] = np.minimum.reduceat(np.where((units == best[mine][place]) & (d <= reach), rank[point], none), first)
        i = j
    return best, who


def nearest_within(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, rank: np.ndarray, reach: float) -> np.ndarray:
    """For each place (px, py) the rank of the closest point within reach, -1 without any.

    Distances count to nine decimals, then the least rank wins.  Equal places are one.  Cells double in
    width: a place is settled once its closest point lies no farther off than a cell is wide.
    """
    out = np.full(len(px), -1, np.int64)
    if not len(px) or not len(qx):
        return out
    places, back = np.unique(px + 1j * py, return_inverse=True)
    points = qx + 1j * qy
    found = np.full(len(places), -1, np.int64)
    todo = np.arange(len(places))
    last = reach * (1 + 1e-9)
    # About four points for a cell to begin with, where they lie evenly.
    width = min(max(float(np.sqrt(4 * np.ptp(qx) * np.ptp(qy) / len(qx))), last / 1024), last)
    while len(todo):
        best, who = _closest(places[todo], points, rank, reach, width)
        seen = who < np.iinfo(np.int64).max
        done = seen & (best * 1e-9 + 2e-9 <= width) if width < last else seen
        found[todo[done]] = who[done]
        if width >= last:
            break
        todo, width = todo[~done], min(width * 2, last)
    return found[back.reshape(-1)] if len(found) else out
