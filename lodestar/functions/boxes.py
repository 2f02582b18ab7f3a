"""Relations of upright boxes, counted block by block in NumPy: no pair becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

TYPES = ("near", "on", "inside", "under")
# Blocks of so many targets and anchors meet at once, in arrays that a core's cache holds.
_TARGETS, _ANCHORS = 64, 512


def faces(boxes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Centres, sizes, ends along each axis and area, from columns cx, cy, cz, sx, sy and sz; null is nan."""
    f = {n: boxes[n].to_numpy(float) for n in ("cx", "cy", "cz", "sx", "sy", "sz")}
    for axis in "xyz":
        f[f"l{axis}"], f[f"h{axis}"] = f[f"c{axis}"] - f[f"s{axis}"] / 2, f[f"c{axis}"] + f[f"s{axis}"] / 2
    return f | {"area": f["sx"] * f["sy"], "known": boxes["known"].to_numpy(bool)}


def _overlap(a: dict, b: dict) -> np.ndarray:
    side = lambda axis: np.maximum(np.minimum(a[f"h{axis}"], b[f"h{axis}"]) - np.maximum(a[f"l{axis}"], b[f"l{axis}"]), 0)
    return side("x") * side("y") / np.maximum(np.fmin(a["area"], b["area"]), 1e-9)


def _near(a: dict, b: dict, limit: float) -> np.ndarray:
    side = lambda axis: np.maximum(np.abs(a[f"c{axis}"] - b[f"c{axis}"]) - (a[f"s{axis}"] + b[f"s{axis}"]) / 2, 0)
    x, y = side("x"), side("y")
    return np.sqrt(x * x + y * y) <= limit


def _tiles(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """An order in which runs of so many places (u, v) are compact: strips along u, each by v."""
    strip = np.empty(len(u), np.int64)
    strip[np.argsort(u, kind="stable")] = np.arange(len(u)) // max(int(np.ceil(np.sqrt(len(u) / size))) * size, 1)
    return np.lexsort((v, strip))


def count(a: dict, a_id: np.ndarray, b: dict, b_id: np.ndarray, near: float, on: float, inside: float, under: float, least: float) -> np.ndarray:
    """A row for each of ``TYPES``, a column for each box of ``a``: how many boxes of ``b`` with another id it relates to.

    Anchors out of a type's reach along an axis are never looked at, and blocks that are near as a whole
    count at once.  As in SQL, nan is greater than all numbers.
    """
    n = np.zeros((len(TYPES), len(a_id)), np.int64)
    by_id = np.argsort(b_id, kind="stable")
    first, last = (np.searchsorted(b_id[by_id], a_id, side) for side in ("left", "right"))
    span = [np.fmax.reduce(np.abs(f[c]), initial=1.0) for f in (a, b) for c in ("lx", "hx", "ly", "hy", "lz", "hz")]
    slack = 1e-9 * max(span)

    def same(rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one id: the target's place among the rows, the anchor's place in its order."""
        size = last[rows] - first[rows]
        at = np.repeat(first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), place[by_id[at]]

    def met(kind: str, rows: np.ndarray, x: dict, y: dict, runs: list[tuple[int, int]], test: Callable, r: np.ndarray, p: np.ndarray) -> None:
        for s, e in runs:
            hit = test(x, {k: v[None, s:e] for k, v in y.items()})
            own = (p >= s) & (p < e)
            hit[r[own], p[own] - s] = False
            n[TYPES.index(kind), rows] += np.bitwise_count(np.packbits(hit, axis=1)).sum(axis=1, dtype=np.int64)

    def ordered(order: np.ndarray) -> tuple[dict, np.ndarray]:
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return {k: v[order] for k, v in b.items()}, place

    def sweep(kind: str, of_a: str, of_b: str, low: float, high: float, test: Callable) -> None:
        """All pairs whose ``of_b`` less ``of_a`` may lie between low and high."""
        y, place = ordered(np.argsort(b[of_b], kind="stable"))
        along = np.argsort(a[of_a], kind="stable")
        for i in range(0, len(along), _TARGETS):
            rows = along[i : i + _TARGETS]
            x = {k: v[rows][:, None] for k, v in a.items()}
            start = np.searchsorted(y[of_b], np.fmin.reduce(a[of_a][rows]) + low - slack)
            stop = np.searchsorted(y[of_b], np.fmax.reduce(a[of_a][rows]) + high + slack, "right")
            met(kind, rows, x, y, [(s, min(s + _ANCHORS, stop)) for s in range(start, stop, _ANCHORS)], test, *same(rows, place))

    def rests(x: dict, y: dict) -> np.ndarray:
        hit = (np.abs(x["lz"] - y["hz"]) <= on) & (x["cz"] > y["cz"])
        return hit & ~(_overlap(x, y) < least) if hit.any() else hit

    def hangs(x: dict, y: dict) -> np.ndarray:
        clear = y["lz"] - x["hz"]
        hit = (clear >= 0) & (clear <= under) & (x["cz"] < y["cz"])
        return hit & ~(_overlap(x, y) < least) if hit.any() else hit

    def holds(x: dict, y: dict) -> np.ndarray:
        out = ~(x["known"] & y["known"])
        for axis in "xyz":
            out = out | (x[f"l{axis}"] - y[f"l{axis}"] < -inside) | (y[f"h{axis}"] - x[f"h{axis}"] < -inside)
            if out.all():
                break
        return ~out

    sweep("on", "lz", "hz", -on, on, rests)
    sweep("under", "hz", "lz", 0.0, under, hangs)

    starts = np.arange(0, len(b_id), _ANCHORS)
    ends = np.minimum(starts + _ANCHORS, len(b_id))

    def tiled(u: str, v: str, more: tuple[str, ...] = ()) -> Iterator[tuple]:
        """Compact blocks of targets, each with all anchors in compact blocks, and the ends of those."""
        y, place = ordered(_tiles(b[u], b[v], _ANCHORS))
        ends_of = {c: (np.minimum.reduceat(y[c], starts), np.maximum.reduceat(y[c], starts)) for c in (u, v, *more)} if len(starts) else {}
        tiles = _tiles(a[u], a[v], _TARGETS)
        for i in range(0, len(tiles) if ends_of else 0, _TARGETS):
            rows = tiles[i : i + _TARGETS]
            yield rows, {k: w[rows][:, None] for k, w in a.items()}, y, ends_of, same(rows, place)

    runs = lambda kept: list(zip(starts[kept].tolist(), ends[kept].tolist(), strict=True))
    # nan makes a comparison false, so its blocks are neither left out nor counted whole.
    for rows, x, y, of, own in tiled("lx", "hx"):
        apart = (of["lx"][0] - x["lx"].max() > inside + slack) | (x["hx"].min() - of["hx"][1] > inside + slack)
        met("inside", rows, x, y, runs(~apart), holds, *own)
    for rows, x, y, of, (r, p) in tiled("cx", "cy", ("sx", "sy")):
        most, fewest = np.zeros(len(starts)), np.zeros(len(starts))
        for axis in "xy":
            (c0, c1), (s0, s1) = of[f"c{axis}"], of[f"s{axis}"]
            at, wide = x[f"c{axis}"], x[f"s{axis}"]
            most += np.maximum(np.maximum(at.max() - c0, c1 - at.min()) - (wide.min() + s0) / 2, 0) ** 2
            fewest += np.maximum(np.maximum(at.min() - c1, c0 - at.max()) - (wide.max() + s1) / 2, 0) ** 2
        whole, apart = np.sqrt(most) + slack <= near, np.sqrt(fewest) - slack > near
        n[TYPES.index("near"), rows] += (ends - starts)[whole].sum() - np.bincount(r[whole[p // _ANCHORS]], minlength=len(rows))
        met("near", rows, x, y, runs(~whole & ~apart), lambda u, v: _near(u, v, near), r, p)
    return n
