"""Shortest paths, hop levels, components and line-of-sight on small graphs and grids; one graph is one group."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geometry import box_distance
from lodestar.operators.spatial import met_boxes
from lodestar.sources import scratch


def relax(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(source, node, distance): least distances over at most ``rounds`` hops, for many sources at once.

    Every round is one equi-join and one aggregate with map-side combine, so it scales with the edges.
    """
    reached = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"))
    e = edges.select(F.col("src").alias("node"), F.col("dst"), F.col("distance").alias("w"))
    for _ in range(rounds):
        step = reached.join(e, "node").select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        reached = reached.unionByName(step).groupBy("source", "node").agg(F.min("distance").alias("distance"))
    return reached


def _adjacency(pdf: pd.DataFrame) -> dict:
    out: dict = {}
    for s, d, w in zip(pdf["src"], pdf["dst"], pdf["distance"], strict=True):
        out.setdefault(s, {})[d] = w
    return out


def _dijkstra(adjacency: dict, start, goals: set) -> tuple[float, list] | None:
    """Distance and path to the first settled goal, by (distance, node)."""
    heap, seen, back = [(0.0, start, None)], set(), {}
    while heap:
        d, node, before = heapq.heappop(heap)
        if node in seen:
            continue
        seen.add(node)
        back[node] = before
        if node in goals:
            path = [node]
            while back[path[-1]] is not None:
                path.append(back[path[-1]])
            return d, path[::-1]
        for other, w in adjacency.get(node, {}).items():
            if other not in seen:
                heapq.heappush(heap, (d + w, other, node))
    return None


def shortest_routes(questions: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(graph, question_id, distance, path, hops): for questions (graph, question_id, start, goals) the nearest goal's route.

    Unreachable or unknown ends give null.  ``edges``: (graph, src, dst, distance).
    """
    kind = dict(questions.dtypes)[graph]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        adjacency = _adjacency(right)
        nodes = set(adjacency) | {d for v in adjacency.values() for d in v}
        rows = []
        for g, q, start, goals in zip(left[graph], left["question_id"], left["start"], left["goals"], strict=True):
            found = _dijkstra(adjacency, start, set(goals)) if start in nodes else None
            rows.append((g, q, *(found if found else (None, None)), len(found[1]) - 1 if found else None))
        return pd.DataFrame(rows, columns=[graph, "question_id", "distance", "path", "hops"]).astype({"hops": "Int32"})

    return questions.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, question_id long, distance double, path array<bigint>, hops int")


def hop_levels(edges: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """(source, node, hops) of all nodes within so many hops."""
    return relax(edges.withColumn("distance", F.lit(1.0)), sources, rounds).select("source", "node", F.col("distance").cast("int").alias("hops"))


def _settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder of ``spark.checkpoint.dir``; only a local master falls back to a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch.shared(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): least node id of each component, a node without edges its own.

    Alternating star contractions: each round ties a node's larger neighbours to its least one and
    then its smaller ones, so long chains shrink by a factor, not by a hop.  Rounds are checkpointed
    and hold no more edges than there were; a null end of an edge ties nothing.
    """
    e = _settled(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        mutual = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = mutual.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        outer = mutual.filter("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = outer.groupBy("u").agg(F.min("v").alias("m"))
        inner = outer.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = _settled(inner.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def segment_cells(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells of a grid that a straight segment between two cells visits, one for each step along its longer axis."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    return [(x0, y0)] if not n else [(x0 + int(np.floor((x1 - x0) * i / n + 0.5)), y0 + int(np.floor((y1 - y0) * i / n + 0.5))) for i in range(n + 1)]


def clear_segments(segments: DataFrame, occupied: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, key, blocked, clear): cells of each segment that are occupied.

    ``segments``: x0, y0, x1, y1 in cells; ``occupied``: gx, gy.  Cells are generated in SQL and met by an equi-join.
    """
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    walk = segments.select(*group, key, "x0", "y0", "x1", "y1", n.alias("n"), F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("i"))
    at = lambda a, b: (F.col(a) + F.floor((F.col(b) - F.col(a)) * F.col("i") / F.greatest("n", F.lit(1)) + 0.5)).cast("long")
    cells = walk.select(*group, key, at("x0", "x1").alias("gx"), at("y0", "y1").alias("gy")).distinct()
    hit = cells.join(occupied.select(*group, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.lit(1).alias("__o")).distinct(), [*group, "gx", "gy"], "left")
    return hit.groupBy(*group, key).agg(F.count("__o").alias("blocked")).withColumn("clear", F.col("blocked") == 0)


def occupancy(boxes: DataFrame, cells: DataFrame, group: list[str], inflate: float) -> DataFrame:
    """Cells (gx, gy, x, y) with whether any box (cx, cy, sx, sy, yaw), inflated, covers their centre."""
    inside = box_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("sx"), F.col("sy"), F.col("yaw")) <= inflate
    return met_boxes(cells, boxes, group, inflate, "left").groupBy(*group, "gx", "gy").agg(F.max(F.coalesce(inside, F.lit(False))).alias("occupied"))


def _flood(free: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    seen = np.zeros_like(free)
    if not free[start]:
        return seen
    seen[start] = True
    todo = deque([start])
    while todo:
        r, c = todo.popleft()
        for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= a < free.shape[0] and 0 <= b < free.shape[1] and free[a, b] and not seen[a, b]:
                seen[a, b] = True
                todo.append((a, b))
    return seen


def _grid_route(free: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]]:
    """A* over eight neighbours with Euclidean costs."""
    if not (free[start] and free[goal]):
        return []
    estimate = lambda p: float(np.hypot(p[0] - goal[0], p[1] - goal[1]))
    heap, cost, back = [(estimate(start), start)], {start: 0.0}, {}
    done = set()
    while heap:
        _, at = heapq.heappop(heap)
        if at == goal:
            path = [at]
            while path[-1] != start:
                path.append(back[path[-1]])
            return path[::-1]
        if at in done:
            continue
        done.add(at)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                to = (at[0] + dr, at[1] + dc)
                if (dr or dc) and 0 <= to[0] < free.shape[0] and 0 <= to[1] < free.shape[1] and free[to]:
                    c = cost[at] + (2**0.5 if dr and dc else 1.0)
                    if c < cost.get(to, np.inf):
                        cost[to], back[to] = c, at
                        heapq.heappush(heap, (c + estimate(to), to))
    return []


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Keeps the ends and, recursively, the point farthest from the chord where it is beyond the tolerance."""
    if len(points) < 3:
        return list(points)
    (ax, ay), (bx, by) = points[0], points[-1]
    length = np.hypot(bx - ax, by - ay)
    away = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else np.hypot(x - ax, y - ay) for x, y in points[1:-1]]
    k = int(np.argmax(away))
    if away[k] <= tolerance:
        return [points[0], points[-1]]
    return simplify(points[: k + 2], tolerance)[:-1] + simplify(points[k + 1 :], tolerance)


def grid_routes(cells: DataFrame, questions: DataFrame, graph: str) -> DataFrame:
    """(graph, question_id, steps, length, reachable): grid searches between cells; ``cells``: graph, gx, gy, occupied."""
    kind = dict(questions.dtypes)[graph]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(right):
            x0, y0 = right["gx"].min(), right["gy"].min()
            free = np.zeros((right["gx"].max() - x0 + 1, right["gy"].max() - y0 + 1), bool)
            free[right["gx"] - x0, right["gy"] - y0] = ~right["occupied"].to_numpy(bool)
        for r in left.itertuples():
            inside = len(right) and all(0 <= a - x0 < free.shape[0] and 0 <= b - y0 < free.shape[1] for a, b in ((r.sx, r.sy), (r.gx, r.gy)))
            path = _grid_route(free, (r.sx - x0, r.sy - y0), (r.gx - x0, r.gy - y0)) if inside else []
            length = float(sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:], strict=False)))
            reach = int(_flood(free, (r.sx - x0, r.sy - y0)).sum()) if inside else 0
            rows.append((getattr(r, graph), r.question_id, max(len(path) - 1, 0) if path else -1, length, reach))
        return pd.DataFrame(rows, columns=[graph, "question_id", "steps", "length", "reachable"])

    return questions.groupBy(graph).cogroup(cells.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, question_id long, steps int, length double, reachable long")


def _grid(cells: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """Free cells as an array, and the cell of its corner; cells that aren't listed aren't free."""
    x0, y0 = int(cells["gx"].min()), int(cells["gy"].min())
    free = np.zeros((int(cells["gx"].max()) - x0 + 1, int(cells["gy"].max()) - y0 + 1), bool)
    free[cells["gx"] - x0, cells["gy"] - y0] = ~cells["occupied"].to_numpy(bool)
    return free, x0, y0


def _snapped(free: np.ndarray, at: tuple[int, int], reach: int) -> tuple[int, int] | None:
    """The cell, or the first free one of the nearest square ring around it."""
    for r in range(reach + 1):
        for dx in range(-r, r + 1):
            for dy in range(-r, r + 1):
                x, y = at[0] + dx, at[1] + dy
                if max(abs(dx), abs(dy)) == r and 0 <= x < free.shape[0] and 0 <= y < free.shape[1] and free[x, y]:
                    return x, y
    return None


def _straightened(free: np.ndarray, path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From each kept point on to the farthest one that a free straight line reaches; neighbours always do."""
    kept, i = [path[0]], 0
    while i < len(path) - 1:
        j = next(j for j in range(len(path) - 1, i, -1) if j == i + 1 or all(free[c] for c in segment_cells(*path[i], *path[j])))
        kept.append(path[j])
        i = j
    return kept


def _said(path: list[tuple[int, int]], yaw: float, least: float = 15.0) -> list[str]:
    """A turn where the heading changes by at least so many degrees, then the way ahead in cells."""
    out = []
    for a, b in zip(path, path[1:], strict=False):
        heading = np.arctan2(b[1] - a[1], b[0] - a[0])
        change = np.degrees((heading - yaw + np.pi) % (2 * np.pi) - np.pi)
        if abs(change) >= least:
            out.append("left" if change > 0 else "right")
        out.append(f"forward {np.hypot(b[0] - a[0], b[1] - a[1]):.2f}")
        yaw = heading
    return out


def navigation_truth(cells: DataFrame, questions: DataFrame, graph: str, reach: int = 50) -> DataFrame:
    """(graph, question_id, path, length, directions, clearances): the way from a start to a goal on its graph's grid.

    ``cells``: graph, gx, gy, occupied; ``questions``: graph, question_id, sx, sy, tx, ty, yaw.  Ends move to
    the nearest free cell within ``reach`` rings; the way is the shortest over eight neighbours, straightened
    where a line stays free.  A clearance is the distance to the nearest occupied cell, null without one.
    All is null where an end has no free cell or no way leads to the goal.  One grid is one task.
    """
    kind = dict(questions.dtypes)[graph]

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(held):
            free, x0, y0 = _grid(held)
            walls = held[held["occupied"].astype(bool)][["gx", "gy"]].to_numpy(float)
        for q in asked.itertuples():
            ends = [_snapped(free, (int(a) - x0, int(b) - y0), reach) for a, b in ((q.sx, q.sy), (q.tx, q.ty))] if len(held) else [None, None]
            path = _grid_route(free, *ends) if None not in ends else []
            if not path:
                rows.append((getattr(q, graph), q.question_id, None, None, None, None))
                continue
            path = _straightened(free, path)
            placed = [(x + x0, y + y0) for x, y in path]
            near = [float(np.hypot(walls[:, 0] - x, walls[:, 1] - y).min()) if len(walls) else None for x, y in placed]
            length = float(sum(np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(path, path[1:], strict=False)))
            rows.append((getattr(q, graph), q.question_id, [{"x": int(x), "y": int(y)} for x, y in placed], length, _said(path, float(q.yaw)), near))
        return pd.DataFrame(rows, columns=[graph, "question_id", "path", "length", "directions", "clearances"])

    return questions.groupBy(graph).cogroup(cells.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, question_id long, path array<struct<x:long,y:long>>, length double, directions array<string>, clearances array<double>")


def refined(points: list[tuple[int, int]], keep: list[int], blocked: set[tuple[int, int]], pad: int) -> list[int]:
    """Indices of a drawn path: between kept ones on to the farthest whose straight line, widened by ``pad``, meets no blocked pixel; none if there is no way."""
    hits = lambda a, b: any((x + i, y + j) in blocked for x, y in segment_cells(*a, *b) for i in range(-pad, pad + 1) for j in range(-pad, pad + 1))
    out = keep[:1]
    for end in keep[1:]:
        while out[-1] < end:
            at = out[-1]
            to = next((j for j in range(end, at, -1) if not hits(points[at], points[j])), None)
            if to is None:
                return []
            out.append(to)
    return out


def drawn_paths(paths: DataFrame, masks: DataFrame, group: list[str], key: str, pad: int = 2) -> DataFrame:
    """(group, key, ids): paths as they can be drawn in an image without crossing its blocked pixels; empty if impossible.

    ``paths``: group, key, nodes (array of id, px, py; null pixels aren't seen); ``masks``: group, px, py of
    blocked pixels.  Unseen ids and immediate repeats go first.  One image is one task.
    """
    kinds = dict(paths.dtypes)

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        blocked = set(zip(held["px"].astype(int), held["py"].astype(int), strict=True))
        rows = []
        for at, nodes in zip(asked[[*group, key]].itertuples(index=False), asked["nodes"], strict=True):
            seen = [n for n in (nodes if nodes is not None else ()) if n["px"] is not None and n["py"] is not None]
            seen = [n for i, n in enumerate(seen) if not i or n["id"] != seen[i - 1]["id"]]
            points = [(int(n["px"]), int(n["py"])) for n in seen]
            found = refined(points, [0, len(points) - 1], blocked, pad) if len(points) > 1 else list(range(len(points)))
            rows.append((*at, [int(seen[i]["id"]) for i in found]))
        return pd.DataFrame(rows, columns=[*group, key, "ids"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*group, key)) + ", ids array<bigint>"
    return paths.groupBy(*group).cogroup(masks.groupBy(*group)).applyInPandas(run, schema)


def distance_field(cells: DataFrame, group: list[str], radius: int) -> DataFrame:
    """Each free cell's distance to the nearest occupied one, up to a radius in cells; null beyond."""
    ring = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(np.hypot(i, j))).alias("d")) for i, j in ring]))
    around = cells.filter("occupied").select(*group, "gx", "gy", offsets.alias("o")).select(*group, (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"), F.col("o.d").alias("d"))
    near = around.groupBy(*group, "gx", "gy").agg(F.min("d").alias("clearance"))
    return cells.filter("NOT occupied").join(near, [*group, "gx", "gy"], "left")


def reference_checks(routes: DataFrame, edges: DataFrame, keys: list[str], goals: str = "goals", path: str = "path") -> DataFrame:
    """(keys, hops, legal_hops, length, ends_in_goal, status) of reference paths: every hop an edge, the end among the goals.

    The length is null unless the whole path is legal.
    """
    from lodestar.operators.joins import route_edges

    per = route_edges(routes, edges, keys, path)
    ends = routes.select(*keys, F.coalesce(F.array_contains(F.col(goals), F.element_at(path, -1)), F.lit(False)).alias("ends_in_goal"))
    x = ends.join(per, keys, "left").withColumns({"hops": F.coalesce("hops", F.lit(0)), "legal_hops": F.coalesce("legal_hops", F.lit(0))})
    legal = (F.col("hops") > 0) & (F.col("hops") == F.col("legal_hops"))
    status = F.when(F.col("hops") == 0, F.lit("no_hops")).when(~legal, F.lit("illegal_edge")).when(~F.col("ends_in_goal"), F.lit("wrong_end")).otherwise(F.lit("ok"))
    return x.select(*keys, "hops", "legal_hops", F.when(legal, F.col("length")).alias("length"), "ends_in_goal", status.alias("status"))


def edge_status(hops, legal_hops, has_pairs):
    """Status of a route's edges; without a table of pairs a sparse route passes."""
    return F.when(hops == 0, F.lit("no_hops")).when(~has_pairs, F.lit("ok_sparse")).when(hops == legal_hops, F.lit("ok")).otherwise(F.lit("illegal_edge"))


def calibrate(df: DataFrame, group: str) -> DataFrame:
    """(group, points, h, depth_plane, residual_median, residual_p90): a ground-to-image homography and a plane for inverse depth.

    ``df`` has x, y on the ground, px, py in the image and depth; one view is one group.  Fewer than
    four points give no fit.
    """
    kind = dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, u, v, d = (pdf[c].to_numpy(float) for c in ("x", "y", "px", "py", "depth"))
        n = len(pdf)
        if n < 4:
            return pd.DataFrame([(pdf[group].iloc[0], n, None, None, None, None)], columns=names)
        one, zero = np.ones(n), np.zeros(n)
        rows = np.r_[np.c_[x, y, one, zero, zero, zero, -u * x, -u * y], np.c_[zero, zero, zero, x, y, one, -v * x, -v * y]]
        h = np.append(np.linalg.lstsq(rows, np.r_[u, v], rcond=None)[0], 1.0)
        w = h[6] * x + h[7] * y + 1
        off = np.hypot((h[0] * x + h[1] * y + h[2]) / w - u, (h[3] * x + h[4] * y + h[5]) / w - v)
        plane = np.linalg.lstsq(np.c_[x, y, one], 1 / np.maximum(d, 1e-6), rcond=None)[0]
        return pd.DataFrame([(pdf[group].iloc[0], n, h.tolist(), plane.tolist(), float(np.median(off)), float(np.quantile(off, 0.9)))], columns=names)

    names = [group, "points", "h", "depth_plane", "residual_median", "residual_p90"]
    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, points int, h array<double>, depth_plane array<double>, residual_median double, residual_p90 double")
