from __future__ import annotations

import heapq
import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, release, selection, statistics

CELLS = "g int, gx long, gy long, occupied boolean"


def grid(spark, rows):
    """Rows of text from y = 0 on; ``#`` is occupied."""
    return spark.createDataFrame([(0, x, y, c == "#") for y, row in enumerate(rows) for x, c in enumerate(row)], CELLS)


def least(rows, start, goal):
    """Least cost over eight neighbours, by a plain search."""
    best, heap = {}, [(0.0, start)]
    while heap:
        d, (x, y) = heapq.heappop(heap)
        if (x, y) in best:
            continue
        best[x, y] = d
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                a, b = x + i, y + j
                if (i or j) and 0 <= b < len(rows) and 0 <= a < len(rows[0]) and rows[b][a] != "#":
                    heapq.heappush(heap, (d + math.hypot(i, j), (a, b)))
    return best.get(goal)


def test_navigation_truth(spark):
    rows = ["....#...", "....#...", "....#...", "........", "########", "........"]
    asked = [(0, 1, 0, 0, 7, 0, 0.0), (0, 2, 4, 1, 4, 3, 0.0), (0, 3, 0, 0, 7, 5, 0.0), (1, 4, 0, 0, 1, 1, 0.0)]
    q = spark.createDataFrame(asked, "g int, question_id long, sx long, sy long, tx long, ty long, yaw double")
    got = {r.question_id: r for r in graph.navigation_truth(grid(spark, rows), q, "g").collect()}
    path = [(p.x, p.y) for p in got[1].path]
    assert path[0] == (0, 0) and path[-1] == (7, 0)
    for a, b in zip(path, path[1:], strict=False):
        assert all(rows[y][x] != "#" for x, y in graph.segment_cells(*a, *b))
    assert math.hypot(7, 0) < got[1].length <= least(rows, (0, 0), (7, 0)) + 1e-9
    assert got[1].directions[0] == "left" and got[1].directions[1].startswith("forward ") and len(got[1].clearances) == len(path)
    occupied = [(x, y) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"]
    assert got[1].clearances == pytest.approx([min(math.hypot(x - a, y - b) for a, b in occupied) for x, y in path])
    assert rows[got[2].path[0].y][got[2].path[0].x] == "."  # the start was in a wall and moved off it
    assert got[3].path is None and got[3].length is None and got[4].path is None


def test_drawn_paths_avoid_the_mask(spark):
    assert graph.refined([(0, 0), (5, 5), (10, 0)], [0, 2], set(), 0) == [0, 2]
    assert graph.refined([(0, 0), (5, 5), (10, 0)], [0, 2], {(5, 0)}, 0) == [0, 1, 2]
    assert graph.refined([(0, 0), (10, 0)], [0, 1], {(5, 1)}, 1) == []
    node = lambda i, x, y: {"id": i, "px": x, "py": y}
    rows = [(0, 1, [node(7, 0, 0), node(7, 0, 0), node(8, None, 3), node(9, 5, 5), node(4, 10, 0)]), (0, 2, [node(1, None, None)]), (1, 3, [node(1, 0, 0), node(2, 9, 9)])]
    paths = spark.createDataFrame(rows, "g int, k int, nodes array<struct<id:bigint,px:int,py:int>>")
    masks = spark.createDataFrame([(0, 5, 0)], "g int, px int, py int")
    assert {r.k: r.ids for r in graph.drawn_paths(paths, masks, ["g"], "k", 0).collect()} == {1: [7, 9, 4], 2: [], 3: [1, 2]}


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (7, 7)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 1000, 1001, 5000]], "node long")
    got = {r.node: r.component for r in graph.components(edges, nodes).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000, 5000: 5000}
    none = graph.components(edges.limit(0), nodes)
    assert all(r.node == r.component for r in none.collect())


def test_ineligible_views_and_missing_approvals_are_errors(spark):
    views = spark.createDataFrame([(1, True), (2, False)], "view long, ok boolean")
    routes = spark.createDataFrame([(1, 5)], "view long, route long")
    rows = release.typed_rows(views.filter("ok"), routes, ["view"], "route", F.col("ok"))
    assert {r.question_id for r in rows.collect()} == {"a1-1", "b1-1", "a2-1-5", "b2-1-5", "c-1-5"}
    with pytest.raises(Exception, match="view is eligible"):
        release.typed_rows(views, routes, ["view"], "route", F.col("ok")).collect()
    asked = spark.createDataFrame([(1, True), (2, False)], "k long, u boolean")
    record = lambda *r: spark.createDataFrame(list(r), "k long, status string, resolution string")
    assert release.adjudicated(asked, record((1, "approved", "unique")), "k", F.col("u")).count() == 2
    for bad, message in (([(1, "approved", "ambiguous")], "approved as unique"), ([(1, "approved", "unique")] * 2, "unique"), ([(1, "approved", " ")], "filled"), ([(9, "approved", "unique")], "approved as unique")):
        with pytest.raises(Exception, match=message):
            release.adjudicated(asked, record(*bad), "k", F.col("u")).collect()


def test_paired_removal_and_refresh(spark):
    rows = spark.createDataFrame([(1, "a2", False), (1, "b2", True), (1, "c", True), (2, "a2", False), (2, "b2", False), (3, "a2", None)], "unit long, task string, bad boolean")
    kept = release.paired_removal(rows, ["unit"], "task", ["a2", "b2"], F.col("bad"))
    assert sorted((r.unit, r.task) for r in kept.collect()) == [(1, "c"), (2, "a2"), (2, "b2")]
    old, new = (spark.createDataFrame(x, "run string, rate double") for x in ([("a", 0.5), ("b", 0.25)], [("a", 0.75)]))
    assert sorted(tuple(r) for r in release.refreshed(old, new, ["run"], ["rate"]).collect()) == [("a", 0.75, 0.25), ("b", 0.25, 0.0)]


def test_paired_bootstrap_brackets_the_difference(spark):
    rows = [(i // 50, i % 3 == 0, i % 2 == 0) for i in range(2000)]
    df = spark.createDataFrame([(0, c, int(a), int(b)) for c, a, b in rows], "g int, cluster int, before int, after int")
    low, high = statistics.paired_bootstrap(df, ["g"], "cluster", "before", "after", 400, 3).select("low", "high").first()
    delta = sum(b - a for _, a, b in rows) / len(rows)
    assert low < delta < high and high - low < 0.2
    same = statistics.paired_bootstrap(df.withColumn("after", F.col("before")), ["g"], "cluster", "before", "after", 50, 3).select("low", "high").first()
    assert tuple(same) == (0.0, 0.0)


def test_thinning_matches_a_plain_loop(spark):
    rows = [(0, i, (i * 37 % 100) / 100, (i * 61 % 100) / 100) for i in range(150)]
    kept = []
    for _, i, x, y in rows:
        if all((x - a) ** 2 + (y - b) ** 2 >= 0.15**2 for _, a, b in kept):
            kept.append((i, x, y))
    got = selection.thin(spark.createDataFrame(rows, "g int, i int, x double, y double"), ["g"], ["i"], "x", "y", 0.15)
    assert sorted(r.i for r in got.collect()) == [k[0] for k in kept]


def test_greedy_selection_matches_a_plain_loop(spark):
    sizes = {i: (i * 17) % 23 + 1 for i in range(20)}
    value = lambda s: -abs(60 - s) + (10_000 if 55 <= s <= 66 else 0) - 200 * max(0, s - 66)
    chosen, total, left = [], 0, dict(sizes)
    while left and len(chosen) < 8:
        gain, best = max((value(total + n) - value(total), i) for i, n in left.items())
        if gain <= 0:
            break
        total += left.pop(best)
        chosen.append(best)
    df = spark.createDataFrame([(0, i, n) for i, n in sizes.items()], "g int, i int, n int")
    got = selection.greedy(df, ["g"], "i", selection.window_objective("n", 60, 55, 66), 8)
    assert [r.i for r in got.orderBy("place").collect()] == chosen


def test_objectives_of_greedy_choices(spark):
    rows = [(0, 1, 1.0, ["a", "b"], 1.0, 0.0, 0.0), (0, 2, 1.0, ["a", "b"], 1.0, 9.0, 0.0), (0, 3, 0.5, ["c"], 0.5, 0.1, 0.0), (0, 4, 0.1, ["a"], 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, i int, score double, items array<string>, clearance double, x double, y double")
    order = lambda objective, n, **kw: [r.i for r in selection.greedy(df, ["g"], "i", objective, n, **kw).orderBy("place").collect()]
    assert order(selection.diversity_objective("score", "items", 2.0, 3.0), 2) == [2, 3]
    assert order(selection.diversity_objective("score", "items", 2.0, 3.0), 2, least_wins=True) == [1, 3]
    # Camera 3 is new but close to camera 1 and short of clearance; camera 2 shows nothing new from afar.
    assert order(selection.camera_objective("items", "score", 1.0, "clearance", "x", "y", 1.0), 2, least_wins=True) == [1, 2]
    counts = spark.createDataFrame([(0, 1, 3, 0), (0, 2, 1, 5), (0, 3, 2, 1), (0, 4, 0, 2)], "g int, i int, a int, b int")
    got = selection.greedy(counts, ["g"], "i", selection.deficit_objective(["a", "b"], [4, 3], 0.5), 4).orderBy("place").collect()
    assert [r.i for r in got] == [1, 3, 4] and [r.gain for r in got] == [3.0, 0.5, 2.0]


def test_cached_sidecars_are_built_once(spark, tmp_path):
    from lodestar.sources import writers

    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "x"), (2, "y")], "view int, v string")

    for _ in range(3):
        assert writers.cached(spark, f"{tmp_path}/side", build, ["view"], "v string, view int").count() == 2
    assert len(calls) == 1
    none = lambda: build().limit(0)
    assert writers.cached(spark, f"{tmp_path}/none", none, ["view"], "v string, view int").columns == ["v", "view"]


def test_snapped_paths_of_several_hops(spark):
    hops = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 1.0, 0.0), (0, 1, 1, 1.0, 0.0, 1.0, 1.0), (0, 2, 0, 5.0, 5.0, 6.0, 5.0)], "g int, k int, hop int, x0 double, y0 double, x1 double, y1 double")
    from lodestar.operators import spatial

    nodes = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 1.0, 1.0), (0, 4, 1.0, 0.0)], "g int, id int, x double, y double")
    assert {r.k: r.ids for r in spatial.snapped_paths(hops, nodes, ["g"], "k", "id", 0.25, 0.6).collect()} == {1: [1, 2, 3]}
