"""Queries over pairs that make no row of each pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import spatial


def _rows_made(df) -> int:
    """The most rows that a node of the plan has made; the query must have run."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name, rows = node.nodeName(), node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def _boxes(spark):
    import random

    pick = random.Random(7)
    some = lambda low, high: pick.uniform(low, high)
    rows = [(v, i, some(-3, 3), some(-3, 3), some(-0.6, 0.6), some(0.05, 1.2), some(0.05, 1.2), some(0.05, 0.8)) for v in (0, 1) for i in range(150)]
    rows += [(0, 7, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 7, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 8, float("nan"), 0.0, 0.0, 1.0, 1.0, 1.0)]
    odd = lambda i: (1, 900 + i, *[None if k == i else 0.4 for k in range(6)])
    rows += [odd(i) for i in range(6)] + [(1, None, *[0.4] * 6), (None, 1, *[0.4] * 6), (None, 2, *[0.4] * 6)]
    return spark.createDataFrame(rows, "g int, id long, cx double, cy double, cz double, sx double, sy double, sz double")


def test_projected_counts_are_those_of_the_relations(spark, monkeypatch):
    objects = _boxes(spark)
    ids = objects.select("g", "id")
    marks = ids.filter("id % 7 <> 0"), ids.filter("id % 5 = 0")
    each = spatial.project_relations(spatial.relations(objects, ["g"], "id"), *marks, ["g"])
    want = {tuple(r) for r in each.groupBy("g", "target", "type", "reason").count().collect()}
    assert {r[2] for r in want} == {"near", "on", "inside", "under"} and len({r[3] for r in want}) == 4
    for targets, anchors in ((8192, 131_072), (16, 32)):  # whole cells, and cells in parts
        monkeypatch.setattr(spatial, "TARGETS", targets)
        monkeypatch.setattr(spatial, "ANCHORS", anchors)
        found = spatial.projected_counts(objects, *marks, ["g"], "id").groupBy("g", "target", "type", "reason").agg(F.sum("n").alias("n"))
        assert {tuple(r) for r in found.collect()} == want


def test_relation_projection_shuffles_no_pairs(spark, tmp_path):
    from lodestar.plans import spaces

    # 600 boxes in one place have 359,400 pairs; a shuffle or join of them would carry as many rows.
    spark.range(600).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(0.2 + id * 1e-6)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = spaces.relation_projection(spark, str(tmp_path))
    assert sum(r.n for r in df.collect() if r.type == "near") == 600 * 599
    assert 600 <= _rows_made(df) < 20_000


def test_relations_theta_makes_no_row_for_a_pair(spark, tmp_path):
    from lodestar.plans import spaces

    spark.range(600).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(0.2 + id * 1e-6)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = spaces.relations_theta(spark, str(tmp_path))
    assert {r.type: (r.n, r.targets) for r in df.collect()}["near"] == (600 * 599, 600)
    assert 600 <= _rows_made(df) < 20_000


def _snapped(hops, nodes, step, reach):
    """By all pairs, in Python."""
    import math

    want = {}
    for g, k, hop, x0, y0, x1, y1 in sorted(hops):
        n = max(math.ceil(math.hypot(x1 - x0, y1 - y0) / step), 1)
        for i in range(n + 1):
            px, py = x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n
            d = [(math.sqrt((px - x) * (px - x) + (py - y) * (py - y)), node) for h, node, x, y in nodes if h == g and node is not None]
            near = [(round(v, 9), node) for v, node in d if v <= reach]
            if near:
                want.setdefault((g, k), []).append(min(near)[1])
    return {k: [v for i, v in enumerate(ids) if not i or v != ids[i - 1]] for k, ids in want.items()}


def test_snapped_paths_are_those_of_all_pairs(spark, monkeypatch):
    import random

    pick = random.Random(3)
    at = lambda: round(pick.gauss(0, 0.3), 3)
    nodes = [(g, i, at(), at()) for g in (0, 1) for i in range(300)]
    nodes += [(0, 1000 - i, 0.5, 0.5) for i in range(20)]  # copies: the least id
    nodes += [(0, 2001, 2.0, 2.0), (0, 2000, 2.0, 2.0 + 1e-11), (0, None, 0.0, 0.0), (2, 1, 0.0, 0.0)]  # equal to nine decimals; no id; no path
    hops = [(g, k, h, 0.0, 0.0, at(), at()) for g in (0, 1) for k in range(60) for h in (0, 1)] + [(0, 99, 0, 1.9, 2.0, 2.1, 2.0), (3, 1, 0, 0.0, 0.0, 1.0, 1.0)]
    want = _snapped(hops, nodes, 0.05, 0.06)
    assert want[0, 99] == [2000]
    args = spark.createDataFrame(hops, "g int, k int, hop int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(nodes, "g int, id long, x double, y double")
    for samples in (65_536, 7):  # whole tiles, and tiles in parts
        monkeypatch.setattr(spatial, "SAMPLES", samples)
        found = spatial.snapped_paths(*args, ["g"], "k", "id", 0.05, 0.06)
        assert {(r.g, r.k): r.ids for r in found.collect()} == want


def test_snapped_paths_keep_ids_of_any_type(spark):
    hops = spark.createDataFrame([("v", None, 0, 0.0, 0.0, 1.0, 0.0), ("v", 2**60 + 1, 0, 0.0, 0.0, 1.0, 0.0)], "g string, k long, hop int, x0 double, y0 double, x1 double, y1 double")
    nodes = spark.createDataFrame([("v", "b", 0.0, 0.0), ("v", "a", 1.0, 0.0), ("v", "c", 1.0, 0.0)], "g string, id string, x double, y double")
    assert {r.k: r.ids for r in spatial.snapped_paths(hops, nodes, ["g"], "k", "id", 0.25, 0.3).collect()} == {None: ["b", "a"], 2**60 + 1: ["b", "a"]}


def test_snapped_paths_make_no_row_for_a_pair(spark, tmp_path):
    from lodestar.plans import files

    spark.range(600).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> float(0.02 + id * 1e-6)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = files.snapped_paths(spark, str(tmp_path))
    assert {r.ids.split(",")[0] for r in df.collect()} == {"0"}
    assert 600 <= _rows_made(df) < 20_000
