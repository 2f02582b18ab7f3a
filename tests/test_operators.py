from __future__ import annotations

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar.functions import geometry, ladders, nested, parse, stats, text
from lodestar.operators import contracts, graph, joins, mining, ranking, scoring, selection, sets, spatial, statistics


def one(spark, column, **values):
    names, data = list(values), [tuple(values.values())]
    return spark.createDataFrame(data, ", ".join(f"{n} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<bigint>' if isinstance(v, list) else 'string'}" for n, v in values.items())).select(column.alias("x")).first().x if names else spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, ids", [("[1, 2]", [1, 2]), ("```json\n[3]\n```", [3]), ('["4", 2.7, true]', [4, 2, 1]), ("[]", []), ('["a"]', None), ("{}", None), ("7", None), ("", None), (None, None), ("[[1]]", None), ("[99999999999]", [99999999999])])
def test_id_lists(spark, raw, ids):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(parse.id_list(F.col("t")).alias("x")).first().x == ids


def test_functions_travel_by_value(tmp_path):
    """A Python that doesn't have the package runs the functions that executors get."""
    route = lambda: graph._dijkstra({1: {2: 1.0}}, 1, {2})
    (tmp_path / "f").write_bytes(cloudpickle.dumps((nested._ids, route, graph._adjacency)))
    program = "import sys, pickle\nf = pickle.load(open('f', 'rb'))\nassert f[1]() == (1.0, [1, 2]) and 'lodestar' not in sys.modules"
    subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env={}, check=True)


def test_cells_come_from_one_partition(spark):
    rows = spark.createDataFrame([("low", "high"), ("low", "high"), ("high", "low"), (None, "low")], "a string, b string")
    table = mining.cell_table(rows, ["a", "b"], ["low", "high"])
    assert sorted(map(tuple, table.collect())) == [("high", "high", 0), ("high", "low", 1), ("low", "high", 2), ("low", "low", 0)]
    assert "CartesianProduct" not in table._jdf.queryExecution().executedPlan().toString()


def test_long_lines_are_read_once(spark):
    """Two megabytes on one line before the last, and as much white space within: a quadratic pattern wouldn't end."""
    long = "a" * 2_000_000 + " " * 200_000 + "b\n[1]\x0b \n"
    assert one(spark, text.format_class(F.col("t")), t=long) == "plain_plus_tail"


def test_other_answers(spark):
    t = F.col("t")
    assert one(spark, parse.first_list(t), t="<think>[9]</think> take [4, 5] or [6]") == [4, 5]
    assert one(spark, parse.last_list(t), t="first [1]\nthen [2, 3]  ") == [2, 3]
    assert one(spark, parse.strict_id_list(t), t="[1, 2.5]") is None
    assert one(spark, parse.coordinate_path(t), t="go [1, 2.5] then [3,4,-1]") == [[1.0, 2.5, 0.0], [3.0, 4.0, -1.0]]
    assert [one(spark, parse.option_letter(t), t=x) for x in ("B", "(c)", "A or B", "<think>A", "x" * 200, "2", "the answer: D.")] == ["B", "C", "", "", "", "B", "D"]
    assert one(spark, parse.choice_lines(t), t="A. left\n\nB) right") == ["left", "right"]
    assert one(spark, parse.finite_number(t), t="3.50. metres") == 3.5 and one(spark, parse.finite_number(t), t="nan") is None
    assert one(spark, parse.normalized(t), t="  ") is None and one(spark, parse.slug(t), t=" a b/c! ") == "a_b_c"
    assert one(spark, parse.json_object(t).isNull(), t="[1]") and not one(spark, parse.json_object(t).isNull(), t='so: {"a": 1} ok')
    assert one(spark, parse.prediction_ids(t, F.lit(False)), t="[1]") is None
    assert one(spark, parse.ids_within(F.col("a"), F.col("b")), a=[1, 2], b=[1, 2, 3])


def test_texts(spark):
    t = F.col("t")
    assert [one(spark, text.format_class(t), t=x) for x in ("<think>a</think>\n[1]", "a\n[1] ", "<think>a", "<think>a [1]</think> b", "a [1]", "b <think>a</think>", "")] == ["ok", "plain_plus_tail", "open_no_close", "json_inside_or_missing_tail", "plain_no_tail", "other", "plain_no_tail"]
    assert one(spark, text.in_order(t, [["first", "one"], ["then"]]), t="One step, then") and not one(spark, text.in_order(t, [["then"], ["first"]]), t="first, then")
    assert one(spark, text.mentions_all(t, F.col("a")), t="ids 1 through 3", a=[1, 2, 3]) and one(spark, text.mentions_all(t, F.col("a")), t="[4, 7]", a=[4, 7]) and not one(spark, text.mentions_all(t, F.col("a")), t="1 through 2", a=[4, 7])
    assert one(spark, text.canonical_rationale(t, F.col("a")), t="because\n[1,2]", a=[1, 2]) == "<think>\nbecause\n</think>\n[1,2]" and one(spark, text.canonical_rationale(t, F.col("a")), t="no [3]", a=[1]) is None
    assert one(spark, text.rationale_issues(t, ["oops"]), t="Oops ``` ") == ["no_open_tag", "no_close_tag", "fenced", "banned_phrase", "no_final_list"]
    assert one(spark, text.leaks_answer(t, F.lit("chair"), F.lit("red")), t="see the chairs") and not one(spark, text.leaks_answer(t, F.lit("chair"), F.lit("red")), t="an armchair")
    assert [one(spark, text.color_claim(t, F.lit("red"), F.lit("blue"), ["red", "blue"]), t=x) for x in ("the red one", "the blue one", "that one")] == ["supported", "contradicted", "no_claim"]
    assert one(spark, text.append_cue(t, F.lit("on the left")), t="Go there?") == "Go there on the left?"
    assert one(spark, text.fill_template(t, ["to {x}"], x=F.lit("door")), t="q") == "to door"


def test_route_gates(spark):
    """Three points in a row, edges 1-2 and 2-3."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, distance double")
    answers = [("a", [1, 2, 3]), ("b", [1, 3]), ("c", [2, 3]), ("d", [1, 2]), ("e", [1, 9]), ("f", []), ("g", None), ("h", [1]), ("i", [1, 2, 1, 2, 3])]
    q = spark.createDataFrame([(k, p, [1, 2, 3], 1, [3], 2.0) for k, p in answers], "question_id string, path array<bigint>, visible array<bigint>, start long, goals array<bigint>, optimal double")
    walked = joins.route_edges(q, edges, ["question_id"])
    flagged = scoring.route_flags(q.join(walked, "question_id", "left")).withColumn("stage", scoring.failure_stage())
    got = {r.question_id: (r.stage, r.spl_part) for r in flagged.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "shortest", "b": "illegal_edge", "c": "wrong_start", "d": "wrong_goal", "e": "invalid_id", "f": "format", "g": "format", "h": "wrong_start", "i": "non_shortest"}
    assert got["a"][1] == 1.0 and got["i"][1] == 0.5
    m = scoring.route_metrics(flagged.withColumn("run", F.lit("r")), ["run"]).first()
    assert (m.questions, m.success_rate, m.spl, m.spl_all) == (9, 0.2222, 0.75, 0.1667)
    loose = scoring.route_flags(q.join(walked, "question_id", "left"), strict=False)
    assert {r.question_id: r.anchored for r in loose.collect()}["h"]


def test_set_counts(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [2, 3, 9], [2, 2, 4, 7]), ([1, 2], [1], None)], "u array<bigint>, t array<bigint>, p array<bigint>")
    rows = df.select(*[v.alias(k) for k, v in scoring.set_counts(F.col("u"), F.col("t"), F.col("p")).items()]).collect()
    assert rows[0].asDict() == {"invalid": 1, "tp": 1, "fp": 1, "fn": 2, "tn": 1}
    assert rows[1].asDict() == {"invalid": 0, "tp": 0, "fp": 0, "fn": 1, "tn": 1}
    assert scoring.set_metrics(df.select(F.lit(1).alias("k"), *[v.alias(k) for k, v in scoring.set_counts(F.col("u"), F.col("t"), F.col("p")).items()]), ["k"]).first().recall == 0.25


def test_composite(spark):
    assert one(spark, scoring.composite([F.lit(0.5), F.lit(0.5)], [F.lit(0.0)] * 3)) == 0 and one(spark, scoring.composite([F.lit(1.0), F.lit(1.0)], [F.lit(1.0)] * 3)) == 1


def test_prefixes(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([3, 1],)], "p array<bigint>")
    pairs = F.array(F.struct(F.lit(1).cast("long").alias("src"), F.lit(2).cast("long").alias("dst")))
    rows = df.select(*[v.alias(k) for k, v in scoring.prefix_flags(F.col("p"), pairs).items()]).collect()
    assert [tuple(r) for r in rows] == [(True, True, False, True), (False, False, False, False), (True, False, False, False)]


def test_joins(spark):
    pos = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k long, v string, p int")
    assert {(r.k, r.v) for r in joins.last_wins(pos, ["k"], F.col("p")).collect()} == {(1, "b"), (2, "c")}
    left = spark.createDataFrame([(1, None, 0), (2, "x", None), (3, None, None)], "k long, v string, w int")
    right = spark.createDataFrame([(1, "f", 9), (2, "g", 8)], "k long, v string, w int")
    assert {tuple(r) for r in joins.null_fill(left, right, ["k"], ["v", "w"]).collect()} == {(1, "f", 0), (2, "x", 8), (3, None, None)}
    a, b = spark.createDataFrame([(0, 1, 0.0, 0.0)], "g int, id int, x double, y double"), spark.createDataFrame([(0, 5, 3.0, 4.0), (0, 4, 4.0, 3.0), (0, 6, 9.0, 9.0), (0, 8, None, 0.0), (1, 7, 0.0, 0.0)], "g int, t int, u double, w double")
    best = joins.nearest(a, b, ["g"], F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("w")), "id", "t").first()
    assert (best.t, best.metric) == (4, 5.0)


@pytest.mark.parametrize("dimensions", [1, 2, 3])
@pytest.mark.parametrize("apart", [False, True])
def test_closest_against_all_pairs(spark, dimensions, apart):
    """Clusters of very different scale, a line, single places, ties, repeated rows, nulls and non-finite values."""
    draw = np.random.default_rng(dimensions)
    made = [draw.normal(0, 1, (60, 3)), draw.normal(50, 1e-4, (60, 3)), draw.uniform(-1e4, 1e4, (30, 3)), np.round(draw.uniform(0, 3, (40, 3))), [[7.0, 7.0, 7.0]]]
    rows = [(g, *map(float, v)) for g, part in enumerate([np.vstack(made[:3]), made[3], made[4]]) for v in part]
    rows = [(i, *r) for i, r in enumerate(rows + rows[:5])]
    odd = [(900, 0, None, 1.0, 1.0), (901, 0, float("nan"), 1.0, 1.0), (902, 1, float("inf"), 1.0, 1.0), (903, 9, 1.0, 1.0, 1.0)]
    names = ["x", "y", "z"][:dimensions]
    df = spark.createDataFrame(rows + odd, "id long, g int, x double, y double, z double")
    points, targets = (df, df) if apart else (df.filter("id % 3 <> 0"), df.filter("id % 3 = 0 AND g < 9"))
    of = lambda r: (r[1], r[2 : 2 + dimensions])
    left, right = (rows, rows) if apart else ([r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3])
    expected = {}
    for p in left:
        g, at = of(p)
        found = [(float(np.sqrt(np.sum((np.array(at) - np.array(of(t)[1])) ** 2))), t[0]) for t in right if t[1] == g and not (apart and of(t)[1] == at)]
        if found:
            expected[(g, *at)] = (round(min(found)[0], 9), min(found)[1])
    result = joins.closest(points, targets, ["g"], names, "id", apart).collect()
    assert {(r.g, *[r[n] for n in names]): (round(r.distance, 9), r.id) for r in result} == expected and len(result) == len(expected)


def test_far_points_meet_no_box(spark):
    boxes = spark.createDataFrame([(0, 7, 0.0, 0.0, 1.0, 1.0, 0.0)], "g int, b int, cx double, cy double, sx double, sy double, yaw double")
    at = spark.createDataFrame([(0, 1, 0.2, 0.0), (0, 2, 90.0, 0.0), (0, 3, None, 0.0), (0, 4, -50.0, 9.0)], "g int, id int, x double, y double")
    assert spatial.box_collisions(at, boxes, ["g"], "id", 0.1).first().collision_rate == 0.25
    assert spatial.box_collisions(at, boxes, ["g"], "id", 0.1, "b").first().collision_rate == 0.25
    grid = spark.createDataFrame([(0, 0, 0, 0.2, 0.0), (1, 0, 0, 0.2, 0.0)], "g int, gx long, gy long, x double, y double")
    assert sorted((r.g, r.occupied) for r in graph.occupancy(boxes, grid, ["g"], 0.1).collect()) == [(0, True), (1, False)]
    unknown = geometry.box_distance(*[F.lit(v) for v in (0.0, 0.0)], F.lit(None).cast("double"), *[F.lit(v) for v in (0.0, 1.0, 1.0, 0.0)])
    assert one(spark, unknown, t="") is None


def test_unknown_anchor_distance_is_no_start(spark):
    df = spark.createDataFrame([(0, 1, None, 0.0, 0.0, None), (0, 2, 0.3, 0.0, 0.0, None), (0, 3, 0.2, 0.0, 0.0, 1.0), (1, 4, 0.9, 0.0, 0.0, 1.0)], "g int, id int, anchor_distance double, screen_x double, screen_y double, depth double")
    assert list(map(tuple, ranking.start_anchor(df, ["g"], "id", 0.5).collect())) == [(0, 3, 0.2)]


def test_neighbours_on_one_place(spark):
    df = spark.createDataFrame([(0, 1, 2.0, 2.0), (0, 2, 2.0, 2.0), (0, 3, 5.0, 6.0), (1, 4, 0.0, 0.0), (2, 5, 1.0, 1.0), (2, 6, 1.0, 1.0)], "g int, id int, x double, y double")
    assert sorted(map(tuple, spatial.nearest_neighbours(df, ["g"], "id", ["x", "y"]).collect())) == [(0, 1, 0.0), (0, 2, 0.0), (0, 3, 5.0), (2, 5, 0.0), (2, 6, 0.0)]
    assert spatial.nearest_neighbours(df.limit(0), ["g"], "id", ["x", "y"]).count() == 0


def test_ladders(spark):
    assert one(spark, ladders.compose_tier(F.lit("low"), F.lit("medium"), F.lit("low"))) == "medium" and one(spark, ladders.compose_tier(F.lit("low"), F.lit("high"))) == "hard"
    assert one(spark, ladders.geometry_axis(F.lit(4.0), F.lit(1.1), F.lit(1), F.lit(0))) == "high" and one(spark, ladders.geometry_axis(F.lit(4.0), F.lit(1.1), F.lit(1), F.lit(0), "v1")) == "medium"
    assert one(spark, ladders.legality(F.lit("supported"), F.lit("unique"), F.lit("ok"), F.lit(True))) == "illegal"
    assert [one(spark, ladders.color_name(*map(F.lit, c))) for c in ((1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5), (0.0, 0.0, 1.0), (0.4, 0.25, 0.1))] == ["red", "black", "white", "gray", "blue", "brown"]
    assert one(spark, ladders.visibility_status(F.lit(True), F.lit(True), F.lit(0.5), F.lit(2.0))) == "partial" and one(spark, ladders.truth_bucket(F.lit("reject"))) == "uncertain"
    assert one(spark, ladders.clutter_axis(F.lit(70), F.lit(50.0), F.lit(0.0))) == "high" and one(spark, ladders.boundary_axis(F.lit(0.1), F.lit(0.05))) == "low" and one(spark, ladders.gap_axis(F.lit(0.1), F.lit(0.3))) == "high"
    assert one(spark, ladders.legacy_tier(F.lit(1.0), F.lit(0), F.lit(4.0), F.lit(0.1), F.lit(1))) == "easy" and one(spark, ladders.legacy_tier(F.lit(1.0), F.lit(3), F.lit(4.0), F.lit(0.1), F.lit(1))) == "hard"
    no = F.lit(False)
    assert one(spark, ladders.support_type(no, no, no, F.lit(True), F.lit(""))) == "object_surface" and one(spark, ladders.support_type(no, no, no, no, F.lit("x"))) == "plain_floor_blocked"
    high, legal = F.lit("high"), F.lit("legal")
    assert tuple(one(spark, ladders.affordance_hardness(legal, F.lit(True), F.lit("hard"), high, high, high))) == (25 + 10 + 14 + 6, [])
    assert tuple(one(spark, ladders.navigation_hardness(legal, F.lit(True), F.lit("hard"), F.lit("color_only"), high, high, F.lit("low")))) == (120 + 16 + 10 + 20, [])
    assert one(spark, ladders.navigation_hardness(F.lit("illegal"), F.lit(False), F.lit("easy"), F.lit("category_only"), F.lit("low"), F.lit("low"), F.lit("low"))).reasons == ["human_visible_illegal", "navigation_ineligible", "navigation_tier_not_hard", "reference_resolution_category_only", "reference_axis_low", "geometry_axis_low"]
    assert one(spark, ladders.resolution_mode(F.lit(1), F.lit(1))) == "color_and_distance" and one(spark, ladders.layout_consistent(F.lit("on"), F.lit(0.0), F.lit(0.2), F.lit(0.1), F.lit(0.1)))
    assert one(spark, ladders.removable(F.lit("Shoe"), ["table"], ["shoe"], F.lit(0.3), F.lit(0.1), F.lit(0.1), F.lit(0.05))) and not one(spark, ladders.removable(F.lit("table"), ["table"], ["shoe"], F.lit(0.3), F.lit(0.1), F.lit(0.1), F.lit(0.05)))


def test_geometry(spark):
    z = F.lit(0.0)
    assert one(spark, geometry.box_distance(F.lit(2.0), z, z, z, F.lit(2.0), F.lit(2.0), z)) == 1.0
    assert one(spark, geometry.overlap_ratio(z, z, F.lit(2.0), F.lit(2.0), F.lit(1.0), z, F.lit(2.0), F.lit(2.0))) == 0.5
    assert one(spark, geometry.edge_gap(z, z, F.lit(2.0), F.lit(2.0), F.lit(5.0), z, F.lit(2.0), F.lit(2.0))) == 3.0
    p = one(spark, geometry.pinhole(z, z, F.lit(2.0), 90.0, 101, 101))
    assert (p.px, p.py, p.depth) == (50, 50, 2.0) and one(spark, geometry.pinhole(z, z, F.lit(-1.0), 90.0, 101, 101)) is None
    f = one(spark, geometry.to_local_frame(F.lit(1.0), F.lit(1.0), z, z, z))
    assert (f.forward, f.right) == (1.0, -1.0)
    assert len(one(spark, geometry.segment_samples(z, z, F.lit(1.0), z, 0.25))) == 5 and one(spark, geometry.index_samples(F.lit(10), 4)) == [0, 3, 6, 9]
    pts = F.array(F.array(z, z), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(5.0)))
    assert one(spark, geometry.path_length(pts)) == 6.0 and one(spark, geometry.turn_degrees(F.lit(1.0), z, z, F.lit(1.0))) == pytest.approx(90)
    assert one(spark, geometry.legacy_spl(F.lit(True), F.lit(2.0), F.lit(4.0))) == 0.5
    assert one(spark, geometry.distance([z, z], [F.lit(3.0), F.lit(4.0)])) == 5.0


def test_statistics(spark):
    low, high = stats.wilson(F.lit(0.5), F.lit(100))
    assert one(spark, low) == pytest.approx(0.4038, abs=1e-4) and one(spark, high) == pytest.approx(0.5962, abs=1e-4) and one(spark, stats.wilson(F.lit(0.0), F.lit(0))[1]) == 0
    assert one(spark, stats.mean_relative_accuracy(F.lit(9.0), F.lit(10.0))) == pytest.approx(0.9) and one(spark, stats.mean_relative_accuracy(F.lit(None).cast("double"), F.lit(1.0))) == 0
    assert one(spark, stats.retry_delay(F.lit(9))) == 30 and one(spark, stats.retriable(F.lit("Rate limit hit"), ["rate limit"]))
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 2.0, 9.0), (1, 5.0, 10.0)], "g int, a double, b double")
    assert sorted(r.r for r in statistics.average_ranks(df, "a", ["g"], "r").collect()) == [1.5, 1.5, 3.0, 4.0]
    assert statistics.spearman(df, "a", "b", ["g"]).first().rho == pytest.approx(0.9486833)
    b = statistics.cluster_bootstrap(spark.range(200).selectExpr("id % 20 AS c", "cast(id % 3 = 0 AS int) AS v"), "v", "c", 500, 1).first()
    assert b.low < b.estimate < b.high and b.estimate == pytest.approx(0.335)


def test_balanced_sample_tops_up(spark):
    sizes = {"scarce": (30, 10), "none": (50, 0), "bad": (0, 50), "few": (3, 60), "many": (60, 60), "small": (5, 4)}
    rows = [(g, f"{g}{i}", i < p) for g, (p, n) in sizes.items() for i in range(p + n)]
    df = spark.createDataFrame(rows, "g string, id string, good boolean")
    count = lambda d: {(r["g"], r["good"]): r["count"] for r in d.groupBy("g", "good").count().collect()}
    want = {("scarce", True): 30, ("scarce", False): 10, ("none", True): 40, ("bad", False): 40, ("few", True): 3, ("few", False): 37, ("many", True): 20, ("many", False): 20, ("small", True): 5, ("small", False): 4}
    assert count(selection.balanced_sample(df, ["g"], "good", "id", 40, 7)) == want
    assert count(selection.balanced_sample(df, ["g"], "good", "id", 1, 7)) == {(g, g == "none"): 1 for g in sizes}
    assert selection.balanced_sample(df, ["g"], "good", "id", 0, 7).count() == 0
    flagged = df.selectExpr("*", "NOT good AND id LIKE '%5' AS surface", "good AND id LIKE '%2' AS gap")
    for limit in (1, 6, 40):
        got = selection.classification_points(flagged, ["g"], "good", "surface", "gap", "id", limit, 7)
        assert got.columns == flagged.columns and got.select("id").distinct().count() == got.count()
        for g, (p, n) in sizes.items():
            mine = [r for r in got.collect() if r["g"] == g]
            all_of = [r for r in flagged.collect() if r["g"] == g]
            assert len(mine) == min(limit, p + n)
            kept = min(sum(r["surface"] for r in all_of), max(1, min(4, limit // 2)))
            assert sum(r["surface"] for r in mine) >= kept
            assert sum(r["gap"] for r in mine) >= min(sum(r["gap"] for r in all_of), 4, limit - kept)


def test_spaced_candidates(spark):
    near = [("a", i, float(i), i == 3, 10.0 + i, 0.0) for i in range(6)]  # crowded, near; one is required
    far = [("a", 10 + i, 20.0 + i, False, 100.0 * (i + 1), 0.0) for i in range(3)]
    must = [("b", i, float(9 - i), True, 0.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(near + far + must + must[-1:], "g string, id long, depth double, must boolean, px double, py double")
    got = selection.spaced_candidates(df, ["g"], "must", "depth", "id", "px", "py", 4, 30.0).collect()
    assert {r["id"] for r in got if r["g"] == "a"} == {3, 10, 11, 12}
    assert {r["id"] for r in got if r["g"] == "b"} == {2, 3, 4, 5}


def test_selection(spark):
    df = spark.createDataFrame([(0, i, float(i % 4), float(i // 4)) for i in range(16)], "g int, id long, x double, y double")
    assert selection.thin(df, ["g"], ["id"], "x", "y", 1.5).count() == 4 + 4 or selection.thin(df, ["g"], ["id"], "x", "y", 1.5).count() >= 4
    picked = selection.greedy(spark.createDataFrame([(0, "a", 5), (0, "b", 7), (0, "c", 100)], "g int, name string, n int"), ["g"], "name", selection.window_objective("n", 12, 11, 13), 5)
    assert sorted(r.name for r in picked.collect()) == ["a", "b"]
    cover = selection.greedy(spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [2, 3, 4]), (0, 3, [3])], "g int, id long, xs array<bigint>"), ["g"], "id", selection.coverage_objective("xs"), 3)
    assert [r.id for r in cover.orderBy("place").collect()] == [2, 1]
    assert selection.stable_sample(df, ["g"], "id", 5, 3).count() == 5
    assert sum(r["count"] for r in selection.stratified_limit(spark.createDataFrame([("a", i) for i in range(2)] + [("b", i) for i in range(9)] + [("c", i) for i in range(9)], "t string, i long"), "t", ["i"], 15).groupBy("t").count().collect()) == 15


def test_graphs(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 1, 3, 5.0), (0, 8, 9, 1.0)], "g int, src long, dst long, distance double")
    q = spark.createDataFrame([(0, 1, 1, [3]), (0, 2, 1, [9]), (0, 3, 77, [1])], "g int, question_id long, start long, goals array<bigint>")
    got = {r.question_id: (r.distance, r.path, r.hops) for r in graph.shortest_routes(q, edges, "g").collect()}
    assert got == {1: (2.0, [1, 2, 3], 2), 2: (None, None, None), 3: (None, None, None)}
    labels = graph.components(edges, spark.createDataFrame([(i,) for i in (1, 2, 3, 8, 9, 11)], "node long"))
    assert {r.node: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 11: 11}
    cells = spark.createDataFrame([(0, x, y, x == 1 and y < 3) for x in range(4) for y in range(4)], "g int, gx long, gy long, occupied boolean")
    routes = graph.grid_routes(cells, spark.createDataFrame([(0, 1, 0, 0, 3, 0), (0, 2, 1, 0, 3, 3)], "g int, question_id long, sx long, sy long, gx long, gy long"), "g")
    rows = {r.question_id: r for r in routes.collect()}
    assert rows[1].steps == 6 and rows[1].reachable == 13 and rows[2].steps == -1
    field = {(r.gx, r.gy): r.clearance for r in graph.distance_field(cells, ["g"], 2).collect()}
    assert field[0, 0] == 1.0 and field[3, 3] is None or field[3, 3] > 2
    assert graph.segment_cells(0, 0, 3, 1) == [(0, 0), (1, 0), (2, 1), (3, 1)] and graph.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]
    box = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 0.0)], "g int, cx double, cy double, sx double, sy double, yaw double")
    grid = spark.createDataFrame([(0, x, 0, float(x), 0.0) for x in range(4)], "g int, gx long, gy long, x double, y double")
    assert sorted((r.gx, r.occupied) for r in graph.occupancy(box, grid, ["g"], 0.6).collect()) == [(0, True), (1, True), (2, False), (3, False)]


def test_spatial_and_ranking(spark):
    p = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.5, 0.0), (0, 3, 5.0, 5.0)], "g int, id long, x double, y double")
    pairs = spatial.pairs_within(p, ["g"], "id", "x", "y", 1.0)
    assert {(r.src, r.dst, r.distance) for r in pairs.collect()} == {(1, 2, 0.5), (2, 1, 0.5)}
    assert {r.src: len(r.neighbours) for r in spatial.neighbour_lists(pairs, ["g"]).collect()} == {1: 1, 2: 1}
    alone = spatial.clutter_facts(p.filter("id = 3"), ["g"], "id", ["x", "y"], 1.0).first()
    assert (alone.points, alone.nearest_p25) == (1, 999.0)
    w = ranking.cohort_winners(p, ["g"], "x", "id", 0.6).first()
    assert (w.winner, w.tied, w.cohort_size) == (1, 2, 3)
    assert [one(spark, ranking.distance_cue(F.lit(a), F.lit(b))) for a, b in ((1, 2), (2, 2), (1, 3), (2, 3), (3, 3), (1, 1))] == ["nearer", "farther", "closest", None, "farthest", "closest"]
    assert one(spark, ranking.directions(F.lit(1.0), F.lit(1.0))) == ["turn_left", "forward"] and one(spark, ranking.directions(F.lit(0.0), F.lit(0.0))) == []
    assert one(spark, ranking.first_allowed({"side": ranking.side_cue(F.lit(1), F.lit(3)), "ordinal": ranking.ordinal_cue(F.lit(1))}, ["ordinal", "side"])).type == "ordinal"


def test_sets_and_contracts(spark):
    assert one(spark, sets.jaccard(F.col("a"), F.col("b")), a=[1, 2], b=[2, 3]) == pytest.approx(1 / 3)
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, v int")
    assert [tuple(r) for r in contracts.violations(df, "id", {"present": F.col("v").isNotNull(), "small": F.col("v") < 3}).orderBy("id", "rule").collect()] == [(1, "small"), (2, "present"), (2, "small")]
    assert contracts.require(df, {"id": F.col("id") > 0}).count() == 2
    with pytest.raises(Exception, match="present"):
        contracts.require(df, {"present": F.col("v").isNotNull()}).collect()
    assert contracts.same_multiset(df, df) and not contracts.same_multiset(df, df.limit(1))
    assert contracts.window_gates({"a": 5, "b": 1}, {"a": (1, 9), "b": (2, 9), "c": (0, 0)}) == ["b"]


@pytest.mark.parametrize(
    "raw, ids",
    [("[1, 2]", [1, 2]), ('{"display_ids": [3, "4"]}', [3, 4]), ('[{"id": 5}, {"displayId": 6}]', [5, 6]), ("[1.5]", None), ("[true]", None), ("answer: [7] or so", [7]), ("```json\n[8]\n```", [8]), ('so {"display_ids": [9]} ends', [9]), ("none", None), (None, None)],
)
def test_collected_ids(spark, raw, ids):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(parse.collected_ids(F.col("t")).alias("x")).first().x == ids


def test_nested_json(spark):
    from lodestar.functions import nested

    df = spark.createDataFrame([('{"a": {"id": 1, "b": [{"path_ids": [2, 3]}, "s"]}, "n": 4}',), ("no",), (None,)], "t string")
    rows = df.select(nested.ids_in_json(F.col("t")).alias("i"), nested.strings_in_json(F.col("t")).alias("s")).collect()
    assert [(x.path, x.id) for x in rows[0].i] == [("a.id", 1), ("a.b.path_ids", 2), ("a.b.path_ids", 3)] and rows[0].s == ["s"] and rows[1].i is None and rows[2].i is None


def test_projections(spark):
    from lodestar.operators import projections as p

    row = F.parse_json(F.col("t"))
    assert one(spark, p.field_or_nested(row, "a", "bigint"), t='{"a": null, "ground_truth": {"a": 5}}') is None and one(spark, p.field_or_nested(row, "a", "bigint"), t='{"ground_truth": {"a": 5}}') == 5
    no = F.lit(None).cast("string")
    assert one(spark, p.embodied(F.lit("c"), no, no, F.lit(None).cast("double"), builder=True)) and not one(spark, p.embodied(F.lit("c"), no, no, F.lit(None).cast("double")))
    assert one(spark, p.view_of(F.lit(None).cast("int"), F.lit("x/view_12/a.json"))) == 12
    assert one(spark, p.non_null_json(a=F.lit(1), b=no)) == '{"a":1}' and one(spark, p.first_usable(F.lit(0), F.lit(3))) == 3
    assert one(spark, p.recognizable(F.lit(900.0), F.lit(-5), F.lit(50), F.lit(60), F.lit(70), 100, 100, 500, 4)) and not one(spark, p.recognizable(F.lit(900.0), F.lit(2), F.lit(50), F.lit(60), F.lit(70), 100, 100, 500, 4))
    assert one(spark, p.map_ids(F.col("a"), F.create_map(F.lit(1), F.lit("x"))), a=[1, 2]) == ["x"]
    assert one(spark, p.missing_paths(row, ["$.a", "$.b.c"]), t='{"a": 1}') == ["$.b.c"]
    assert one(spark, p.chat_row(F.lit("q"), F.lit("a")))[1].role == "assistant" and one(spark, p.target_phrase(F.lit("chair"), F.lit("red"), F.lit("nearest"))) == "the nearest red chair"
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert p.allowed_only(df, ["a", "z"], []).columns == ["a"] and [x.columns for x in p.sheets(df, "a", ["c"])] == [["a", "b"], ["a", "c"]]
    with pytest.raises(ValueError, match="forbidden"):
        p.allowed_only(df, ["a"], ["a"])


def test_more_geometry_and_graphs(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (0.1, 0), (0.2, 0), (0.2, 0.1), (0.2, 0.9))])
    assert [(p.x, p.y) for p in one(spark, geometry.keypoints(pts))] == [(0, 0), (0.2, 0), (0.2, 0.9)]
    px = one(spark, geometry.to_pixel(F.lit(0.0), F.lit(0.0), 101, 51))
    back = one(spark, geometry.to_screen(F.lit(px.px), F.lit(px.py), 101, 51))
    assert (px.px, px.py) == (50, 25) and (back.x, back.y) == (0, 0) and one(spark, geometry.radius_pixels(F.lit(0.1), 5.0, 90.0, 100)) == 12
    box = one(spark, geometry.image_box(F.array(*[F.struct(F.lit(x).alias("px"), F.lit(y).alias("py")) for x, y in ((0, 0), (10, 0), (10, 200))]), 100, 100))
    assert (box.x1, box.y1, box.area) == (10, 200, 990)
    cal = graph.calibrate(spark.createDataFrame([(0, float(x), float(y), 2.0 * x + 1, 3.0 * y - 1, 1.0) for x in range(3) for y in range(3)] + [(1, 0.0, 0.0, 0.0, 0.0, 1.0)], "g int, x double, y double, px double, py double, depth double"), "g")
    rows = {r.g: r for r in cal.collect()}
    assert rows[0].residual_p90 < 1e-6 and rows[1].h is None
    spots = spatial.surface_samples(spark.createDataFrame([(1, 0, 0, 10, 10), (2, 0, 0, 100, 20), (3, 0, 0, 60, 60)], "id int, x0 int, y0 int, x1 int, y1 int"))
    assert {r.id: r["count"] for r in spots.groupBy("id").count().collect()} == {1: 1, 2: 3, 3: 2}
    cells = spark.createDataFrame([(x, y, x in (1, 2) and y in (1, 2)) for x in range(4) for y in range(4)], "gx long, gy long, occupied boolean")
    assert selection.blocked_inside(cells, []).count() == 4 and selection.lattice(cells, 2).count() == 4
    assert one(spark, graph.edge_status(F.lit(2), F.lit(1), F.lit(True))) == "illegal_edge"
