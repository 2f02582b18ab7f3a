"""Row projections, status ladders and camera geometry over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import geometry, ladders
from lodestar.operators import contracts, mining, projections, ranking, selection, sets, statistics
from lodestar.plans.registry import Tables, query
from lodestar.plans.spaces import _POINTS, points
from lodestar.plans.texts import _pick


@query("""WITH x AS (SELECT event_id, ['a1', 'b1', 'a2', 'b2', 'c'][user_id % 5 + 1] AS task, ['kit__', 'lab__', ''][event_id % 3 + 1] || 's' || user_id % 9 || '__' || event_id % 4 AS scene, event_id % 6 AS view, event_type FROM events)
SELECT event_id, CASE WHEN task IN ('a1', 'b1') THEN 'affordance' ELSE 'navigation' END AS family, scene || '::v' || view AS set_key, scene || '::v' || view || '::' || event_type AS route_key, split_part(scene, '__', 1) AS dataset,
  CASE WHEN split_part(scene, '__', 1) = 'kit' THEN 'kit__' || split_part(scene, '__', 2) ELSE scene END AS leakage FROM x""")
def bundle_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family, bundle keys, source data set and what may not be split, of each row."""
    k, user = F.col("event_id"), F.col("user_id")
    scene = F.concat(_pick(k, "kit__", "lab__", ""), F.lit("s"), (user % 9).cast("string"), F.lit("__"), (k % 4).cast("string"))
    x = Tables(spark, sf_dir).events.select("event_id", "event_type", _pick(user, "a1", "b1", "a2", "b2", "c").alias("task"), scene.alias("scene"), (k % 6).alias("view"))
    c = F.col
    return x.select("event_id", mining.family(c("task")).alias("family"), mining.bundle_key(c("scene"), c("view")).alias("set_key"), mining.bundle_key(c("scene"), c("view"), c("event_type")).alias("route_key"), mining.source_dataset(c("scene")).alias("dataset"), mining.source_group(c("scene"), "kit").alias("leakage"))


@query("""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, ['a2', 'b2', 'c', 'a1'][o_orderkey % 4 + 1] AS task, CASE WHEN o_orderkey % 6 = 0 THEN 'embodied' END AS semantics, CASE WHEN o_orderkey % 10 = 0 THEN 0.3 ELSE 0 END AS diameter FROM orders)
SELECT k AS o_orderkey, task = 'b2' OR semantics IS NOT NULL OR diameter > 0 AS scored, task = 'c' OR task = 'b2' OR semantics IS NOT NULL OR diameter > 0 AS built, CASE WHEN k % 3 = 0 THEN 4 ELSE k % 12 END::INT AS view,
  CASE WHEN semantics IS NULL THEN '{"task":"' || task || '"}' ELSE '{"task":"' || task || '","semantics":"embodied"}' END AS packed, CASE WHEN k % 2 = 0 AND c <> 0 THEN c WHEN k % 3 = 0 THEN 7 END AS usable, k % 5 AS answer FROM x""")
def row_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embodiment as scorer and builder see it, view numbers, fields without nulls, fallbacks, and sheet and key of a test."""
    k = F.col("o_orderkey")
    x = Tables(spark, sf_dir).orders.select("o_orderkey", F.col("o_custkey").alias("c"), _pick(k, "a2", "b2", "c", "a1").alias("task"), F.when(k % 6 == 0, F.lit("embodied")).alias("semantics"), F.when(k % 10 == 0, 0.3).otherwise(0.0).alias("diameter"), (k % 5).alias("answer"), F.lit(1).alias("secret"))
    none = F.lit(None).cast("string")
    c = F.col
    path = F.concat(F.lit("scene/view_"), F.lpad((k % 12).cast("string"), 2, "0"), F.lit(".png"))
    usable = projections.first_usable(F.when(k % 2 == 0, c("c")).otherwise(F.lit(0)), F.when(k % 3 == 0, F.lit(7).cast("long")))
    wide = x.withColumns({"scored": projections.embodied(c("task"), c("semantics"), none, c("diameter")), "built": projections.embodied(c("task"), c("semantics"), none, c("diameter"), builder=True), "view": projections.view_of(F.when(k % 3 == 0, F.lit(4)), path), "packed": projections.non_null_json(task=c("task"), semantics=c("semantics")), "usable": usable})
    sheet, key = projections.sheets(projections.allowed_only(wide, ["o_orderkey", "scored", "built", "view", "packed", "usable", "answer", "absent"], ["secret"]), "o_orderkey", ["answer"])
    return sheet.join(key, "o_orderkey")


@query("""WITH x AS (SELECT p_partkey AS k, ['supported', 'unsupported'][p_partkey % 2 + 1] AS support, ['unique', 'ambiguous', NULL][p_partkey % 3 + 1] AS uniq, ['aligned', 'reject', 'uncertain', 'contradicted'][p_partkey % 4 + 1] AS truth, p_partkey % 7 = 0 AS leaks, (p_size % 20) / 10.0 - 1.05 AS sx, (p_size % 9) / 4.0 - 1 AS sy, p_size * 10 AS area FROM part)
SELECT k AS p_partkey, CASE WHEN leaks THEN 'illegal' WHEN support = 'supported' AND uniq = 'unique' THEN 'legal' WHEN truth = 'reject' OR uniq = 'ambiguous' THEN 'illegal' ELSE 'uncertain' END AS legality, CASE WHEN truth = 'aligned' THEN 'truth_aligned' ELSE 'uncertain' END AS bucket,
  CASE WHEN k % 5 = 0 THEN 'not_reliable' WHEN k % 2 = 0 AND sx BETWEEN -1 AND 1 AND sy BETWEEN -1 AND 1 THEN 'visible' ELSE 'partial' END AS visibility,
  area >= 150 AND NOT (area BETWEEN 0 AND 4 OR area BETWEEN 635 AND 639 OR area + 40 BETWEEN 0 AND 4 OR area + 40 BETWEEN 635 AND 639 OR k % 50 BETWEEN 0 AND 4 OR k % 50 + 40 BETWEEN 475 AND 479) AS recognizable,
  k % 3 <> 0 AND area / 1000.0 >= CASE WHEN k % 4 = 0 THEN 0.1 ELSE 0.3 END AS surface,
  CASE WHEN k % 6 = 0 THEN 'contradicted' WHEN k % 4 = 0 THEN 'uncertain' ELSE 'aligned' END AS risk FROM x""")
def legality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a person could answer, truth buckets, and what can be seen and recognised."""
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    truth = _pick(k, "aligned", "reject", "uncertain", "contradicted")
    area = size * 10
    codes = F.array_compact(F.array(F.when(k % 6 == 0, F.lit("wrong_color")), F.when(k % 4 == 0, F.lit("no_color"))))
    return Tables(spark, sf_dir).part.select(
        "p_partkey",
        ladders.legality(_pick(k, "supported", "unsupported"), _pick(k, F.lit("unique"), F.lit("ambiguous"), none), truth, k % 7 == 0).alias("legality"),
        ladders.truth_bucket(truth).alias("bucket"),
        ladders.visibility_status(k % 5 != 0, k % 2 == 0, (size % 20) / 10 - 1.05, (size % 9) / 4 - 1).alias("visibility"),
        projections.recognizable(area, area, k % 50, area + 40, k % 50 + 40, 640, 480, 150, 4).alias("recognizable"),
        projections.surface_visible(k % 3 != 0, area / 1000, k % 4 == 0, 0.3, 0.1).alias("surface"),
        contracts.risk_status(codes, ["wrong_color"], ["no_color"]).alias("risk"),
    )


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS s, (p_partkey % 40) / 100.0 AS a, (p_size % 50) / 100.0 AS b FROM part)
SELECT k AS p_partkey, CASE WHEN s * 2 > 65 OR k % 60 < 28 OR a > 0.15 THEN 'high' WHEN s * 2 <= 35 AND k % 60 >= 42 AND a <= 0.05 THEN 'low' ELSE 'medium' END AS clutter,
  CASE WHEN a > 0.25 OR b > 0.25 THEN 'high' WHEN a <= 0.1 AND b <= 0.1 THEN 'low' ELSE 'medium' END AS boundary, CASE WHEN a > 0.3 OR b > 0.2 THEN 'high' WHEN a <= 0.1 THEN 'low' ELSE 'medium' END AS gap,
  CASE WHEN 1 + a <= 1.1 AND k % 3 <= 1 AND s / 6.0 <= 4 AND b <= 0.1 AND k % 4 <= 1 THEN 'easy' WHEN 1 + a <= 1.35 AND k % 3 <= 2 AND s / 6.0 <= 7 AND b <= 0.25 AND k % 4 <= 2 THEN 'medium' ELSE 'hard' END AS legacy,
  CASE WHEN k % 3 > 0 AND k % 4 > 0 THEN 'color_and_distance' WHEN k % 3 > 0 THEN 'distance_only' WHEN k % 4 > 0 THEN 'color_only' ELSE 'category_only' END AS mode,
  CASE WHEN k % 11 = 0 THEN 'excluded_occluded' WHEN k % 7 = 0 THEN 'ground' WHEN k % 5 = 0 THEN 'structural_surface' WHEN k % 3 = 0 THEN 'object_surface' WHEN k % 2 = 0 THEN 'structural_surface' ELSE 'plain_floor_blocked' END AS support,
  k % 2 = 0 AND s / 100.0 <= 0.5 AND pow(s / 100.0, 1) * 0.2 <= 0.2 AND s / 100.0 <= 0.5 AS removable_named,
  CASE WHEN k % 3 = 0 THEN abs(a - b) <= 0.25 AND a < b - 0.03 WHEN k % 3 = 1 THEN abs(a - b) <= 0.25 AND a > b + 0.03 ELSE true END AND k % 13 <> 0 AS consistent,
  CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'a_reason' WHEN k % 2 = 0 THEN 'b_reason' WHEN k % 3 = 0 THEN 'a_reason' ELSE 'no_relation' END AS why FROM x""")
def axis_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of clutter, boundary and gap, the older tier, and ladders of modes, supports, cues and reasons."""
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b = (k % 40) / 100, (s % 50) / 100
    source = F.when(k % 2 == 0, F.lit(" Visible_Structural_Surface ")).otherwise(F.lit("grid"))
    side = s / 100
    # Footprint and volume of a flat object that stands on the floor.
    removable = ladders.removable(F.when(k % 2 == 0, F.lit("Shoe")).otherwise(F.lit("Table")), ["table"], ["shoe", "bag"], side, F.lit(1.0), F.lit(0.2), F.lit(0.1))
    relation = _pick(k, "under", "on", "near")
    known = lambda v: F.when(k % 13 != 0, v)
    reasons = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("b_reason")), F.when(k % 3 == 0, F.lit("a_reason"))))
    return Tables(spark, sf_dir).part.select(
        "p_partkey",
        ladders.clutter_axis(s * 2, k % 60, a).alias("clutter"),
        ladders.boundary_axis(a, b).alias("boundary"),
        ladders.gap_axis(a, b).alias("gap"),
        ladders.legacy_tier(1 + a, k % 3, s / 6, b, k % 4).alias("legacy"),
        ladders.resolution_mode(k % 3, k % 4).alias("mode"),
        ladders.support_type(k % 11 == 0, k % 7 == 0, k % 5 == 0, k % 3 == 0, source).alias("support"),
        removable.alias("removable_named"),
        ladders.layout_consistent(relation, known(a), known(a), b, b).alias("consistent"),
        ladders.why_not(reasons).alias("why"),
    )


@query(f"""WITH {_POINTS}, x AS (SELECT vec_id, x, y, z, abs(z) + 0.01 AS d FROM pt),
p AS (SELECT *, x / d / tan(radians(90.0) / 2) / (640 / 480.0) AS nx, y / d / tan(radians(90.0) / 2) AS ny FROM x)
SELECT vec_id, CASE WHEN d > 0.05 AND nx BETWEEN -1 AND 1 AND ny BETWEEN -1 AND 1 THEN round((nx + 1) / 2 * 639)::INT END AS px, CASE WHEN d > 0.05 AND nx BETWEEN -1 AND 1 AND ny BETWEEN -1 AND 1 THEN round((1 - ny) / 2 * 479)::INT END AS py,
  round((x + 1) / 2 * 639)::INT AS sx, round(2 * (vec_id % 640) / 639.0 - 1, 6) AS ux, round((x - 0.1) * cos(z) + (y - 0.2) * sin(z), 6) AS forward, round((x - 0.1) * sin(z) - (y - 0.2) * cos(z), 6) AS rightward,
  greatest(ceil(sqrt(x * x + y * y) / 0.03)::INT, 1) + 1 AS samples, round(x / greatest(ceil(sqrt(x * x + y * y) / 0.03)::INT, 1), 6) AS second_x, floor((vec_id % 97) * 2 / 4.0)::BIGINT AS middle, round(CASE WHEN vec_id % 2 = 0 AND d > 0 THEN 0.2 / greatest(0.2, d) ELSE 0 END, 6) AS spl,
  greatest(1, least(12, round(0.05 / greatest(d, 1e-6) * 480 / (2 * tan(radians(90.0) / 2)))))::INT AS radius FROM p""")
def camera_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, screen transforms, local frames, samples along segments, and the older path score."""
    c = F.col
    x = points(spark, sf_dir).select("vec_id", "x", "y", "z", (F.abs("z") + 0.01).alias("d"))
    seen = geometry.pinhole(c("x"), c("y"), c("d"), 90.0, 640, 480)
    local = geometry.to_local_frame(c("x"), c("y"), F.lit(0.1), F.lit(0.2), c("z"))
    line = geometry.segment_samples(F.lit(0.0), F.lit(0.0), c("x"), c("y"), 0.03)
    return x.select(
        "vec_id", seen["px"].alias("px"), seen["py"].alias("py"), geometry.to_pixel(c("x"), c("y"), 640, 480)["px"].alias("sx"), F.round(geometry.to_screen(c("vec_id") % 640, F.lit(0), 640, 480)["x"], 6).alias("ux"),
        F.round(local["forward"], 6).alias("forward"), F.round(local["right"], 6).alias("rightward"), F.size(line).alias("samples"), F.round(F.get(line, 1)["x"], 6).alias("second_x"),
        geometry.index_samples(c("vec_id") % 97 + 1, 5)[2].alias("middle"), F.round(geometry.legacy_spl(c("vec_id") % 2 == 0, F.lit(0.2), c("d")), 6).alias("spl"), geometry.radius_pixels(c("d"), 0.05, 90.0, 480, 1).alias("radius"),
    )


@query("""WITH x AS (SELECT user_id, event_id, (event_id % 700)::INT AS px, (event_id * 7 % 500)::INT AS py FROM events), b AS (SELECT user_id, count(*) AS n, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM x GROUP BY user_id)
SELECT user_id, CASE WHEN n >= 3 THEN x0 END AS x0, CASE WHEN n >= 3 THEN y1 END AS y1, CASE WHEN n >= 3 THEN greatest(least(639, x1) - least(639, x0), 0) * greatest(least(479, y1) - least(479, y0), 0) END AS area FROM b""")
def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of each user's pixels and its area inside the image."""
    k = F.col("event_id")
    x = Tables(spark, sf_dir).events.groupBy("user_id").agg(F.collect_list(F.struct((k % 700).cast("int").alias("px"), (k * 7 % 500).cast("int").alias("py"))).alias("p"))
    box = geometry.image_box(F.col("p"), 640, 480)
    return x.select("user_id", box["x0"].alias("x0"), box["y1"].alias("y1"), box["area"].alias("area"))


@query("""WITH d(event_type, place) AS (VALUES ('view', 0), ('click', 1), ('teleport', 2)), n AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT d.event_type, place::INT AS place, coalesce(n, 0) AS n FROM d LEFT JOIN n ON d.event_type = n.event_type""")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in the order of a fixed domain."""
    return statistics.domain_counts(Tables(spark, sf_dir).events.select("event_type"), "event_type", ["view", "click", "teleport"])


@query("""WITH x AS (SELECT unnest(['status', 'priority']) AS axis, unnest([o_orderstatus, o_orderpriority]) AS level FROM orders), c AS (SELECT axis, level, count(*) AS n FROM x GROUP BY axis, level), s AS (SELECT *, n / sum(n) OVER (PARTITION BY axis) AS share FROM c)
SELECT axis, level, n, round(share, 6) AS share, CASE WHEN share < 0.1 THEN 'rare' ELSE '' END || CASE WHEN n < 100 THEN CASE WHEN share < 0.1 THEN ',few' ELSE 'few' END ELSE '' END AS gates FROM s WHERE share > 0.2""")
def axis_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that hold too much of their axis, and the gates that they miss."""
    x = mining.axis_shares(Tables(spark, sf_dir).orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), ["status", "priority"]).drop("share")
    wide = statistics.collapse_warnings(x, "axis", "n", 0.2)
    gates = statistics.modal_gates({"rare": F.col("share"), "few": F.col("n")}, {"rare": 0.1, "few": 100})
    return wide.select("axis", "level", "n", F.round("share", 6).alias("share"), F.array_join(gates, ",").alias("gates"))


@query("""SELECT l_orderkey, min_by(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS l_returnflag, count(DISTINCT l_returnflag) = 1 AS agrees, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS members FROM lineitem GROUP BY l_orderkey""")
def consistent_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each order, whether all its rows agree, and its members."""
    x = mining.consistent(Tables(spark, sf_dir).lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag"], "l_linenumber")
    return x.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("""WITH c AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM c) WHERE n = 1),
r AS (SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM c WHERE s_suppkey NOT IN (SELECT s_suppkey FROM f)) WHERE n = 1)
SELECT f.s_nationkey, f.s_suppkey AS winner, r.s_suppkey AS next_winner, (SELECT array_to_string(list_sort(list(s_suppkey)), ',') FROM c WHERE c.s_nationkey = f.s_nationkey) AS pool FROM f LEFT JOIN r ON f.s_nationkey = r.s_nationkey""")
def unused_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's best supplier, the best that isn't used yet, and the pool."""
    c = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_nationkey", "s_acctbal")
    order = [F.col("s_acctbal").desc(), F.col("s_suppkey")]
    first = ranking.best_by(c, ["s_nationkey"], order).select("s_nationkey", F.col("s_suppkey").alias("winner"))
    second = ranking.unused_winner(c, first.select(F.col("winner").alias("s_suppkey")), ["s_nationkey"], order, "s_suppkey").select("s_nationkey", F.col("s_suppkey").alias("next_winner"))
    pools = ranking.candidate_pools(c, ["s_nationkey"], "s_suppkey")
    return first.join(second, "s_nationkey", "left").join(pools, "s_nationkey").withColumn("pool", F.array_join(F.col("pool").cast("array<string>"), ","))


@query("""WITH s AS (SELECT event_id, event_id % 721 - 359.5 AS h, value FROM events), w AS (SELECT event_id, CASE WHEN h > 180 THEN h - 360 WHEN h < -180 THEN h + 360 ELSE h END AS g, value FROM s)
SELECT event_id, array_to_string(list_filter([CASE WHEN g > 5 THEN 'turn_left' WHEN g < -5 THEN 'turn_right' END, CASE WHEN value > 30 THEN 'forward' END], lambda v: v IS NOT NULL), ',') AS said FROM w""")
def spoken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions for each heading change and step."""
    change = F.radians(F.col("event_id") % 721 - 359.5)
    return Tables(spark, sf_dir).events.select("event_id", F.array_join(ranking.directions(change, F.when(F.col("value") > 30, 1.0).otherwise(0.0)), ",").alias("said"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || ':5'), c_custkey) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE n <= 30""")
def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty customers of each segment, drawn by hash."""
    return selection.stable_sample(Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 30, 5)


@query(f"""WITH {_POINTS} SELECT vec_id, round(1 / (1 + abs(x * 40 - 4)) * least(sx * 4, 2.0) * CASE WHEN vec_id % 3 = 0 THEN 1.5 ELSE 1 END, 6) AS score FROM pt""")
def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", F.round(selection.target_score(F.col("x") * 40, F.col("sx") * 4, F.col("vec_id") % 3 == 0), 6).alias("score"))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey AS start, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS n FROM supplier), g AS (SELECT s_nationkey, s_suppkey AS goal, row_number() OVER (PARTITION BY s_nationkey ORDER BY -s_acctbal, s_suppkey) AS n FROM supplier),
p AS (SELECT a.s_nationkey, a.s_suppkey AS start, b.s_suppkey AS goal, (a.s_suppkey * 7 + b.s_suppkey * 13) % 101 AS length FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.s_nationkey ORDER BY length, p.start, p.goal) AS n FROM p JOIN s ON p.start = s.start AND s.n <= 3 JOIN g ON p.goal = g.goal AND g.n <= 3) SELECT s_nationkey, start, goal, length FROM r WHERE n = 1""")
def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path between the first three starts and goals of each nation."""
    s = Tables(spark, sf_dir).supplier
    side = lambda name: s.select("s_nationkey", F.col("s_suppkey").alias(name))
    lengths = side("start").join(side("goal"), "s_nationkey").filter("start <> goal").withColumn("length", (F.col("start") * 7 + F.col("goal") * 13) % 101)
    ranked = lambda sign: s.select("s_nationkey", F.col("s_suppkey").alias("id"), (F.col("s_acctbal") * sign).alias("rank"))
    return selection.best_pairs(ranked(1), ranked(-1), lengths, ["s_nationkey"], 3)


@query("""WITH m AS (SELECT user_id, list_distinct(list(event_type) FILTER (event_id % 2 = 0)) AS a, list_distinct(list(event_type) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY user_id)
SELECT user_id, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / greatest(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 1), 6) AS overlap FROM m""")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard overlap of each user's event types at even and at odd ids."""
    side = lambda r: F.collect_set(F.when(F.col("event_id") % 2 == r, F.col("event_type")))
    x = Tables(spark, sf_dir).events.groupBy("user_id").agg(side(0).alias("a"), side(1).alias("b"))
    return x.select("user_id", F.round(sets.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("""WITH a AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.s, b.s) AS s, coalesce(a.p, b.p) AS p, coalesce(a.n, 0) - coalesce(b.n, 0) AS surplus FROM a FULL JOIN b ON a.s = b.s AND a.p = b.p WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one half of the orders holds more often than the other."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    half = lambda r: o.filter(F.col("o_orderkey") % 2 == r).select("s", "p")
    return contracts.multiset_difference(half(0), half(1))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'contradicted' ELSE 'uncertain' END AS status, (o_orderkey % 4 = 0)::INT + (o_orderkey % 3 = 0)::INT AS codes, row_number() OVER (ORDER BY o_orderkey % 4 = 0 DESC, (o_orderkey % 4 = 0)::INT + (o_orderkey % 3 = 0)::INT DESC, o_orderkey) AS place
FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 ORDER BY place LIMIT 50""")
def severity_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty worst rows: contradicted ones first, then those with more codes."""
    from lodestar.operators import reports

    k = F.col("o_orderkey")
    codes = F.array_compact(F.array(F.when(k % 4 == 0, F.lit("wrong")), F.when(k % 3 == 0, F.lit("vague"))))
    x = Tables(spark, sf_dir).orders.select("o_orderkey", codes.alias("all")).withColumn("status", contracts.risk_status(F.col("all"), ["wrong"], ["vague"]))
    short = reports.severity_order(x, "status", "all", "o_orderkey").limit(50).select("o_orderkey", "status", F.size("all").alias("codes"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy((F.col("status") == "contradicted").desc(), F.col("codes").desc(), "o_orderkey"))
    return short.withColumn("place", place)
