"""Reports, projections and anchors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import hashing
from lodestar.operators import projections, ranking, reports, selection
from lodestar.plans.registry import Tables, query
from lodestar.plans.spaces import points

_POINTS = "pt AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query("""WITH r AS (SELECT event_type AS kind, value::DOUBLE AS p, (user_id + 1)::DOUBLE AS t FROM events),
s AS (SELECT kind, CASE WHEN kind IN ('click', 'view') THEN (SELECT sum(CASE WHEN abs(p - t) / abs(t) <= (50 - 5 * i) / 100.0 THEN 1 ELSE 0 END) FROM (SELECT unnest(range(10)) AS i)) / 10 ELSE CASE WHEN floor(p) = floor(t) THEN 1 ELSE 0 END END AS score FROM r),
k AS (SELECT kind, count(*) AS n, avg(score) AS a FROM s GROUP BY kind), m AS (SELECT CASE WHEN kind IN ('click', 'view') THEN 'numbers' ELSE kind END AS kind, sum(n)::BIGINT AS n, avg(a) AS a FROM k GROUP BY 1)
SELECT kind, n, round(a, 6) AS accuracy FROM m UNION ALL SELECT 'overall', sum(n)::BIGINT, round(avg(a), 6) FROM m""")
def mixed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by kind of question: relative for numeric kinds, exact for others; kinds merged first, then averaged."""
    numeric = F.col("event_type").isin("click", "view")
    whole = lambda c: F.floor(c).cast("string")
    target = F.col("user_id") + 1
    rows = Tables(spark, sf_dir).events.select(F.col("event_type").alias("kind"), F.when(numeric, F.col("value").cast("string")).otherwise(whole(F.col("value"))).alias("prediction"), F.when(numeric, target.cast("string")).otherwise(whole(target)).alias("target"))
    out = reports.mixed_accuracy(rows, "kind", ["click", "view"], {"click": "numbers", "view": "numbers"})
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations), s AS (SELECT role, CASE WHEN conv_id % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM l WHERE k = 1)
SELECT role, count(*) AS n, sum((status = 'accepted')::INT)::BIGINT AS accepted, sum((status = 'rejected')::INT)::BIGINT AS rejected, sum((status = 'rejected')::INT) / count(*) < 0.01 AS ready FROM s GROUP BY role""")
def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each id by task, accepted or rejected."""
    rows = Tables(spark, sf_dir).conversations.withColumn("status", F.when(F.col("conv_id") % 7 == 0, F.lit("rejected")).otherwise(F.lit("accepted")))
    return reports.generation_report(rows, "conv_id", F.col("turn"), "role", "status")


@query("""WITH x AS (SELECT d.doc_id, d.doc_id % 4 = 0 AS a, l.doc_id IS NOT NULL AS p, trim(coalesce(text, '')) = '' OR d.doc_id % 11 = 0 AS e FROM documents AS d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) AS l ON d.doc_id = l.doc_id)
SELECT CASE WHEN a THEN 'skipped' WHEN NOT p THEN 'missing_packet' WHEN e THEN 'no_text' ELSE 'to_check' END AS status, count(*) AS n FROM x GROUP BY status""")
def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where generated rows go."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"))
    return reports.routed(rows, rows.filter("doc_id % 4 = 0"), t.labels, "doc_id", "text")


@query("""SELECT c_nationkey, c_mktsegment, sum((c_acctbal > 5000)::INT)::BIGINT AS supported, CASE sum((c_acctbal > 5000)::INT) WHEN 0 THEN 'empty' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, coalesce(min(c_custkey) FILTER (c_acctbal > 5000), -1) AS first_witness FROM customer GROUP BY c_nationkey, c_mktsegment""")
def view_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a type has no, one or several supported objects in a view."""
    c = Tables(spark, sf_dir).customer.withColumn("ok", F.col("c_acctbal") > 5000)
    x = reports.view_ambiguity(c, ["c_nationkey"], "c_mktsegment", "ok", "c_custkey")
    return x.select("c_nationkey", "c_mktsegment", "supported", "status", F.coalesce(F.get("witnesses", 0), F.lit(-1)).alias("first_witness"))


@query("""WITH e AS (SELECT l_orderkey, l_returnflag <> 'R' AS legal, l_linestatus = 'O' AS body, l_discount * 10 AS cf, l_tax * 12 AS bf, l_partkey % 60 AS fore, l_suppkey % 3 AS obj FROM lineitem),
c AS (SELECT l_orderkey, CASE WHEN legal THEN CASE WHEN cf >= 0.3 AND CASE WHEN body THEN bf ELSE cf END >= 0.5 THEN 'observable_safe' ELSE 'uncertain_safe' END WHEN fore >= greatest(1, ceil(0.02 * 1000)) THEN 'depth_obstruction_evidence' WHEN obj > 0 THEN 'object_only_obstruction_cue' ELSE 'uncertain_blocked' END AS c FROM e)
SELECT l_orderkey, count(*) AS edges, bool_or(c = 'observable_safe') AS any_supported, bool_and(c = 'observable_safe') AS all_supported FROM c GROUP BY l_orderkey""")
def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of a route's edges, reduced to any and all."""
    c = F.col
    seen = lambda share: F.struct(share.alias("in_frame_fraction"), share.alias("visually_free_fraction"), F.lit(1000).alias("in_frame_count"), (c("l_partkey") % 60).alias("foreground_count"), (c("l_suppkey") % 3).alias("object_pixel_count"))
    label = reports.edge_support(c("l_returnflag") != "R", seen(c("l_discount") * 10), seen(c("l_tax") * 12), c("l_linestatus") == "O", 0.3, 0.5)
    return reports.support_by_question(Tables(spark, sf_dir).lineitem.select("l_orderkey", label.alias("support")), ["l_orderkey"], "support")


@query("""SELECT lang, source, count(*) AS n, round(coalesce(avg(CASE WHEN v <> -1 THEN v END), -1), 6) AS mean FROM (SELECT lang, source, CASE WHEN doc_id % 9 = 0 THEN -1.0::DOUBLE ELSE n_chars::DOUBLE END AS v FROM documents) GROUP BY GROUPING SETS ((), (lang), (source))""")
def level_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all rows, by language and by source in one pass; unknown values don't count."""
    x = Tables(spark, sf_dir).documents.select("lang", "source", F.when(F.col("doc_id") % 9 == 0, F.lit(-1.0)).otherwise(F.col("n_chars").cast("double")).alias("v"))
    return reports.by_sets(x, [[], ["lang"], ["source"]], "v")


@query(f"""WITH {_POINTS}, r AS (SELECT *, sqrt(x * x + y * y) AS d, row_number() OVER (PARTITION BY label ORDER BY sqrt(x * x + y * y), abs(x), abs(y + 1), z, vec_id) AS n FROM pt) SELECT label, vec_id, round(d, 6) AS anchor_distance FROM r WHERE n = 1 AND d <= 0.08""")
def start_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of each view: nearest to the anchor, if within reach."""
    x = points(spark, sf_dir).select("label", "vec_id", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("anchor_distance"), F.col("x").alias("screen_x"), F.col("y").alias("screen_y"), F.col("z").alias("depth"))
    return ranking.start_anchor(x, ["label"], "vec_id", 0.08).withColumn("anchor_distance", F.round("anchor_distance", 6))


@query(f"""WITH {_POINTS} SELECT a.label, a.vec_id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS anchor_distance FROM pt AS a JOIN pt AS b ON a.label = b.label WHERE b.vec_id % 9 = 0 GROUP BY a.label, a.vec_id""")
def anchor_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir).select("label", "vec_id", F.col("x").alias("screen_x"), F.col("y").alias("screen_y"))
    return ranking.anchor_distances(x, x.filter("vec_id % 9 = 0"), ["label"], "vec_id").withColumn("anchor_distance", F.round("anchor_distance", 6))


@query("""WITH p AS (SELECT user_id, ts, event_id, value AS x, json_extract_string(props, '$.k')::DOUBLE AS y FROM events),
d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, lead(dx) OVER w AS nx, lead(dy) OVER w AS ny FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy), 0) AS step, CASE WHEN sqrt(dx * dx + dy * dy) > 0 AND sqrt(nx * nx + ny * ny) > 0 THEN degrees(acos(greatest(-1, least(1, (dx * nx + dy * ny) / (sqrt(dx * dx + dy * dy) * sqrt(nx * nx + ny * ny)))))) END AS turn FROM s)
SELECT user_id, round(sum(step), 3) AS length, sum(coalesce((turn >= 20)::INT, 0))::BIGINT AS turns, round(sum(step) / greatest(sqrt(pow(first(x ORDER BY ts, event_id) - last(x ORDER BY ts, event_id), 2) + pow(first(y ORDER BY ts, event_id) - last(y ORDER BY ts, event_id), 2)), 1e-6), 3) AS detour FROM t GROUP BY user_id""")
def path_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, detour and turns of each user's path."""
    x = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    p = ranking.path_complexity(x, ["user_id"], ["ts", "event_id"], "x", "y")
    return p.select("user_id", F.round("length", 3).alias("length"), "turns", F.round("detour", 3).alias("detour"))


@query(f"""WITH {_POINTS}, f AS (SELECT label, count(*) AS objects, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS area FROM pt GROUP BY label), p AS (SELECT a.label, bool_or(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN 0.5 AND 0.6) AS pair FROM pt AS a JOIN pt AS b ON a.label = b.label GROUP BY a.label)
SELECT f.label, objects, round(area, 6) AS area, CASE WHEN objects NOT BETWEEN 10 AND 60 THEN 'object_count' WHEN area NOT BETWEEN 1 AND 2.4 THEN 'area' WHEN NOT pair THEN 'no_pair_in_window' END AS reason FROM f JOIN p ON f.label = p.label""")
def scene_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a scene isn't admitted."""
    x = projections.admission(points(spark, sf_dir), "label", (10, 60), (1.0, 2.4), (0.5, 0.6))
    return x.withColumn("area", F.round("area", 6))


@query("""WITH r AS (SELECT *, p_size > 45 AS req, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 45) DESC, p_retailprice, p_partkey) AS n FROM part) SELECT p_partkey, p_brand FROM r WHERE req OR n <= 10""")
def candidate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required candidates and then the nearest ones, up to a budget."""
    x = Tables(spark, sf_dir).part.withColumn("req", F.col("p_size") > 45)
    return selection.budgeted(x, ["p_brand"], "req", "p_retailprice", "p_partkey", 10).select("p_partkey", "p_brand")


@query("""WITH l(level, low, share) AS (VALUES (0, 0, 0.0), (1, 10, 0.02), (2, 30, 0.05)) SELECT level, l_returnflag, count(*) AS n FROM lineitem JOIN l ON l_linestatus = 'F' AND l_quantity >= low AND l_discount >= share GROUP BY level, l_returnflag""")
def support_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that reach each of three nested levels."""
    x = projections.by_level(Tables(spark, sf_dir).lineitem, [(0, 0.0, 0.0), (1, 10.0, 0.02), (2, 30.0, 0.05)], F.col("l_quantity"), F.col("l_discount"), F.col("l_linestatus") == "F")
    return x.groupBy("level", "l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_custkey END AS chosen, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS body FROM orders""")
def feasibility_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column says whether a row is feasible, by whether it is judged for a body."""
    task = F.when(F.col("o_orderstatus") == "F", F.lit("b2")).otherwise(F.lit("c"))
    semantics = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("embodied"))
    body = projections.embodied(task, semantics, F.lit(None).cast("string"), F.lit(None).cast("double"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", projections.feasible(task == "b2", F.col("o_totalprice"), F.col("o_custkey").cast("double")).alias("chosen"), body.alias("body"))


@query("""WITH h AS (SELECT c_custkey, sha256('{"key":' || c_custkey || ',"nation":' || c_nationkey || '}') AS i, sha256('{"segment":"' || c_mktsegment || '"}') AS t, sha256(c_name) AS p FROM customer)
SELECT c_custkey, i AS identity_hash, t AS truth_hash, p AS prompt_hash, sha256(i || ':' || t || ':' || p) AS contract_hash FROM h""")
def contract_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of identity, answer, wording and the whole contract."""
    h = hashing.contract_hashes({"key": F.col("c_custkey"), "nation": F.col("c_nationkey")}, {"segment": F.col("c_mktsegment")}, F.col("c_name"))
    return Tables(spark, sf_dir).customer.select("c_custkey", *[v.alias(k) for k, v in h.items()])
