"""Question rows, repairs, audits and release runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.hashing import hash_bucket
from lodestar.operators import graph, release
from lodestar.plans.registry import Tables, query
from lodestar.plans.spaces import points
from lodestar.plans.texts import _pick


def _views(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("view"))


def _routes(t: Tables) -> DataFrame:
    """A supplier is a view of its nation, its parts in large orders are the route candidates."""
    lines = t.lineitem.filter("l_quantity >= 45").select(F.col("l_suppkey").alias("view"), F.col("l_partkey").alias("route")).distinct()
    return lines.join(_views(t), "view")


_TYPED = """
r AS (SELECT DISTINCT s_nationkey AS scene, l_suppkey AS view, l_partkey AS route FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45),
typed AS (SELECT s_nationkey AS scene, s_suppkey AS view, NULL::BIGINT AS route, unnest(['a1', 'b1']) AS task FROM supplier UNION ALL SELECT scene, view, route, unnest(['a2', 'b2', 'c']) FROM r),
q AS (SELECT *, task || '-' || scene || '-' || view || coalesce('-' || route, '') AS question_id FROM typed)
"""


@query(f"WITH {_TYPED} SELECT scene, view, route, task, question_id FROM q")
def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of question rows out of views and their route candidates."""
    t = Tables(spark, sf_dir)
    return release.typed_rows(_views(t), _routes(t), ["scene", "view"], "route", F.lit(True))


@query(f"""WITH {_TYPED}, x AS (SELECT *, CASE WHEN task IN ('a1', 'b1') THEN 'Mark what is free.' ELSE 'Go to part ' || route || '.' END AS prompt, CASE WHEN task IN ('a1', 'b1') THEN (view % 7)::VARCHAR ELSE (route % 11)::VARCHAR END AS answer FROM q),
j AS (SELECT *, CASE WHEN task IN ('a1', 'b1') THEN '{{"answer":"' || answer || '","view":' || view || '}}' ELSE '{{"answer":"' || answer || '","route":' || route || ',"view":' || view || '}}' END AS truth, '{{"question_id":"' || question_id || '","task":"' || task || '"}}' AS identity FROM x)
SELECT question_id, task, CASE WHEN task IN ('a1', 'b1') THEN 'set' ELSE 'route' END AS kind, prompt, answer, truth AS ground_truth, sha256(identity) AS identity_hash, sha256(truth) AS truth_hash, sha256(prompt) AS prompt_hash, sha256(sha256(identity) || ':' || sha256(truth) || ':' || sha256(prompt)) AS contract_hash FROM j""")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, answers, ground truth and digests of all questions, by kind."""
    t = Tables(spark, sf_dir)
    rows = release.typed_rows(_views(t), _routes(t), ["scene", "view"], "route", F.lit(True))
    text = lambda c, n: (F.col(c) % n).cast("string")
    kinds = {
        "set": (["a1", "b1"], F.lit("Mark what is free."), text("view", 7), ["view"]),
        "route": (["a2", "b2", "c"], F.concat(F.lit("Go to part "), F.col("route").cast("string"), F.lit(".")), text("route", 11), ["route", "view"]),
    }
    return release.question_rows(rows, ["question_id", "task"], kinds)


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE 'repaired' END AS st, ['relation', 'distance', NULL, 'side_only'][p_partkey % 4 + 1] AS fam, ['side', 'color', 'distance_rank', NULL][p_partkey % 5 % 4 + 1] AS typ, ['color_and_distance', 'category_only', NULL][p_partkey % 7 % 3 + 1] AS mode0, CASE WHEN p_partkey % 6 = 0 THEN 0.0 WHEN p_partkey % 6 = 1 THEN NULL ELSE (p_size % 10) / 5.0 END AS gap2 FROM part),
m AS (SELECT *, CASE WHEN st <> 'repaired' THEN coalesce(mode0, 'category_only') WHEN coalesce(fam = 'relation', false) OR coalesce(typ = 'side', false) THEN 'relation_only' WHEN coalesce(fam = 'distance', false) OR coalesce(typ = 'distance_rank', false) THEN 'distance_only' WHEN typ = 'color' THEN 'color_only' ELSE coalesce(mode0, 'category_only') END AS mode,
  coalesce(nullif(gap2, 0), nullif((s % 7) / 4.0, 0), 999) AS gap, greatest(s % 4, 1) AS n, s % 3 AS same, k % 4 AS other FROM x),
a AS (SELECT *, CASE WHEN mode = 'color_and_distance' OR gap < 0.4 OR n >= 3 OR same >= 2 OR (mode = 'color_only' AND other >= 2) THEN 'high' WHEN mode = 'category_only' OR (mode = 'distance_only' AND gap >= 0.8 AND n <= 1) THEN 'low' ELSE 'medium' END AS ref, ['low', 'medium', 'high'][k % 3 + 1] AS geo, ['low', 'medium'][k % 2 + 1] AS emb FROM m)
SELECT k AS p_partkey, mode, ref AS reference_axis, CASE WHEN 'high' IN (ref, geo, emb) OR (ref = 'medium')::INT + (geo = 'medium')::INT + (emb = 'medium')::INT >= 2 THEN 'hard' WHEN 'medium' IN (ref, geo, emb) THEN 'medium' ELSE 'easy' END AS tier FROM a""")
def resynced_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, reference axis and tier after prompts were repaired."""
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    gap = F.when(k % 6 == 0, 0.0).when(k % 6 != 1, (s % 10) / 5)
    rows = Tables(spark, sf_dir).part.select(
        "p_partkey", F.when(k % 3 == 0, F.lit("kept")).otherwise(F.lit("repaired")).alias("prompt_repair_status"), _pick(k, F.lit("relation"), F.lit("distance"), none, F.lit("side_only")).alias("cue_family"), _pick(k % 5, F.lit("side"), F.lit("color"), F.lit("distance_rank"), none).alias("cue_type"),
        _pick(k % 7, F.lit("color_and_distance"), F.lit("category_only"), none).alias("mode"), gap.alias("repaired_gap"), ((s % 7) / 4).alias("top2_gap"), (s % 4).alias("ambiguity"), (s % 3).alias("same_color"), (k % 4).alias("other_color"), _pick(k, "low", "medium", "high").alias("geometry_axis"), _pick(k, "low", "medium").alias("embodiment_axis"),
    )
    return release.resynced(rows).select("p_partkey", "mode", "reference_axis", "tier")


@query("""WITH c AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 END AS color, round(s_acctbal / 1000, 1) AS d FROM supplier),
w AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) - 1 AS rivals, count(*) OVER (PARTITION BY s_nationkey, color) - 1 AS same_color, row_number() OVER (PARTITION BY s_nationkey ORDER BY d, s_suppkey) AS place, least(lead(d) OVER (PARTITION BY s_nationkey ORDER BY d, s_suppkey) - d, d - lag(d) OVER (PARTITION BY s_nationkey ORDER BY d, s_suppkey)) AS gap FROM c),
q AS (SELECT *, CASE WHEN rivals = 0 THEN 'category' WHEN color IS NOT NULL AND same_color = 0 THEN 'color' WHEN gap >= 0.4 AND (place = 1 OR place = rivals + 1) THEN 'distance' END AS cue FROM w)
SELECT s_suppkey, rivals, same_color, round(gap, 6) AS gap, cue, CASE WHEN cue IS NULL THEN 'ambiguous' ELSE 'unique' END AS uniqueness, CASE WHEN cue = 'category' THEN 'aligned' WHEN cue IS NOT NULL THEN 'repaired' ELSE 'uncertain' END AS status FROM q""")
def truth_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, uniqueness, cue and status of each supplier among those of its nation, which are its rivals."""
    c = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 3).alias("color"), F.round(F.col("s_acctbal") / 1000, 1).alias("d"), F.lit(0).alias("category"))
    x = release.truth_repair(c, c, ["s_nationkey"], "s_suppkey", "category", "color", "d")
    return x.select("s_suppkey", "rivals", "same_color", F.round("gap", 6).alias("gap"), "cue", "uniqueness", "status")


@query("""WITH v AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS color FROM orders), g AS (SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderpriority END AS color FROM orders WHERE o_orderkey % 5 <> 0),
x AS (SELECT v.o_orderkey, coalesce(v.status, g.status) AS s2, coalesce(v.color, g.color) AS c2, v.status IS NULL OR v.color IS NULL AS lacked FROM v LEFT JOIN g ON v.o_orderkey = g.o_orderkey)
SELECT o_orderkey, s2 AS status, c2 AS color, CASE WHEN s2 IS NULL OR c2 IS NULL THEN 'incomplete' WHEN lacked THEN 'hydrated' ELSE 'kept' END AS hydration, o_orderkey % 7 = 1 AS cue_unique FROM x""")
def hydrated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose missing fields come from their candidate, and what became of them."""
    k = F.col("o_orderkey")
    orders = Tables(spark, sf_dir).orders
    rows = orders.select("o_orderkey", F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("color"))
    found = orders.filter(k % 5 != 0).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(k % 8 != 0, F.col("o_orderpriority")).alias("color"))
    return release.hydrated(rows, found, ["o_orderkey"], ["status", "color"], k % 7)


@query(f"""WITH {_TYPED}, bad AS (SELECT DISTINCT scene, view, route FROM q WHERE task IN ('a2', 'b2') AND (view * 3 + route + length(task || 'x') + CASE task WHEN 'b2' THEN 1 ELSE 0 END) % 17 = 0),
k AS (SELECT q.* FROM q LEFT JOIN bad ON q.scene = bad.scene AND q.view = bad.view AND q.route = bad.route WHERE bad.view IS NULL OR task NOT IN ('a2', 'b2'))
SELECT task, count(*) AS questions, count(DISTINCT view) AS views, round(avg((view % 3 = 0)::INT), 6) AS rate, round(avg((view % 3 = 0)::INT), 6) - round((SELECT avg((view % 3 = 0)::INT) FROM q AS p WHERE p.task = k.task), 6) AS delta_rate FROM k GROUP BY task""")
def paired_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one row is bad go whole; counts and rates by task are measured again, with their change."""
    t = Tables(spark, sf_dir)
    rows = release.typed_rows(_views(t), _routes(t), ["scene", "view"], "route", F.lit(True)).withColumn("hit", F.col("view") % 3 == 0)
    bad = (F.col("view") * 3 + F.col("route") + 3 + (F.col("task") == "b2").cast("int")) % 17 == 0
    kept = release.paired_removal(rows, ["scene", "view", "route"], "task", ["a2", "b2"], bad)
    measured = lambda d: d.groupBy("task").agg(F.count("*").alias("questions"), F.countDistinct("view").alias("views"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))
    after = measured(kept)
    change = release.refreshed(measured(rows).select("task", "rate"), after, ["task"], ["rate"])
    return after.select("task", "questions", "views").join(change, "task")


@query("""WITH f AS (SELECT event_type AS evaluator, event_id % 4 = 0 AS legal, event_id % 6 = 0 AS solved, value > 20 AS valid, value > 60 AS success FROM events)
SELECT evaluator, count(*) AS all_n, round(avg(valid::INT), 6) AS all_valid, round(avg(success::INT), 6) AS all_success, sum(legal::INT)::BIGINT AS legal_n, round(sum((legal AND valid)::INT) / greatest(sum(legal::INT), 1), 6) AS legal_valid, round(sum((legal AND success)::INT) / greatest(sum(legal::INT), 1), 6) AS legal_success,
  sum(solved::INT)::BIGINT AS solved_n, round(sum((solved AND valid)::INT) / greatest(sum(solved::INT), 1), 6) AS solved_valid, round(sum((solved AND success)::INT) / greatest(sum(solved::INT), 1), 6) AS solved_success FROM f GROUP BY evaluator""")
def human_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates on all questions, on those that people answer legally, and on those that they solve."""
    k, v = F.col("event_id"), F.col("value")
    x = Tables(spark, sf_dir).events.withColumnRenamed("event_type", "evaluator")
    return release.by_subsets(x, "evaluator", {"all": F.lit(True), "legal": k % 4 == 0, "solved": k % 6 == 0}, {"valid": v > 20, "success": v > 60})


@query("""WITH r AS (SELECT o_orderstatus AS task, o_orderpriority AS run, avg((o_totalprice > 150000)::INT) AS p, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY p DESC, run) AS k FROM r) WHERE k = 1)
SELECT task, run, round(p, 6) AS p, n, round(greatest(0, least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n))), 6) AS low, round(greatest(0, least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n))), 6) AS high FROM b""")
def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of each task with the interval of its rate."""
    rates = Tables(spark, sf_dir).orders.groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("run")).agg(F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("p"), F.count("*").alias("n"))
    return release.best_with_interval(rates, "task", "run", "p", "n")


@query("""WITH a AS (SELECT DISTINCT lower(p_type) AS alias, split_part(lower(p_type), ' ', 1) AS canonical, CASE WHEN p_size % 2 = 0 THEN 'even' END AS grp FROM part WHERE p_type LIKE '%S%'),
one AS (SELECT alias, min(canonical) AS canonical FROM a GROUP BY alias)
SELECT p_partkey, coalesce(one.canonical, lower(p_type)) AS canonical, coalesce(one.canonical, lower(p_type)) AS semantic_group, CASE WHEN one.alias IS NULL THEN 'other' ELSE 'metal' END AS slot, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AS reused,
  CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN 'Look for a seat' WHEN one.alias IS NULL THEN 'Use the other.' ELSE 'Use metal.' END AS prompt FROM part LEFT JOIN one ON lower(p_type) = one.alias""")
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical categories, their prompt slots, and old prompts where they may be used again."""
    k = F.col("p_partkey")
    part = Tables(spark, sf_dir).part
    none = F.lit(None).cast("string")
    aliases = part.filter(F.contains("p_type", F.lit("S"))).select(F.col("p_type").alias("alias"), F.substring_index(F.lower("p_type"), " ", 1).alias("canonical"), none.alias("semantic_group")).distinct()
    old = F.when(k % 3 == 0, F.lit("Go to display id: 4")).when(k % 4 == 0, F.lit("Sit on the target now")).when(k % 5 == 0, none).otherwise(F.lit("Look for a seat"))
    named = release.canonical_category(part.select("p_partkey", "p_type", F.lit("Rest").alias("family"), old.alias("old")), aliases, "p_type")
    exact = aliases.select(F.lit("rest").alias("family"), F.col("alias").alias("category"), F.lit("metal").alias("slot"), F.lit("Use metal.").alias("text"))
    default = spark.range(1).select(F.lit("rest").alias("family"), none.alias("category"), F.lit("other").alias("slot"), F.lit("Use the other.").alias("text"))
    x = release.prompt_slots(named, exact.unionByName(default), "family", "p_type", "old", ["the target"])
    return x.select("p_partkey", "canonical", "semantic_group", "slot", "reused", "prompt")


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 AS uncertain FROM orders""")
def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain rows with their approval; one without would stop the read."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", (F.col("o_orderkey") % 4 == 0).alias("uncertain"))
    records = orders.filter("uncertain").select("o_orderkey", F.lit("approved").alias("status"), F.lit("unique").alias("resolution"))
    return release.adjudicated(orders, records, "o_orderkey", F.col("uncertain"))


@query("""WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS path FROM lineitem GROUP BY l_orderkey), v AS (SELECT l_orderkey, list_filter(path, lambda x: x % 3 <> 0) AS p FROM l),
d AS (SELECT l_orderkey, list_filter(p, lambda x, i: list_position(p, x) = i) AS u FROM v)
SELECT l_orderkey, CASE WHEN len(u) >= 2 THEN array_to_string(u, ',') END AS visible FROM d""")
def visible_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes over visible suppliers, each where it occurs first."""
    paths = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x.l_suppkey).alias("path"))
    visible = F.filter("path", lambda x: x % 3 != 0)
    return paths.select("l_orderkey", F.array_join(release.visible_path(F.col("path"), visible).cast("array<string>"), ",").alias("visible"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal AS x, unnest([c_custkey % 10 + 1, c_custkey % 7 + 1, c_custkey % 3 + 1]) AS id, unnest([0, 1, 2]) AS place FROM customer), d AS (SELECT c_custkey, id, place, abs(s_acctbal - x) AS distance FROM p JOIN supplier ON id = s_suppkey)
SELECT c_custkey, id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(distance / 1e-6), place, id) AS n FROM d) WHERE n = 1""")
def endpoint_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a path's ids, else of its fallback's, to each endpoint."""
    t = Tables(spark, sf_dir)
    one = lambda n: F.col("c_custkey") % n + 1
    paths = t.customer.select("c_custkey", F.col("c_acctbal").alias("x"), F.lit(0.0).alias("y"), F.array(one(10), one(7)).alias("primary"), F.array(one(3)).alias("fallback"))
    at = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return release.endpoint_anchor(paths, at, "c_custkey").withColumn("distance", F.round("distance", 4))


@query("""WITH x AS (SELECT o_orderkey AS k, ['a1', 'b1', 'a2', 'b2', 'c'][o_orderkey % 5 + 1] AS task, [o_orderkey % 7, 9] AS ans FROM orders), y AS (SELECT *, task IN ('a2', 'b2', 'c') AS route, CASE WHEN task IN ('b1', 'b2', 'c') THEN 'A body has to fit.' ELSE 'A point is enough.' END AS body, list_filter([1, 2, 9], lambda v: NOT list_contains(ans, v)) AS rest FROM x)
SELECT k AS o_orderkey, CASE WHEN route THEN body || ' The route goes from ' || k % 7 || ' to 9 in 1 hops over ' || printf('%.2f', (k % 4) + 0.5) || ' m.' ELSE body || ' 2 points qualify. Blocked: [' || array_to_string(rest, ', ') || '].' END || chr(10) || '[' || array_to_string(ans, ', ') || ']' AS said,
  '{"task":"' || task || '","body":"' || CASE WHEN task IN ('b1', 'b2', 'c') THEN 'embodied' ELSE 'point' END || '"' || CASE WHEN route THEN ',"start":' || k % 7 || ',"hops":1' ELSE '' END || '}' AS public FROM y""")
def rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact packets as sentences, and what of them may be shown."""
    k = F.col("o_orderkey")
    long = lambda *v: F.array(*[F.lit(x).cast("long") if isinstance(x, int) else x for x in v])
    packet = release.fact_packet(_pick(k, "a1", "b1", "a2", "b2", "c"), long(k % 7, 9), long(1, 2, 9), k % 7, F.lit(9).cast("long"), k % 4 + 0.5)
    return Tables(spark, sf_dir).orders.select("o_orderkey", packet.alias("p")).select("o_orderkey", release.rationale(F.col("p")).alias("said"), F.to_json(release.public_packet(F.col("p"))).alias("public"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 200 THEN 'drop' WHEN contains(lower(text), 'password') THEN 'drop' WHEN lang IS NULL THEN 'drop' ELSE 'pass' END AS status, CASE WHEN text IS NULL OR length(text) < 200 THEN 'too_short' WHEN contains(lower(text), 'password') THEN 'names_secret' WHEN lang IS NULL THEN 'no_language' END AS reason FROM documents""")
def surface_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts keep their contract, and the first check that they fail."""
    t = F.col("text")
    found = release.surface_contract([("too_short", F.char_length(t) >= 200), ("names_secret", ~F.contains(F.lower(t), F.lit("password"))), ("no_language", F.col("lang").isNotNull())])
    return Tables(spark, sf_dir).documents.select("doc_id", found["status"].alias("status"), found["reason"].alias("reason"))


@query("""WITH b AS (SELECT *, ('0x' || right(sha256(source), 2))::BIGINT % 32 AS h FROM documents WHERE n_chars >= 1000), r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM b)
SELECT CASE WHEN h < 4 THEN 'benchmark' WHEN h < 8 THEN 'validation' ELSE 'train' END AS split, count(*) AS questions, count(DISTINCT source) AS sources, sum((lang IS NOT NULL AND n_chars <= 5000)::INT)::BIGINT AS eligible FROM r WHERE n <= 20 GROUP BY split""")
def release_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release: long documents are mined, the twenty longest of each bundle selected, split by source and validated."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "source", "lang", "n_chars")
    bucket = hash_bucket(F.col("source"))
    split = F.when(bucket < 4, F.lit("benchmark")).when(bucket < 8, F.lit("validation")).otherwise(F.lit("train"))
    rows = release.released(docs, F.col("n_chars") >= 1000, "source", split, {"has_language": F.col("lang").isNotNull(), "not_too_long": F.col("n_chars") <= 5000}, 20, ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")])
    return rows.groupBy("split").agg(F.count("*").alias("questions"), F.countDistinct("source").alias("sources"), F.sum(F.col("eligible").cast("long")).alias("eligible"))


@query("""WITH c AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 AS color, round(s_acctbal / 1000, 1) AS d FROM supplier),
w AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) - 1 AS rivals, count(*) OVER (PARTITION BY s_nationkey, color) - 1 AS same_color, row_number() OVER (PARTITION BY s_nationkey ORDER BY d, s_suppkey) AS place, least(lead(d) OVER (PARTITION BY s_nationkey ORDER BY d, s_suppkey) - d, d - lag(d) OVER (PARTITION BY s_nationkey ORDER BY d, s_suppkey)) AS gap FROM c),
q AS (SELECT *, CASE WHEN rivals = 0 THEN 'category' WHEN same_color = 0 THEN 'color' WHEN gap >= 0.4 AND (place = 1 OR place = rivals + 1) THEN 'distance' END AS cue FROM w)
SELECT CASE s_nationkey % 3 WHEN 0 THEN 'sit' ELSE 'store' END AS family, cue, count(*) AS n FROM q WHERE cue IS NOT NULL AND s_nationkey % 3 <> 2 GROUP BY family, cue""")
def intent_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent rows out of embodied ones with a unique cue, counted by family and cue."""
    c = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 3).alias("color"), F.round(F.col("s_acctbal") / 1000, 1).alias("d"), F.lit(0).alias("category"))
    repair = release.truth_repair(c, c, ["s_nationkey"], "s_suppkey", "category", "color", "d")
    family = F.when(F.col("s_nationkey") % 3 == 0, F.lit("sit")).when(F.col("s_nationkey") % 3 == 1, F.lit("store"))
    rows = release.intent_rows(c.select("s_nationkey", "s_suppkey"), repair, ["s_nationkey", "s_suppkey"], family)
    return rows.groupBy("family", "cue").agg(F.count("*").alias("n"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 24 by 24 cells for each label; a cell with a point is occupied."""
    p = points(spark, sf_dir)
    cell = lambda c: F.pmod(F.floor(F.col(c) * 40), F.lit(24)).cast("long")
    taken = p.select("label", cell("x").alias("gx"), cell("y").alias("gy")).distinct().withColumn("occupied", F.lit(True))
    domain = p.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("gx")).select("label", "gx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("gy"))
    return domain.join(taken, ["label", "gx", "gy"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))


_GRID_SQL = """
pt AS (SELECT label, ((floor(embedding[1]::DOUBLE * 40)::BIGINT % 24) + 24) % 24 AS gx, ((floor(embedding[2]::DOUBLE * 40)::BIGINT % 24) + 24) % 24 AS gy FROM embeddings),
taken AS (SELECT DISTINCT label, gx, gy FROM pt), dom AS (SELECT label, gx, gy FROM (SELECT DISTINCT label FROM pt), (SELECT unnest(range(24)) AS gx), (SELECT unnest(range(24)) AS gy)),
cells AS (SELECT d.label, d.gx, d.gy, t.label IS NOT NULL AS occupied FROM dom AS d LEFT JOIN taken AS t ON d.label = t.label AND d.gx = t.gx AND d.gy = t.gy)
"""


@query(f"""WITH {_GRID_SQL}, d AS (SELECT a.label, a.gx, a.gy, min(sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy))) AS clearance FROM cells AS a LEFT JOIN cells AS b ON a.label = b.label AND b.occupied AND abs(a.gx - b.gx) <= 4 AND abs(a.gy - b.gy) <= 4 AND (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) <= 16 WHERE NOT a.occupied GROUP BY ALL)
SELECT label, gx, gy, round(clearance, 6) AS clearance FROM d""")
def clearance_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each free cell's distance to the nearest occupied one, up to four cells."""
    x = graph.distance_field(_grid(spark, sf_dir), ["label"], 4)
    return x.select("label", "gx", "gy", F.round("clearance", 6).alias("clearance"))


@query(f"""WITH RECURSIVE {_GRID_SQL}, free AS (SELECT label, gx, gy FROM cells WHERE NOT occupied), s AS (SELECT label, min(gx * 100 + gy) AS k FROM free GROUP BY label),
r(label, gx, gy) AS (SELECT label, k // 100, k % 100 FROM s UNION SELECT f.label, f.gx, f.gy FROM r JOIN free AS f ON r.label = f.label AND abs(r.gx - f.gx) + abs(r.gy - f.gy) = 1)
SELECT label, count(*) AS reachable FROM r GROUP BY label""")
def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells can be reached from the first free one."""
    start = _grid(spark, sf_dir).filter("NOT occupied").groupBy("label").agg(F.min(F.struct("gx", "gy")).alias("s"))
    asked = start.select("label", F.lit(1).cast("long").alias("question_id"), F.col("s.gx").alias("sx"), F.col("s.gy").alias("sy"), F.col("s.gx").alias("gx"), F.col("s.gy").alias("gy"))
    return graph.grid_routes(_grid(spark, sf_dir), asked, "label").select("label", "reachable")


@query(f"""WITH {_GRID_SQL}, b AS (SELECT label, gx, gy FROM cells WHERE gx > 0 AND gy > 0 AND gx < 23 AND gy < 23 AND occupied)
SELECT b.label, b.gx, b.gy FROM b JOIN cells AS c ON b.label = c.label AND abs(b.gx - c.gx) <= 1 AND abs(b.gy - c.gy) <= 1 AND (b.gx <> c.gx OR b.gy <> c.gy) GROUP BY ALL HAVING sum(c.occupied::INT) >= 2""")
def surface_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells inside a surface."""
    from lodestar.operators import selection

    return selection.blocked_inside(_grid(spark, sf_dir), ["label"], 2)


@query()
def navigation_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways, directions and clearances between the corners of each grid."""
    asked = points(spark, sf_dir).select("label").distinct().select("label", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2)])).alias("question_id"))
    asked = asked.select("label", "question_id", F.lit(0).alias("sx"), F.lit(0).alias("sy"), F.when(F.col("question_id") == 1, 23).otherwise(0).alias("tx"), F.lit(23).alias("ty"), F.lit(0.0).alias("yaw"))
    x = graph.navigation_truth(_grid(spark, sf_dir), asked, "label")
    return x.select("label", "question_id", F.size("path").alias("points"), F.round("length", 4).alias("length"), F.array_join("directions", " ").alias("directions"), F.round(F.array_min("clearances"), 4).alias("least_clearance"))
