"""Files written to the shared folder and read back, so that SQL can state what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import contracts, graph, joins, spatial
from lodestar.plans.registry import Tables, query
from lodestar.plans.spaces import _NATIONS, _POINTS, _nation_edges, points
from lodestar.sources import readers, writers
from lodestar.sources.scratch import folder


@query("SELECT o_orderkey, o_orderstatus, o_totalprice::DOUBLE AS total, o_orderkey + 1 AS next FROM orders")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written and appended to, read by a glob with a schema, and once more as variants."""
    rows = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("total"))
    path = folder(spark, "lines")
    cheap = F.col("total") < 100_000
    writers.json_lines(rows.filter(cheap), path)
    writers.json_lines(rows.filter(~cheap), path, append=True)
    typed = readers.json_lines(spark, f"{path}/*.json", "o_orderkey long, o_orderstatus string, total double")
    loose = readers.variant_lines(spark, f"{path}/*.json").select(F.variant_get("row", "$.o_orderkey", "bigint").alias("o_orderkey"))
    return typed.join(loose, "o_orderkey").withColumn("next", F.col("o_orderkey") + 1)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables as one CSV with the union of their columns, read as strings."""
    t, path = Tables(spark, sf_dir), folder(spark, "csv")
    writers.csv_union([t.nation.select("n_nationkey", "n_name"), t.region.select("r_name")], path)
    return readers.csv_strings(spark, path)


@query("""WITH r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events) SELECT event_type AS task, (i // 500)::VARCHAR AS shard, count(*) AS n FROM r GROUP BY ALL""")
def task_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by task and shards of fixed size; task and shard come from the path."""
    path = folder(spark, "shards")
    writers.by_task_and_shard(Tables(spark, sf_dir).events.select("event_id", "event_type"), path, "event_type", ["event_id"], 500)
    back = readers.variant_lines(spark, f"{path}/*/*/*.json")
    return readers.with_path_parts(back, r"event_type=([^/]+)/shard=(\d+)/", ["task", "shard"]).groupBy("task", "shard").agg(F.count("*").alias("n"))


@query("SELECT event_type AS task, count(*) AS n, count(DISTINCT event_id) AS ids, min(event_id) AS first FROM events GROUP BY event_type")
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by task read as one table, a missing one left out; an id in two shards would be an error."""
    path = folder(spark, "tasks")
    events = Tables(spark, sf_dir).events.select("event_id", "event_type")
    writers.by_task(events, path, "event_type")
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a few names of folders
    found = readers.shards(spark, [f"{path}/event_type={k}" for k in [*kinds, "absent"]], "event_id long", "event_id")
    named = readers.with_path_parts(found, r"event_type=([^/]+)/", ["task"])
    return named.groupBy("task").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.min("event_id").alias("first"))


@query("""SELECT c_mktsegment AS split, c_custkey::VARCHAR AS name FROM customer""")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names by split."""
    path = folder(spark, "splits")
    writers.split_lists(Tables(spark, sf_dir).customer, path, "c_mktsegment", "c_custkey")
    return spark.read.text(path).select(F.col("c_mktsegment").alias("split"), F.col("value").alias("name"))


@query("SELECT 0::BIGINT AS mismatches, true AS tampered_found, (SELECT count(DISTINCT ('0x' || right(sha256(p_name), 2))::BIGINT % 32) FROM part) AS buckets, (SELECT count(*) FROM part) AS rows")
def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash buckets whose files agree with their manifest, and a manifest with a wrong digest, which doesn't."""
    path = folder(spark, "buckets")
    writers.hash_buckets(Tables(spark, sf_dir).part.select("p_partkey", "p_name"), path, "p_name")
    back = spark.read.json(path)
    listed = writers.file_manifest(spark, f"{path}/*/*.json")
    wrong = writers.manifest_mismatches(listed, listed.withColumn("sha256", F.lit("0"))).agg(F.count("*").alias("w"))
    counts = back.agg(F.countDistinct("bucket").alias("buckets"), F.count("*").alias("rows"))
    return writers.manifest_mismatches(listed, listed).agg(F.count("*").alias("mismatches")).crossJoin(wrong).crossJoin(counts).select("mismatches", (F.col("w") > 0).alias("tampered_found"), "buckets", "rows")  # each one row


@query("SELECT n_nationkey, n_name, 'new' AS version, n_regionkey FROM nation")
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document of all rows with a field of a struct patched, read as an array whose last row of a key wins."""
    path = folder(spark, "document")
    rows = Tables(spark, sf_dir).nation.select("n_nationkey", F.struct("n_name", F.lit("old").alias("version")).alias("meta"), "n_regionkey")
    writers.json_document(writers.patched(rows, "meta", {"version": F.lit("new"), "absent": F.lit(1)}), path)
    back = readers.json_array(spark, path, "n_nationkey long, meta struct<n_name:string,version:string>, n_regionkey long", "n_nationkey")
    return back.select("n_nationkey", "meta.n_name", "meta.version", "n_regionkey")


@query("SELECT s_nationkey::VARCHAR AS scene, s_suppkey AS display_id, s_suppkey * 10 AS waypoint_id, s_acctbal::DOUBLE AS x FROM supplier")
def view_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints of versioned view documents, one file each; the scene comes from the path."""
    path = folder(spark, "views")
    points_of = F.collect_list(F.struct(F.col("s_suppkey").alias("display_id"), (F.col("s_suppkey") * 10).alias("waypoint_id"), F.array(F.col("s_acctbal").cast("double"), F.lit(0.0), F.lit(0.0)).alias("world_xyz")))
    views = Tables(spark, sf_dir).supplier.groupBy(F.col("s_nationkey").alias("scene")).agg(points_of.alias("visible_waypoints"))
    views.select("scene", F.to_json(F.struct(F.lit("v3").alias("schema_version"), "visible_waypoints")).alias("value")).write.partitionBy("scene").text(path)
    docs = readers.whole_documents(spark, f"{path}/*/*.txt", "schema_version string").select("file", "doc.schema_version")
    current = readers.versioned(docs, "v3").select("file")
    found = readers.visible_waypoints(spark, f"{path}/*/*.txt").join(current, "file", "left_semi")
    return readers.with_path_parts(found, r"scene=(\d+)/", ["scene"]).select("scene", "display_id", "waypoint_id", F.get("world_xyz", F.lit(0)).alias("x"))


@query("""WITH s AS (SELECT s_nationkey AS view, s_suppkey AS src, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst, s_acctbal AS b, lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS b2 FROM supplier)
SELECT view, src, dst, round(CASE WHEN src % 3 = 0 THEN 1.5 ELSE abs(b::DOUBLE - b2::DOUBLE) END, 6) AS distance FROM s WHERE dst IS NOT NULL""")
def sidecar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of neighbour maps that are kept as a sidecar by view; a missing distance comes from the waypoints."""
    from pyspark.sql import Window

    s = Tables(spark, sf_dir).supplier.select(F.col("s_nationkey").alias("view"), "s_suppkey", F.col("s_acctbal").cast("double").alias("b"))
    ahead = F.lead("s_suppkey").over(Window.partitionBy("view").orderBy("s_suppkey"))
    each = s.withColumn("dst", ahead).filter("dst IS NOT NULL").select("view", F.create_map(F.col("s_suppkey").cast("string"), F.array(F.struct(F.col("dst").alias("display_id"), F.when(F.col("s_suppkey") % 3 == 0, 1.5).alias("distance_m")))).alias("neighbors"))
    path = folder(spark, "sidecar")
    for _ in range(2):  # the second call reads what the first has written
        kept = writers.cached(spark, path, lambda: each, ["view"], "neighbors map<string,array<struct<display_id:bigint,distance_m:double>>>, view long")
    places = s.select("view", F.col("s_suppkey").alias("display_id"), F.array("b", F.lit(0.0)).alias("world_xyz"))
    found = readers.direct_pairs(kept.select("view", "neighbors"), places.withColumn("view", F.col("view").cast("long")))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_NATIONS} SELECT DISTINCT s AS src, d AS dst, 1.0::DOUBLE AS distance FROM e""")
def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph whose edges have no length: each counts 1, in both directions."""
    each = _nation_edges(spark, sf_dir).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(None).cast("double").alias("distance"), F.monotonically_increasing_id().alias("p"))
    return readers.sparse_graph(each, [], "p")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/b/' || p_partkey || '.png' WHEN 1 THEN '/a/' || p_partkey || '.png' END AS path, CASE p_partkey % 3 WHEN 0 THEN '/new/' || p_partkey || '.png' END AS moved, 'bench' AS benchmark, 'B' AS gold_letter FROM part""")
def resolved_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets looked for under two folders in order, moved by prefix, and the rows in the common shape."""
    part = Tables(spark, sf_dir).part.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("ref"))
    k = F.col("p_partkey") % 3
    listed = lambda test, root: part.filter(test).select(F.concat(F.lit(root), F.col("ref")).alias("path"))
    known = listed(k < 2, "/b/").unionByName(listed(k == 1, "/a/"))
    found = part.join(readers.resolve(part.select("ref"), known, ["/a", "/b/"]), "ref")
    moved = writers.relocate(F.col("path"), "/b", "/new")
    shaped = readers.adapt(found.withColumn("moved", F.when(F.col("path").startswith("/b"), moved)), "bench", {"question_id": "p_partkey", "gold_letter": "'B'", "question": "path", "gold_text": "moved"})
    return shaped.select(F.col("question_id").alias("p_partkey"), F.col("question").alias("path"), F.col("gold_text").alias("moved"), "benchmark", "gold_letter")


@query(f"""WITH {_NATIONS}, w AS (SELECT s, d, min(w) AS w FROM e GROUP BY s, d), r AS (SELECT c_custkey, c_nationkey AS a, (c_nationkey + 1) % 25 AS b, (c_nationkey + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 4 END) % 25 AS c, (c_nationkey + 2) % 25 AS g FROM customer),
x AS (SELECT r.*, p.w AS w1, q.w AS w2 FROM r LEFT JOIN w AS p ON p.s = a AND p.d = b LEFT JOIN w AS q ON q.s = b AND q.d = c)
SELECT c_custkey, 2::BIGINT AS hops, ((w1 IS NOT NULL)::INT + (w2 IS NOT NULL)::INT)::BIGINT AS legal_hops, CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN w1 + w2 END AS length, c = g AS ends_in_goal, CASE WHEN w1 IS NULL OR w2 IS NULL THEN 'illegal_edge' WHEN c <> g THEN 'wrong_end' ELSE 'ok' END AS status FROM x""")
def reference_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference paths over a graph of nations: hops that are edges, length, and whether the end is a goal."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    at = lambda d: F.pmod(n + d, F.lit(25))
    routes = Tables(spark, sf_dir).customer.select("c_custkey", F.array(n, at(1), F.when(k % 2 == 0, at(2)).otherwise(at(4))).alias("path"), F.array(at(2)).alias("goals"))
    edges = _nation_edges(spark, sf_dir).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    return graph.reference_checks(routes, edges, ["c_custkey"])


@query(f"""WITH {_POINTS}, s AS (SELECT label, vec_id, x, y, greatest(ceil(sqrt(x * x + y * y) / 0.05)::INT, 1) AS n FROM pt), p AS (SELECT label, vec_id, i, x * i / n AS px, y * i / n AS py FROM (SELECT *, unnest(range(n + 1)) AS i FROM s)),
d AS (SELECT p.label, p.vec_id, p.i, q.vec_id AS id, round(sqrt((px - q.x) * (px - q.x) + (py - q.y) * (py - q.y)), 9) AS d FROM p JOIN pt AS q ON p.label = q.label AND sqrt((px - q.x) * (px - q.x) + (py - q.y) * (py - q.y)) <= 0.06),
b AS (SELECT label, vec_id, i, min_by(id, (d, id)) AS id FROM d GROUP BY ALL), r AS (SELECT *, lag(id) OVER (PARTITION BY label, vec_id ORDER BY i) AS before FROM b)
SELECT label, vec_id, array_to_string(list(id ORDER BY i), ',') AS ids FROM r WHERE id IS DISTINCT FROM before GROUP BY label, vec_id""")
def snapped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that the straight path from the origin to each point passes."""
    p = points(spark, sf_dir).select("label", "vec_id", "x", "y")
    paths = p.select("label", "vec_id", F.lit(0).alias("hop"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    found = spatial.snapped_paths(paths, points(spark, sf_dir).select("label", F.col("vec_id").alias("node"), "x", "y"), ["label"], "vec_id", "node", 0.05, 0.06)
    return found.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""WITH w(event_type, low, high) AS (VALUES ('view', 1, 1000000000), ('click', 0, 1), ('teleport', 0, 5)), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT w.event_type, coalesce(n, 0) AS n, low::BIGINT AS low, high::BIGINT AS high, coalesce(n, 0) BETWEEN low AND high AS inside FROM w LEFT JOIN c ON w.event_type = c.event_type""")
def window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against the windows that a release must keep."""
    counts = Tables(spark, sf_dir).events.groupBy("event_type").agg(F.count("*").alias("n"))
    return contracts.window_checks(counts, "event_type", "n", {"view": (1, 1_000_000_000), "click": (0, 1), "teleport": (0, 5)})


@query("""SELECT n_nationkey, r_name, n_regionkey % 2 = 0 AS even FROM nation JOIN region ON n_regionkey = r_regionkey""")
def category_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of nations; a nation in two would be an error."""
    t = Tables(spark, sf_dir)
    families = t.nation.select(F.col("n_nationkey").alias("category"), F.col("n_regionkey").alias("family"))
    once = contracts.require(families.join(joins.duplicate_keys(families, ["category"]).select("category", F.lit(True).alias("twice")), "category", "left"), {"a category has one family": F.col("twice").isNull()})
    return once.join(t.region, F.col("family") == F.col("r_regionkey")).select(F.col("category").alias("n_nationkey"), "r_name", (F.col("family") % 2 == 0).alias("even"))
