"""Route scoring over the driver's tables.

A question is an order, its answer the suppliers of its lines in line order, a run the order's
priority, a task its status.  Two different suppliers of one region are joined by an edge as long as
their balances differ.  A route must end in the region of the order's customer.  Orders divisible by
13 have no readable answer, those by 11 name an unknown id, those by 7 start at the wrong place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import scoring, sets
from lodestar.operators.joins import hop_sums, hops
from lodestar.plans.registry import Tables, query

ROUTE_SQL = """
sup AS (SELECT s_suppkey, n_regionkey AS region, s_acctbal AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
li AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
  lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem),
hop AS (SELECT li.*, CASE WHEN l_suppkey <> nxt AND a.region = b.region THEN round(abs(a.bal - b.bal), 2) END AS distance FROM li JOIN sup AS a ON l_suppkey = a.s_suppkey LEFT JOIN sup AS b ON nxt = b.s_suppkey),
per AS (SELECT l_orderkey, count(*) AS n, count(nxt) AS hops, count(distance) AS legal_hops, max(CASE WHEN pos = 1 AND distance IS NOT NULL THEN 1 ELSE 0 END) AS first_legal, sum(distance) AS length,
  min_by(l_suppkey, pos) AS first_sup, max_by(l_suppkey, pos) AS last_sup FROM hop GROUP BY l_orderkey),
q AS (SELECT l_orderkey AS question_id, o_orderpriority AS run, o_orderstatus AS task, n, hops, legal_hops, first_legal, coalesce(length, 0) AS length, round(abs(a.bal - b.bal), 2) AS optimal,
  l_orderkey % 13 <> 0 AS parsed, l_orderkey % 13 <> 0 AND l_orderkey % 11 <> 0 AS valid, b.region = n_regionkey AS at_goal
  FROM per JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN sup AS a ON first_sup = a.s_suppkey JOIN sup AS b ON last_sup = b.s_suppkey),
f AS (SELECT *, valid AND n >= 2 AND question_id % 7 <> 0 AS anchored FROM q),
g AS (SELECT *, anchored AND legal_hops = hops AS legal FROM f),
r AS (SELECT *, legal AND at_goal AS success FROM g),
t AS (SELECT *, CASE WHEN success THEN optimal / greatest(optimal, length) ELSE 0 END AS spl_part,
  CASE WHEN NOT parsed THEN 'format' WHEN NOT valid THEN 'invalid_id' WHEN NOT anchored THEN 'wrong_start' WHEN NOT legal THEN 'illegal_edge' WHEN NOT success THEN 'wrong_goal' WHEN length > optimal + 0.001 THEN 'non_shortest' ELSE 'shortest' END AS stage FROM r)
"""


def suppliers(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").alias("region"))
    return t.supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "region", F.col("s_acctbal").alias("bal"))


def walked(t: Tables) -> DataFrame:
    """(question_id, path, hops, legal_hops, first_legal, length, and supplier, region and balance of both ends).

    Whether a hop is legal follows from its two suppliers, so no table of edges is formed.  A line
    takes its supplier's facts before it meets the next line of its order, so lines are joined once;
    the rows are dealt by order once, for the window and the aggregate.  No array is on a row of a hop.
    """
    known = suppliers(t).select(F.col("s_suppkey").alias("l_suppkey"), "region", "bal")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(known, "l_suppkey", "left")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    ahead = lambda c: F.lead(c).over(w)
    x = lines.select(F.col("l_orderkey").alias("question_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_suppkey").alias("src"), "region", "bal", ahead("l_suppkey").alias("dst"), ahead("region").alias("dst_region"), ahead("bal").alias("dst_bal"))
    legal = (F.col("src") != F.col("dst")) & (F.col("region") == F.col("dst_region"))
    x = x.withColumn("distance", F.when(legal, F.round(F.abs(F.col("bal") - F.col("dst_bal")), 2)))
    ends = [f(F.struct("src", "region", "bal"), "pos").alias(name) for f, name in ((F.min_by, "first"), (F.max_by, "last"))]
    path = F.transform(F.array_sort(F.collect_list(F.struct("pos", "src"))), lambda p: p.src)
    per = x.groupBy("question_id").agg(path.alias("path"), *hop_sums(), *ends)
    return per.select("question_id", "path", "hops", "legal_hops", "first_legal", "length", *[F.col(f"{e}.{c}").alias(f"{e}_{n}") for e in ("first", "last") for c, n in (("src", "sup"), ("region", "region"), ("bal", "bal"))])


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question with all gates."""
    t = Tables(spark, sf_dir)
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("home"))
    asked = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), "c_nationkey")
    asked = asked.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("task"), "home")
    x = walked(t).join(asked, "question_id").filter("first_region IS NOT NULL AND last_region IS NOT NULL")
    odd = lambda n: F.col("question_id") % n == 0
    empty = F.array().cast("array<bigint>")
    x = x.withColumns(
        {
            "n": F.size("path").cast("long"),
            "visible": F.when(odd(11), F.filter("path", lambda p: p < 0)).otherwise(F.col("path")),
            "start": F.when(odd(7), F.lit(-1).cast("long")).otherwise(F.col("first_sup")),
            "goals": F.when(F.col("last_region") == F.col("home"), F.array("last_sup")).otherwise(empty),
            "optimal": F.round(F.abs(F.col("first_bal") - F.col("last_bal")), 2),
            "length": F.coalesce("length", F.lit(0.0)),
        }
    )
    x = x.withColumn("path", F.when(odd(13), F.lit(None).cast("array<bigint>")).otherwise(F.col("path")))
    return scoring.route_flags(x).withColumn("stage", scoring.failure_stage())


@query(f"""WITH {ROUTE_SQL}
SELECT run, count(*) AS questions, round(avg(parsed::INT), 4) AS parse_rate, round(avg(valid::INT), 4) AS valid_rate, round(avg(legal::INT), 4) AS legal_rate, round(avg(success::INT), 4) AS success_rate,
  round(sum(spl_part) / greatest(sum(success::INT), 1), 4) AS spl, round(sum(spl_part) / count(*), 4) AS spl_all FROM t GROUP BY run""")
def route_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate rates and path efficiency of each run."""
    return scoring.route_metrics(flagged(spark, sf_dir), ["run"])


@query(f"WITH {ROUTE_SQL} SELECT run, task, stage, count(*) AS n FROM t GROUP BY run, task, stage")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions fail first at each stage."""
    return flagged(spark, sf_dir).groupBy("run", "task", "stage").agg(F.count("*").alias("n"))


@query(f"""WITH {ROUTE_SQL}
SELECT task, run, count(*) AS questions, sum(valid::INT)::BIGINT AS valid, sum(legal::INT)::BIGINT AS legal, sum(success::INT)::BIGINT AS success FROM t GROUP BY task, run
UNION ALL SELECT task, 'all', count(*), sum(valid::INT)::BIGINT, sum(legal::INT)::BIGINT, sum(success::INT)::BIGINT FROM t GROUP BY task""")
def failure_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each task and run, and pooled over runs."""
    one = lambda c: F.sum(F.col(c).cast("int")).alias(c)
    return scoring.pooled(flagged(spark, sf_dir), ["task", "run"], [F.count("*").alias("questions"), one("valid"), one("legal"), one("success")])


@query(f"""WITH {ROUTE_SQL}
SELECT run, CASE WHEN hops = 1 THEN '1' WHEN hops = 2 THEN '2' ELSE '3+' END AS stratum, count(*) AS questions, round(avg(legal::INT), 6) AS legal_rate, round(avg(success::INT), 6) AS success_rate FROM t GROUP BY run, stratum""")
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by the number of hops; none falls into the last stratum."""
    bucket = F.when(F.col("hops") == 1, F.lit("1")).when(F.col("hops") == 2, F.lit("2")).otherwise(F.lit("3+"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return flagged(spark, sf_dir).groupBy("run", bucket.alias("stratum")).agg(F.count("*").alias("questions"), rate("legal").alias("legal_rate"), rate("success").alias("success_rate"))


@query(f"""WITH {ROUTE_SQL},
p AS (SELECT *, hops > 0 AS eligible, hops > 0 AND first_legal = 1 AS fl, hops > 0 AND legal_hops = hops AS al FROM t)
SELECT task, run, sum(eligible::INT)::BIGINT AS eligible, sum(fl::INT)::BIGINT AS first_legal, sum(al::INT)::BIGINT AS all_legal, sum((fl AND NOT al)::INT)::BIGINT AS illegal_suffix, round(sum((fl AND NOT al)::INT) / greatest(sum(fl::INT), 1), 6) AS suffix_rate FROM p GROUP BY task, run
UNION ALL SELECT task, 'all', sum(eligible::INT)::BIGINT, sum(fl::INT)::BIGINT, sum(al::INT)::BIGINT, sum((fl AND NOT al)::INT)::BIGINT, round(sum((fl AND NOT al)::INT) / greatest(sum(fl::INT), 1), 6) FROM p GROUP BY task""")
def prefix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes whose first hop is legal but whose rest is not."""
    x = flagged(spark, sf_dir)
    eligible = F.col("hops") > 0
    first, every = eligible & (F.col("first_legal") == 1), eligible & (F.col("legal_hops") == F.col("hops"))
    count = lambda c: F.sum(c.cast("int"))
    return scoring.pooled(x, ["task", "run"], [count(eligible).alias("eligible"), count(first).alias("first_legal"), count(every).alias("all_legal"), count(first & ~every).alias("illegal_suffix"), F.round(count(first & ~every) / F.greatest(count(first), F.lit(1)), 6).alias("suffix_rate")])


@query(f"""WITH {ROUTE_SQL},
m AS (SELECT o_orderstatus AS task, quantile_cont(n::DOUBLE, 0.5) AS med FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus)
SELECT t.task, n > med AS heavy, count(*) AS questions, round(avg((first_legal = 1 AND at_goal)::INT), 6) AS anchored_rate, round(sum((first_legal = 1 AND at_goal AND legal_hops < hops)::INT) / greatest(sum((first_legal = 1 AND at_goal)::INT), 1), 6) AS suffix_failure FROM t JOIN m ON t.task = m.task GROUP BY t.task, heavy""")
def construct_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored answers (first hop legal, goal hit) and their illegal middles, by load above or up to the task's median."""
    t = Tables(spark, sf_dir)
    loads = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("task")), F.col("l_orderkey") == F.col("o_orderkey"))
    x = flagged(spark, sf_dir).join(loads.groupBy("task").agg(F.percentile("n", F.lit(0.5)).alias("med")), "task")
    anchored = (F.col("first_legal") == 1) & (F.size("goals") > 0)
    failing = anchored & (F.col("legal_hops") < F.col("hops"))
    count = lambda c: F.sum(c.cast("int"))
    return x.groupBy("task", (F.col("n") > F.col("med")).alias("heavy")).agg(F.count("*").alias("questions"), F.round(F.avg(anchored.cast("int")), 6).alias("anchored_rate"), F.round(count(failing) / F.greatest(count(anchored), F.lit(1)), 6).alias("suffix_failure"))


@query(f"""WITH {ROUTE_SQL},
m AS (SELECT run, task, avg(success::INT) AS sr, avg(legal::INT) AS lr, avg(valid::INT) AS vr FROM t GROUP BY run, task),
p AS (SELECT run, max(CASE WHEN task = 'F' THEN vr END) AS a, max(CASE WHEN task = 'O' THEN vr END) AS b, max(CASE WHEN task = 'F' THEN sr END) AS c, max(CASE WHEN task = 'O' THEN sr END) AS d, max(CASE WHEN task = 'P' THEN sr END) AS e FROM m GROUP BY run),
s AS (SELECT run, round(((2 * a - 1) + (2 * b - 1) + c + d + e) / 5, 6) AS score FROM p)
SELECT run, score, row_number() OVER (ORDER BY score DESC, run) AS place, score = max(score) OVER () AS best_score FROM s""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite score of each run, its place, and whether it is the best."""
    per = flagged(spark, sf_dir).groupBy("run").pivot("task", ["F", "O", "P"]).agg(F.avg(F.col("valid").cast("int")).alias("v"), F.avg(F.col("success").cast("int")).alias("s"))
    c = F.col
    score = F.round(scoring.composite([c("F_v"), c("O_v")], [c("F_s"), c("O_s"), c("P_s")]), 6)
    scored = per.select("run", score.alias("score"))
    best = scoring.best_in_column(scored, ["score"])
    return scoring.ranked(best, "score", ["run"]).select("run", "score", "place", "best_score")


@query(f"""WITH {ROUTE_SQL},
m AS (SELECT run, task, round(avg(success::INT), 4) AS sr, round(avg(legal::INT), 4) AS lr FROM t GROUP BY run, task)
SELECT run, round(avg(sr), 4) AS success_rate, round(avg(lr), 4) AS legal_rate FROM m GROUP BY run""")
def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scoring.route_metrics(flagged(spark, sf_dir), ["run", "task"])
    return scoring.macro_means(per, ["run"], ["success_rate", "legal_rate"])


@query(f"""WITH {ROUTE_SQL},
m AS (SELECT run, task, round(avg(valid::INT), 4) AS valid_rate, round(avg(legal::INT), 4) AS legal_rate FROM t GROUP BY run, task),
d AS (SELECT a.task, round(a.valid_rate - b.valid_rate, 6) AS delta_valid_rate, round(a.legal_rate - b.legal_rate, 6) AS delta_legal_rate FROM m AS a JOIN m AS b ON a.task = b.task WHERE a.run = '1-URGENT' AND b.run = '5-LOW')
SELECT *, array_to_string(list_filter([CASE WHEN delta_valid_rate >= 0.01 THEN NULL ELSE 'valid_rate' END, CASE WHEN delta_legal_rate >= 0.001 THEN NULL ELSE 'legal_rate' END], lambda x: x IS NOT NULL), ',') AS failing, delta_valid_rate >= 0.01 AND delta_legal_rate >= 0.001 AS passed FROM d""")
def cross_run_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric deltas between two runs and the gates that they miss."""
    from lodestar.operators.contracts import delta_gates

    per = scoring.route_metrics(flagged(spark, sf_dir), ["run", "task"])
    out = delta_gates(per.filter("run = '1-URGENT'"), per.filter("run = '5-LOW'"), "task", {"valid_rate": 0.01, "legal_rate": 0.001})
    return out.withColumn("failing", F.array_join("failing", ","))


@query(f"""WITH {ROUTE_SQL},
e AS (SELECT DISTINCT l_returnflag AS flag, least(l_suppkey, nxt) AS u, greatest(l_suppkey, nxt) AS v FROM (SELECT l_returnflag, l_orderkey, l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL),
x AS (SELECT coalesce(a.u, b.u) % 10 AS grp, a.u IS NULL OR b.u IS NULL AS flip FROM (SELECT * FROM e WHERE flag = 'A') AS a FULL JOIN (SELECT * FROM e WHERE flag = 'R') AS b ON a.u = b.u AND a.v = b.v)
SELECT grp, sum(flip::INT)::BIGINT AS flipped, count(*) AS either, round(sum(flip::INT) / count(*), 6) AS flip_rate FROM x GROUP BY grp""")
def edge_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected co-supplier edges under one return flag but not under another, by group of suppliers."""
    t = Tables(spark, sf_dir)
    lines = t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag", "l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x.l_suppkey).alias("path"))
    edges = sets.undirected_set(lines.select("l_returnflag", F.explode(hops(F.col("path"))).alias("h")).select("l_returnflag", "h.src", "h.dst"), ["l_returnflag"]).withColumn("grp", F.col("u") % 10)
    side = lambda flag: edges.filter(F.col("l_returnflag") == flag).select("grp", "u", "v")
    return sets.edge_flips(side("A"), side("R"), ["grp"])


@query(f"""WITH {ROUTE_SQL}, lv(level, low) AS (VALUES (0, 0), (1, 3), (2, 5))
SELECT task, level, count(*) AS questions, round(avg(legal::INT), 6) AS legal_rate, round(avg(success::INT), 6) AS success_rate FROM t JOIN lv ON n >= low GROUP BY task, level""")
def visibility_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the questions that pass each of three nested levels."""
    levels = spark.createDataFrame([(0, 0), (1, 3), (2, 5)], "level int, low int")
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    x = flagged(spark, sf_dir).join(F.broadcast(levels), F.col("n") >= F.col("low"))
    return x.groupBy("task", "level").agg(F.count("*").alias("questions"), rate("legal").alias("legal_rate"), rate("success").alias("success_rate"))


@query(f"""WITH {ROUTE_SQL}
SELECT task, run, round(avg(success::INT), 6) AS p, count(*) AS n,
  round(greatest(0, least(1, (avg(success::INT) + 1.96 * 1.96 / (2 * count(*))) / (1 + 1.96 * 1.96 / count(*)) - 1.96 * sqrt(avg(success::INT) * (1 - avg(success::INT)) / count(*) + 1.96 * 1.96 / (4.0 * count(*) * count(*))) / (1 + 1.96 * 1.96 / count(*)))), 6) AS low,
  round(greatest(0, least(1, (avg(success::INT) + 1.96 * 1.96 / (2 * count(*))) / (1 + 1.96 * 1.96 / count(*)) + 1.96 * sqrt(avg(success::INT) * (1 - avg(success::INT)) / count(*) + 1.96 * 1.96 / (4.0 * count(*) * count(*))) / (1 + 1.96 * 1.96 / count(*)))), 6) AS high FROM t GROUP BY task, run""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.functions.stats import wilson

    x = flagged(spark, sf_dir).groupBy("task", "run").agg(F.avg(F.col("success").cast("int")).alias("p"), F.count("*").alias("n"))
    low, high = wilson(F.col("p"), F.col("n"))
    return x.select("task", "run", F.round("p", 6).alias("p"), "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
