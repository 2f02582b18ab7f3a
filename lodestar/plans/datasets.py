"""Tiers, mining, splits, selection and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ladders, stats
from lodestar.functions.hashing import hash_bucket
from lodestar.operators import contracts, mining, selection, statistics
from lodestar.plans.registry import Tables, query

_AXES_SQL = """
a AS (SELECT p_partkey, p_brand, p_type, p_size / 10.0 AS len, 1 + (p_partkey % 40) / 100.0 AS det, (p_partkey % 5)::INT AS turns, (p_partkey % 3)::INT AS decs,
  CASE p_partkey % 5 WHEN 0 THEN 'category_only' WHEN 1 THEN 'color_only' WHEN 2 THEN 'relation_only' WHEN 3 THEN 'distance_only' ELSE 'color_and_distance' END AS mode, (p_size % 10) / 5.0 AS gap, (p_size % 4)::INT AS cohort, (p_size % 3)::INT AS same, (p_partkey % 4)::INT AS other,
  (p_partkey % 25) / 100.0 AS margin, (p_partkey % 9) / 50.0 AS goal, (p_partkey % 50) / 100.0 AS narrow, (p_size % 8) / 10.0 AS extra, (p_partkey % 3)::INT AS more, 0.4 + (p_partkey % 7) / 10.0 AS ovl FROM part),
l1 AS (SELECT *, CASE WHEN mode = 'color_and_distance' OR gap < 0.4 OR cohort >= 3 OR same >= 2 THEN 'high' WHEN mode = 'category_only' OR (mode IN ('distance_only', 'color_only') AND gap >= 0.8 AND cohort <= 1) THEN 'low' ELSE 'medium' END AS ref1,
  CASE WHEN mode = 'color_and_distance' OR gap < 0.4 OR cohort >= 3 OR same >= 2 OR (mode = 'color_only' AND other >= 2) THEN 'high' WHEN mode = 'category_only' OR (mode = 'distance_only' AND gap >= 0.8 AND cohort <= 1) THEN 'low' ELSE 'medium' END AS ref2,
  CASE WHEN len > 6 OR det > 1.35 OR turns >= 4 OR decs >= 3 THEN 'high' WHEN len <= 3 AND det <= 1.10 AND turns <= 1 AND decs <= 1 THEN 'low' ELSE 'medium' END AS geo1,
  CASE WHEN (turns >= 2 AND decs >= 1) OR (len > 3.5 AND det > 1.05 AND turns >= 1) THEN 'high' WHEN len <= 3 AND det <= 1.08 AND turns = 0 AND decs = 0 THEN 'low' ELSE 'medium' END AS geo2,
  CASE WHEN margin < 0.05 OR goal < 0.05 OR narrow > 0.35 OR extra > 1 OR more >= 2 OR ovl < 0.5 THEN 'high' WHEN margin >= 0.2 AND narrow <= 0.1 AND extra <= 0.3 AND more <= 0 AND ovl >= 0.85 THEN 'low' ELSE 'medium' END AS emb1,
  CASE WHEN (margin < 0.05 OR goal < 0.05 OR narrow > 0.35) AND (ovl < 0.5 OR extra > 0.6 OR more >= 1) THEN 'high' WHEN margin >= 0.07 AND goal >= 0.07 AND narrow <= 0.12 AND extra <= 0.3 AND more <= 0 AND ovl >= 0.9 THEN 'low' ELSE 'medium' END AS emb2 FROM a),
tiers AS (SELECT *, CASE WHEN 'high' IN (ref1, geo1, emb1) OR (ref1 = 'medium')::INT + (geo1 = 'medium')::INT + (emb1 = 'medium')::INT >= 2 THEN 'hard' WHEN (ref1 = 'medium')::INT + (geo1 = 'medium')::INT + (emb1 = 'medium')::INT = 1 THEN 'medium' ELSE 'easy' END AS tier1,
  CASE WHEN 'high' IN (ref2, geo2, emb2) OR (ref2 = 'medium')::INT + (geo2 = 'medium')::INT + (emb2 = 'medium')::INT >= 2 THEN 'hard' WHEN (ref2 = 'medium')::INT + (geo2 = 'medium')::INT + (emb2 = 'medium')::INT = 1 THEN 'medium' ELSE 'easy' END AS tier2 FROM l1),
scored AS (SELECT *, CASE WHEN tier2 = 'hard' AND mode <> 'category_only' AND ref2 <> 'low' AND geo2 <> 'low' THEN 60 * CASE geo2 WHEN 'high' THEN 2 ELSE 1 END + 8 * CASE ref2 WHEN 'high' THEN 2 ELSE 1 END + 5 * CASE mode WHEN 'distance_only' THEN 1 WHEN 'color_only' THEN 2 ELSE 3 END + 2 * CASE emb2 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN geo2 = 'high' THEN 20 ELSE 0 END ELSE 0 END AS score FROM tiers)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with scaled attributes in the place of difficulty measures, their levels, tiers and scores."""
    k, s = F.col("p_partkey"), F.col("p_size")
    modes = F.array(*map(F.lit, ("category_only", "color_only", "relation_only", "distance_only", "color_and_distance")))
    measures = {
        "len": s / 10, "det": 1 + (k % 40) / 100, "turns": (k % 5).cast("int"), "decs": (k % 3).cast("int"), "mode": F.get(modes, (k % 5).cast("int")), "gap": (s % 10) / 5, "cohort": s % 4, "same": s % 3, "other": (k % 4).cast("int"),
        "margin": (k % 25) / 100, "goal": (k % 9) / 50, "narrow": (k % 50) / 100, "extra": (s % 8) / 10, "more": (k % 3).cast("int"), "ovl": 0.4 + (k % 7) / 10,
    }
    x = Tables(spark, sf_dir).part.select("p_partkey", "p_brand", "p_type", *[v.alias(n) for n, v in measures.items()])
    c = F.col
    for v in (1, 2):
        policy = f"v{v}"
        x = x.withColumns(
            {
                f"ref{v}": ladders.reference_axis(c("mode"), c("gap"), c("cohort"), c("same"), c("other"), policy),
                f"geo{v}": ladders.geometry_axis(c("len"), c("det"), c("turns"), c("decs"), policy),
                f"emb{v}": ladders.embodiment_axis(c("margin"), c("goal"), c("narrow"), c("extra"), c("more"), c("ovl"), policy),
            }
        )
        x = x.withColumn(f"tier{v}", ladders.compose_tier(c(f"ref{v}"), c(f"geo{v}"), c(f"emb{v}")))
    return x.withColumn("score", ladders.navigation_hardness(F.lit("legal"), F.lit(True), c("tier2"), c("mode"), c("ref2"), c("geo2"), c("emb2"))["score"])


@query(f"WITH {_AXES_SQL} SELECT p_partkey, ref1, geo1, emb1, tier1, ref2, geo2, emb2, tier2 FROM tiers")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis levels and composed tiers under both policies."""
    return facts(spark, sf_dir).select("p_partkey", *[f"{a}{v}" for v in (1, 2) for a in ("ref", "geo", "emb", "tier")])


@query(f"""WITH {_AXES_SQL}, l(x) AS (VALUES ('low'), ('medium'), ('high')), d AS (SELECT a.x AS ref2, b.x AS geo2, c.x AS emb2 FROM l AS a, l AS b, l AS c)
SELECT d.ref2, d.geo2, d.emb2, count(p_partkey) AS n FROM d LEFT JOIN tiers AS t ON d.ref2 = t.ref2 AND d.geo2 = t.geo2 AND d.emb2 = t.emb2 GROUP BY d.ref2, d.geo2, d.emb2""")
def tier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 27 combinations of levels with their counts."""
    return mining.cell_table(facts(spark, sf_dir), ["ref2", "geo2", "emb2"], ["low", "medium", "high"])


@query(f"""WITH {_AXES_SQL}, x AS (SELECT unnest(['ref', 'geo', 'emb']) AS axis, unnest([ref2, geo2, emb2]) AS level FROM tiers), c AS (SELECT axis, level, count(*) AS n FROM x GROUP BY axis, level)
SELECT axis, level, n, round(n / sum(n) OVER (PARTITION BY axis), 6) AS share FROM c""")
def axis_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = facts(spark, sf_dir).select(*[F.col(f"{a}2").alias(a) for a in ("ref", "geo", "emb")])
    return mining.axis_shares(x, ["ref", "geo", "emb"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {_AXES_SQL}, b AS (SELECT p_brand, p_type, max(score) AS score, count(*) AS parts FROM scored GROUP BY p_brand, p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_type) AS place FROM b)
SELECT p_brand, p_type, score, parts, place FROM r WHERE place <= CASE WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 5 ELSE 2 END AND p_brand IN (SELECT DISTINCT p_brand FROM part)""")
def hard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest bundles of each brand, up to its cap."""
    x = facts(spark, sf_dir).groupBy("p_brand", "p_type").agg(F.max("score").alias("score"), F.count("*").alias("parts"))
    caps = Tables(spark, sf_dir).part.select("p_brand").distinct().withColumn("cap", F.when(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), 5).otherwise(2))
    return selection.capped_top(x, "p_brand", [F.col("score").desc(), F.col("p_type")], caps)


@query(f"""WITH {_AXES_SQL} SELECT p_brand, count(*) AS questions, count(DISTINCT p_type) AS bundles, count(DISTINCT tier2) AS kinds, round(avg(score), 3) AS mean_score, max(score) AS max_score FROM scored GROUP BY p_brand""")
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.scene_summaries(facts(spark, sf_dir), ["p_brand"], "p_type", "tier2", "score")


@query(f"""WITH {_AXES_SQL}, d(tier2) AS (VALUES ('easy'), ('medium'), ('hard'), ('extreme'))
SELECT d.tier2, count(DISTINCT p_partkey) AS parts, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM d LEFT JOIN tiers AS t ON d.tier2 = t.tier2 GROUP BY d.tier2""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entities by tier; a tier without rows counts 0."""
    return mining.entity_counts(facts(spark, sf_dir), "tier2", ["easy", "medium", "hard", "extreme"], {"parts": F.col("p_partkey"), "brands": F.col("p_brand"), "types": F.col("p_type")})


@query("""WITH m AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS m FROM lineitem GROUP BY l_orderkey),
x AS (SELECT l_orderkey, list_sort(list_filter(['A', 'N'], lambda v: NOT list_contains(m, v))) AS missing, list_sort(list_filter(m, lambda v: NOT list_contains(['A', 'N'], v))) AS unexpected FROM m)
SELECT l_orderkey, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected FROM x WHERE len(missing) > 0 OR len(unexpected) > 0""")
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that lack a required return flag or have one that isn't allowed."""
    x = mining.bundle_violations(Tables(spark, sf_dir).lineitem, ["l_orderkey"], "l_returnflag", ["A", "N"], [])
    return x.select("l_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


@query("""WITH c AS (SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'balance' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN NULL ELSE 'segment' END, CASE WHEN c_nationkey < 20 THEN NULL ELSE 'nation' END], lambda x: x IS NOT NULL), ',') AS f FROM customer)
SELECT c_custkey, f = '' AS eligible, f AS failed_checks, CASE WHEN contains(f, 'balance') THEN 'contradicted' WHEN contains(f, 'segment') OR contains(f, 'nation') THEN 'uncertain' ELSE 'aligned' END AS status FROM c""")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility, failed checks in order, and the status that they make."""
    v = contracts.validity({"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING", "nation": F.col("c_nationkey") < 20})
    x = Tables(spark, sf_dir).customer.select("c_custkey", v.alias("v"))
    return x.select("c_custkey", "v.eligible", F.array_join("v.failed_checks", ",").alias("failed_checks"), contracts.risk_status(F.col("v.failed_checks"), ["balance"], ["segment", "nation"]).alias("status"))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'balance' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN NULL ELSE 'segment' END, CASE WHEN c_nationkey < 20 THEN NULL ELSE 'nation' END]) AS reason FROM customer) WHERE reason IS NOT NULL GROUP BY reason""")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = contracts.validity({"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING", "nation": F.col("c_nationkey") < 20})
    return mining.reason_counts(Tables(spark, sf_dir).customer.select(v["failed_checks"].alias("r")), "r")


@query("""SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.violations(Tables(spark, sf_dir).orders, "o_orderkey", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})


@query("""SELECT c_nationkey, count(*) AS candidates, sum((c_acctbal > 0)::INT)::BIGINT AS solvent, sum((c_acctbal > 0 AND c_mktsegment <> 'BUILDING')::INT)::BIGINT AS other_segment, sum((c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND c_custkey % 2 = 0)::INT)::BIGINT AS even FROM customer GROUP BY c_nationkey""")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows survive stage after stage."""
    return mining.funnel(Tables(spark, sf_dir).customer, ["c_nationkey"], {"solvent": F.col("c_acctbal") > 0, "other_segment": F.col("c_mktsegment") != "BUILDING", "even": F.col("c_custkey") % 2 == 0})


@query("""WITH h AS (SELECT *, ('0x' || right(sha256(c_nationkey::VARCHAR), 2))::BIGINT % 32 AS b FROM customer)
SELECT CASE WHEN b < 4 THEN 'benchmark' WHEN b < 8 THEN 'validation' ELSE 'train' END AS split, count(*) AS rows, count(DISTINCT c_nationkey) AS groups, count(DISTINCT c_mktsegment) AS segments FROM h GROUP BY split""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and groups of splits that no group straddles."""
    x = Tables(spark, sf_dir).customer.withColumn("split", mining.split_of(F.col("c_nationkey").cast("string"), 32, 4, 4))
    return x.groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("c_nationkey").alias("groups"), F.countDistinct("c_mktsegment").alias("segments"))


@query("""SELECT c_custkey, 'benchmark' AS split FROM customer WHERE c_custkey % 97 = 0 AND c_acctbal > 0 UNION ALL SELECT c_custkey, 'train' FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 97 = 0)""")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard rows of chosen customers, and all rows of nations without a chosen one."""
    c = Tables(spark, sf_dir).customer
    return mining.disjoint(c, c.filter("c_custkey % 97 = 0").select("c_custkey"), "c_custkey", "c_nationkey", F.col("c_acctbal") > 0).select("c_custkey", "split")


@query("""WITH w AS (SELECT c_mktsegment, count(*) AS weight FROM customer GROUP BY c_mktsegment), s AS (SELECT *, 200.0 * weight / sum(weight) OVER () AS share FROM w),
f AS (SELECT *, floor(share)::BIGINT AS base FROM s), r AS (SELECT *, 200 - sum(base) OVER () AS left_over, row_number() OVER (ORDER BY share - base DESC, weight DESC, c_mktsegment DESC) AS n FROM f)
SELECT c_mktsegment, weight, (base + CASE WHEN n <= left_over THEN 1 ELSE 0 END)::BIGINT AS target FROM r""")
def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole targets in proportion to the segments, by largest remainders."""
    w = Tables(spark, sf_dir).customer.groupBy("c_mktsegment").agg(F.count("*").alias("weight"))
    return statistics.apportion(w, "weight", "c_mktsegment", 200)


@query("""SELECT lang, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 3) AS mean, round(quantile_cont(n_chars::DOUBLE, 0.5), 3) AS median, round(quantile_cont(n_chars::DOUBLE, 0.9), 4) AS p90 FROM documents GROUP BY lang""")
def quantile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, spread and exact quantiles by language."""
    return Tables(spark, sf_dir).documents.groupBy("lang").agg(*statistics.summary("n_chars"), F.round(stats.quantile(F.col("n_chars"), 0.9), 4).alias("p90"))


@query("""WITH x AS (SELECT l_returnflag AS g, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b FROM lineitem),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS rb FROM x)
SELECT g AS l_returnflag, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY g""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = statistics.spearman(Tables(spark, sf_dir).lineitem.select("l_returnflag", "l_quantity", "l_discount"), "l_quantity", "l_discount", ["l_returnflag"])
    return x.withColumn("rho", F.round("rho", 6))


@query("""WITH s AS (SELECT s_nationkey AS g, s_suppkey AS k, s_acctbal AS a, s_suppkey % 17 AS b FROM supplier), p AS (SELECT x.g, sign(x.a - y.a) AS da, sign(x.b - y.b) AS db FROM s AS x JOIN s AS y ON x.g = y.g AND x.k < y.k)
SELECT g AS s_nationkey, round(CASE WHEN sum(abs(da)) * sum(abs(db)) > 0 THEN sum(da * db) / sqrt(sum(abs(da)) * sum(abs(db))) ELSE 0 END, 6) AS tau FROM p GROUP BY g""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Tables(spark, sf_dir).supplier.withColumn("b", F.col("s_suppkey") % 17)
    return statistics.kendall(x, "s_acctbal", "b", "s_suppkey", ["s_nationkey"]).withColumn("tau", F.round("tau", 6))


@query("""SELECT event_id, round(CASE WHEN user_id % 9 = 0 THEN 0 ELSE (SELECT sum(CASE WHEN abs(value - (user_id + 1)) / abs(user_id + 1) <= (50 - 5 * i) / 100.0 THEN 1 ELSE 0 END) FROM (SELECT unnest(range(10)) AS i)) / 10 END, 4) AS mra FROM events""")
def relative_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of ten error thresholds that a numeric answer meets; no answer scores 0."""
    x = Tables(spark, sf_dir).events
    answer = F.when(F.col("user_id") % 9 != 0, F.col("value"))
    return x.select("event_id", F.round(stats.mean_relative_accuracy(answer, F.col("user_id") + 1), 4).alias("mra"))


def _poisson_sql(u: str) -> str:
    """The hashed weight: how many steps of the Poisson(1) distribution lie at or below u."""
    return "(" + " + ".join(f"({u} >= {step!r})::INT" for step in statistics.POISSON_STEPS) + ")"


@query(f"""WITH s AS (SELECT source, sum(quality)::DOUBLE AS s, count(quality) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
d AS (SELECT s, n, r, ('0x' || substr(md5(source || ':' || r || ':7'), 1, 13))::BIGINT / {float(1 << 52)!r} AS u FROM s, (SELECT unnest(range(10000)) AS r)),
m AS (SELECT r, sum(s * {_poisson_sql("u")}) / sum(n * {_poisson_sql("u")}) AS m FROM d GROUP BY r HAVING sum(n * {_poisson_sql("u")}) > 0)
SELECT (SELECT round(sum(s) / sum(n), 6) FROM s) AS estimate, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents of good quality with an interval from 10,000 resamples of whole sources."""
    t = Tables(spark, sf_dir)
    x = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    found = statistics.cluster_bootstrap(x, "quality", "source", 10_000, 7)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


_PAIRED = """
c AS (SELECT user_id % 50 AS cluster, event_type AS benchmark, value > 50 AS before, value > 45 AS after FROM events),
p AS (SELECT benchmark, cluster, sum(after::INT - before::INT)::DOUBLE AS s, count(*) AS n FROM c GROUP BY benchmark, cluster),
"""


@query(f"""WITH {_PAIRED}
d AS (SELECT benchmark, s, n, r, ('0x' || substr(md5(cluster || ':' || r || ':11'), 1, 13))::BIGINT / {float(1 << 52)!r} AS u FROM p, (SELECT unnest(range(2000)) AS r)),
m AS (SELECT benchmark, r, sum(s * {_poisson_sql("u")}) / sum(n * {_poisson_sql("u")}) AS m FROM d GROUP BY benchmark, r HAVING sum(n * {_poisson_sql("u")}) > 0),
i AS (SELECT benchmark, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY benchmark),
a AS (SELECT benchmark, count(*) AS n, avg(before::INT) AS before, avg(after::INT) AS after FROM c GROUP BY benchmark)
SELECT benchmark, n, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high FROM a JOIN i USING (benchmark)
UNION ALL SELECT 'macro', sum(n)::BIGINT, round(avg(before), 6), round(avg(after), 6), round(avg(after) - avg(before), 6), NULL, NULL FROM a
UNION ALL SELECT 'pooled', count(*), round(avg(before::INT), 6), round(avg(after::INT), 6), round(avg(after::INT) - avg(before::INT), 6), NULL, NULL FROM c""")
def cross_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy before and after for each benchmark with a paired interval, then the mean over benchmarks and over all items."""
    events = Tables(spark, sf_dir).events
    rows = events.select((F.col("user_id") % 50).alias("cluster"), F.col("event_type").alias("benchmark"), (F.col("value") > 50).cast("int").alias("before"), (F.col("value") > 45).cast("int").alias("after"))
    return statistics.cross_benchmark(rows, "benchmark", "cluster", "before", "after", 2000, 11)


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n, count(*) OVER (PARTITION BY role) AS c FROM conversations) SELECT conv_id, turn, role FROM r WHERE n <= greatest(1, floor(c * 0.2))""")
def stratified_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifth of each role's turns."""
    x = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role")
    return selection.stratified_fraction(x, ["role"], ["conv_id", "turn"], 0.2)


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY c_mktsegment), b AS (SELECT *, count(*) OVER () AS k, row_number() OVER (ORDER BY c_mktsegment) AS i FROM s),
q AS (SELECT *, least(floor(101 / k) + CASE WHEN i <= 101 % k THEN 1 ELSE 0 END, size) AS quota FROM b)
SELECT c_custkey, x.c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) AS x JOIN q ON x.c_mktsegment = q.c_mktsegment WHERE n <= quota""")
def stratified_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """101 customers in equal quotas by segment."""
    return selection.stratified_limit(Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], 101)


@query("""WITH g AS (SELECT doc_id, source, coalesce(quality = 1, false) AS good FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, sum(good::INT) AS p, sum((NOT good)::INT) AS n FROM g GROUP BY source), k AS (SELECT *, least(n, 40 - least(p, n, 20)) AS neg FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source, good ORDER BY md5(doc_id || ':7'), doc_id) AS i FROM g)
SELECT doc_id, r.source, good FROM r JOIN k ON r.source = k.source WHERE i <= CASE WHEN good THEN least(p, 40 - neg) ELSE neg END""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source at most 40 documents with no more good than bad ones."""
    t = Tables(spark, sf_dir)
    x = t.documents.select("doc_id", "source").join(t.labels, "doc_id").withColumn("good", F.col("quality") == 1)
    return selection.balanced_sample(x.select("doc_id", "source", "good"), ["source"], "good", "doc_id", 40, 7)


@query()
def greedy_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations chosen one by one until their customers come closest to a target."""
    x = Tables(spark, sf_dir).customer.groupBy("c_nationkey").agg(F.count("*").alias("questions")).withColumn("all", F.lit(1))
    total = x.agg(F.sum("questions")).first()[0] or 0
    return selection.greedy(x, ["all"], "c_nationkey", selection.window_objective("questions", total / 3, total * 0.3, total * 0.36), 25).drop("all")


@query("SELECT ('0x' || right(sha256(source), 2))::BIGINT % 32 AS bucket, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY bucket")
def archive_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the archive that their source hashes to."""
    x = Tables(spark, sf_dir).documents.select("source", hash_bucket(F.col("source")).alias("bucket"))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
