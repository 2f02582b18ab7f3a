"""Set answers, parsing and joins with rules, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import parse, text
from lodestar.functions.hashing import canonical_json, facts_hash, hash_bucket, stable_index
from lodestar.operators import joins, scoring
from lodestar.plans.registry import Tables, query


def _set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question is a language and source: which of its labelled documents have good quality; long ones are the answer."""
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    x = docs.join(t.labels, "doc_id", "left").groupBy("lang", "source").agg(
        F.collect_list(F.when(F.col("quality").isNotNull(), F.col("doc_id"))).alias("universe"),
        F.collect_list(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("truth"),
        F.collect_list(F.when(F.col("n_chars") > 1500, F.col("doc_id"))).alias("prediction"),
    )
    return x.select("lang", "source", *[v.alias(k) for k, v in scoring.set_counts(F.col("universe"), F.col("truth"), F.col("prediction")).items()])


_SET_SQL = """
x AS (SELECT lang, source, d.doc_id, quality IS NOT NULL AS u, coalesce(quality = 1, false) AS t, n_chars > 1500 AS p FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id),
c AS (SELECT lang, source, sum((p AND NOT u)::INT)::BIGINT AS invalid, sum((p AND u AND t)::INT)::BIGINT AS tp, sum((p AND u AND NOT t)::INT)::BIGINT AS fp, sum((t AND NOT (p AND u))::INT)::BIGINT AS fn, sum((u AND NOT t AND NOT p)::INT)::BIGINT AS tn FROM x GROUP BY lang, source)
"""


@query(f"""WITH {_SET_SQL},
s AS (SELECT lang, count(*) AS questions, sum(invalid)::BIGINT AS invalid, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM c GROUP BY lang),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re, tn / greatest(tn + fp, 1) AS tnr FROM s)
SELECT lang, questions, invalid, tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall, round(2 * pr * re / greatest(pr + re, 1e-9), 4) AS f1, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 4) AS accuracy, round((re + tnr) / 2, 4) AS balanced_accuracy FROM m""")
def set_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-pooled metrics of set answers by language."""
    return scoring.set_metrics(_set_counts(spark, sf_dir), ["lang"])


@query(f"WITH {_SET_SQL} SELECT lang, source, invalid, tp, fp, fn, tn FROM c")
def set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _set_counts(spark, sf_dir)


@query("""WITH x AS (SELECT o_orderkey, [o_custkey, o_orderkey % 7, 3] AS ids FROM orders)
SELECT o_orderkey, array_to_string(ids, ',') AS listed, array_to_string(ids, ',') AS fenced, array_to_string(ids, ',') AS thought, o_orderkey % 2 = 0 AS strict_ok FROM x""")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids from bare, fenced and reasoned answers; numbers with a fraction only pass the lenient parser."""
    ids = F.array(F.col("o_custkey"), F.col("o_orderkey") % 7, F.lit(3).cast("long"))
    bare = F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: i.cast("string")), ", "), F.when(F.col("o_orderkey") % 2 == 0, F.lit("]")).otherwise(F.lit(".0]")))
    x = Tables(spark, sf_dir).orders.select("o_orderkey", bare.alias("a"), F.concat(F.lit("```json\n"), bare, F.lit("\n```")).alias("b"), F.concat(F.lit("<think>maybe [1]</think> The answer is "), bare).alias("c"))
    joined = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return x.select("o_orderkey", joined(parse.id_list(F.col("a"))).alias("listed"), joined(parse.id_list(F.col("b"))).alias("fenced"), joined(parse.last_list(F.col("c"))).alias("thought"), parse.strict_id_list(F.col("a")).isNotNull().alias("strict_ok"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, 0.5 AS missing, event_type = 'click' AS is_click FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of JSON text, with a default where there is none."""
    v = F.try_parse_json("props")
    x = Tables(spark, sf_dir).events
    return x.select("event_id", parse.nested_number(v, "$.k").alias("k"), parse.nested_number(v, "$.absent", 0.5).alias("missing"), (F.col("event_type") == "click").alias("is_click"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS t FROM orders),
g AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT v.o_orderkey, coalesce(p, g.o_orderpriority) AS p, coalesce(t, g.o_totalprice) AS t FROM v LEFT JOIN g ON v.o_orderkey = g.o_orderkey""")
def null_fill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose null fields are filled from ground truth where there is any."""
    orders = Tables(spark, sf_dir).orders
    k = F.col("o_orderkey")
    vqa = orders.select("o_orderkey", F.when(k % 3 != 0, F.col("o_orderpriority")).alias("p"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("t"))
    gt = orders.filter(k % 2 == 0).select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("t"))
    return joins.null_fill(vqa, gt, ["o_orderkey"], ["p", "t"])


@query("""SELECT 'left' AS side, c_custkey FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'right', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""")
def key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one of two tables has."""
    t = Tables(spark, sf_dir)
    return joins.key_mismatches(t.customer.filter("c_custkey % 3 <> 0"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest answer of each user and type."""
    return joins.last_wins(Tables(spark, sf_dir).events, ["user_id", "event_type"], F.struct("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.duplicate_keys(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT a.c_custkey FROM customer AS a JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer) AS b ON a.c_custkey = b.c_custkey
WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables that should agree and don't, nulls compared as values."""
    c = Tables(spark, sf_dir).customer
    other = c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")))
    return joins.misaligned(c, other, ["c_custkey"], ["c_nationkey", "c_mktsegment"]).select("c_custkey")


@query("""SELECT c_custkey, sha256('{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS hash, '{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' AS json FROM customer""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of compact JSON with sorted keys."""
    fields = {"segment": F.col("c_mktsegment"), "key": F.col("c_custkey")}
    return Tables(spark, sf_dir).customer.select("c_custkey", facts_hash(**fields).alias("hash"), canonical_json(**fields).alias("json"))


@query("""SELECT p_partkey, (('0x' || substr(md5(p_name), 1, 8))::BIGINT % 7)::BIGINT AS template, (('0x' || right(sha256(p_name), 2))::BIGINT % 32)::BIGINT AS bucket FROM part""")
def stable_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template and an archive bucket for each name, by digests."""
    return Tables(spark, sf_dir).part.select("p_partkey", stable_index(F.col("p_name"), 7).alias("template"), hash_bucket(F.col("p_name")).alias("bucket"))


@query("""WITH t AS (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS b FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(b, '([^\\n]*)$', 1), '^\\s*\\[[^\\n]*\\]\\s*$') THEN 'plain_plus_tail' ELSE 'plain_no_tail' END AS class,
  len(regexp_extract_all(text, '(?i)\\bthe\\b'))::INT AS n_the, regexp_matches(text, '(?i)\\blicense\\b') AS license, contains(lower(text), 'secret') OR contains(lower(text), 'password') AS sensitive FROM t""")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format class, phrase counts and phrase predicates of documents."""
    t = F.col("text")
    return Tables(spark, sf_dir).documents.select("doc_id", text.format_class(t).alias("class"), F.regexp_count(t, F.lit(r"(?i)\bthe\b")).alias("n_the"), text.has_phrase(t, "license").alias("license"), text.has_any(t, ["secret", "password"]).alias("sensitive"))


@query("""SELECT conv_id, turn, strpos(lower(text), 'the') > 0 AND strpos(substr(lower(text), strpos(lower(text), 'the') + 3), 'and') > 0 AS ordered FROM conversations""")
def phrase_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one phrase follows another."""
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", text.in_order(F.col("text"), [["the"], ["and"]]).alias("ordered"))


@query("""SELECT p_partkey, regexp_matches(lower(prompt), '\\b' || lower(word) || '(s|es)?\\b') OR regexp_matches(lower(prompt), '#\\d+|\\bids? \\d+\\b') AS leaks
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Go to the ' || p_type || 's please' WHEN p_partkey % 3 = 1 THEN 'Take #' || p_partkey ELSE 'Walk ahead' END AS prompt, p_type AS word FROM part)""")
def leak_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that give their answer away."""
    k = F.col("p_partkey") % 3
    prompt = F.when(k == 0, F.concat(F.lit("Go to the "), F.col("p_type"), F.lit("s please"))).when(k == 1, F.concat(F.lit("Take #"), F.col("p_partkey").cast("string"))).otherwise(F.lit("Walk ahead"))
    return Tables(spark, sf_dir).part.select("p_partkey", text.leaks_answer(prompt, F.col("p_type"), F.lit("zzz")).alias("leaks"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower(trim(c_mktsegment)) END AS normalized, regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM customer")
def text_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.when(F.col("c_custkey") % 5 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" ")))
    return Tables(spark, sf_dir).customer.select("c_custkey", parse.normalized(padded).alias("normalized"), parse.slug(F.col("c_name")).alias("slug"))


@query("SELECT e.event_id, e.user_id FROM events AS e WHERE e.user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND e.event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked questions without those that are answered already."""
    t = Tables(spark, sf_dir)
    asked = t.events.join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi")
    return asked.join(t.events.filter("event_type = 'view'").select("event_id"), "event_id", "left_anti").select("event_id", "user_id")
