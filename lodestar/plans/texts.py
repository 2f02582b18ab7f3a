"""Answer forms, rationales, cues and JSON texts, made from the driver's rows so that SQL can state what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import parse, text
from lodestar.operators import projections
from lodestar.plans.registry import Tables, query


def _joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def _pick(key: Column, *values: Column | str) -> Column:
    """One of the values, by the key modulo their number."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (key % len(values)).cast("int"))


@query("""SELECT o_orderkey, 'so [' || o_custkey || ', 3]' AS after, o_custkey || ',3' AS ids, o_orderkey % 2 = 0 OR o_custkey = 3 AS within, (o_orderkey % 9)::DOUBLE AS x0, 0.0::DOUBLE AS z0, 30.0::DOUBLE AS z1,
  CASE o_orderkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'B' ELSE '' END AS option, 'red ' || o_orderkey % 3 || '|blue|green' AS choices, (o_orderkey % 7)::VARCHAR AS token, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 7)::DOUBLE END AS number FROM orders""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers after reasoning, coordinate paths, option letters, choice lists, first words and numbers."""
    k = F.col("o_orderkey")
    said = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    x = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", said("<think>maybe [1]</think> so [", F.col("o_custkey"), ", 3]").alias("a"), said("go [", k % 9, ", 2.5] then [1,", k % 4, ",3e1]").alias("p"))
    ids, path = parse.first_list(F.col("a")), parse.coordinate_path(F.col("p"))
    allowed = F.when(k % 2 == 0, F.array(F.col("o_custkey"), F.lit(3).cast("long"))).otherwise(F.array(F.lit(3).cast("long")))
    option = parse.option_letter(_pick(k, "The answer is (B).", "2", "A or C", "<think>B"))
    choices = F.array_join(parse.choice_lines(said("A. red ", k % 3, "\n\n(B) blue\nC: green")), "|")
    number = F.when(k % 5 == 0, F.lit("inf")).otherwise(said("  ", k % 7, ". and more"))
    return x.select("o_orderkey", parse.answer_after_thinking(F.col("a")).alias("after"), _joined(ids).alias("ids"), parse.ids_within(ids, allowed).alias("within"), path[0][0].alias("x0"), path[0][2].alias("z0"), path[1][2].alias("z1"), option.alias("option"), choices.alias("choices"), parse.first_token(said("  ", k % 7, ". and more")).alias("token"), parse.finite_number(number).alias("number"))


@query("""WITH x AS (SELECT o_orderkey AS k, '[' || o_orderkey % 7 || ',3]' AS ids FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 3 = 1 AND ids <> '[9,9]' THEN NULL ELSE '<think>' || chr(10) || 'I see it.' || chr(10) || '</think>' || chr(10) || ids END AS canonical,
  'no_open_tag,no_close_tag,banned_phrase' || CASE WHEN k % 3 = 2 THEN ',no_final_list' ELSE '' END AS issues, k % 3 = 0 AS mentioned, k % 2 = 0 AS run FROM x""")
def rationale_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rationales brought into canonical form, their issues, and whether they name all ids."""
    k = F.col("o_orderkey")
    ids = F.array(k % 7, F.lit(3).cast("long"))
    said = _pick(k, F.concat(F.lit("I see it.\n["), (k % 7).cast("string"), F.lit(", 3]")), F.lit("I see it. [9, 9]"), F.lit("I see it."))
    run = text.mentions_all(F.lit("1 Through 2 are fine"), F.array(F.lit(2).cast("long"), F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(3)).cast("long")))
    return Tables(spark, sf_dir).orders.select("o_orderkey", text.canonical_rationale(said, ids).alias("canonical"), F.array_join(text.rationale_issues(said, ["see it"]), ",").alias("issues"), text.mentions_all(said, ids).alias("mentioned"), run.alias("run"))


@query("""WITH x AS (SELECT p_partkey AS k, p_name, ['red', 'blue', ''][p_partkey % 3 + 1] AS said, ['red', 'blue', NULL, NULL][p_partkey % 4 + 1] AS seen, ['red', NULL][p_partkey % 2 + 1] AS known FROM part)
SELECT k AS p_partkey, CASE WHEN said = '' THEN 'no_claim' WHEN said = seen THEN 'supported' WHEN seen IS NULL AND (known IS NULL OR said = known) THEN 'uncertain' ELSE 'contradicted' END AS claim,
  CASE WHEN k % 2 = 0 THEN 'Where is it near the door?' ELSE 'Go there near the door.' END AS cued,
  replace(['Find {name}.', 'Go to {name}!', 'Where is {name}?'][('0x' || substr(md5(p_name), 1, 8))::BIGINT % 3 + 1], '{name}', p_name) AS filled,
  'the' || CASE WHEN k % 2 = 0 THEN ' nearest' ELSE '' END || CASE WHEN said <> '' THEN ' ' || said ELSE '' END || ' box' AS phrase FROM x""")
def cue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour claims against what is seen, cues before the final mark, chosen templates and target phrases."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    said = _pick(k, "red", "blue", "")
    claim = text.color_claim(F.concat(F.lit("the "), said, F.lit(" box")), _pick(k, F.lit("red"), F.lit("blue"), none, none), _pick(k, F.lit("red"), none), ["red", "blue", "green"])
    question = F.when(k % 2 == 0, F.lit("Where is it?")).otherwise(F.lit("Go there"))
    filled = text.fill_template(F.col("p_name"), ["Find {name}.", "Go to {name}!", "Where is {name}?"], name=F.col("p_name"))
    phrase = projections.target_phrase(F.lit("box"), F.nullif(said, F.lit("")), F.when(k % 2 == 0, F.lit("nearest")))
    return Tables(spark, sf_dir).part.select("p_partkey", claim.alias("claim"), text.append_cue(question, F.lit("near the door")).alias("cued"), filled.alias("filled"), phrase.alias("phrase"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE user_id END AS user, CASE event_id % 3 WHEN 0 THEN 'score' WHEN 1 THEN '' ELSE 'user,score' END AS missing, event_id % 4 || ',7' AS ids, user_id || ',' || event_id AS mapped FROM events""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found in talk, paths that they lack, ids collected from any of the forms of an answer, and ids through a map."""
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    said = _pick(k, F.concat(F.lit('Sure: {"user": '), user, F.lit("} done")), F.concat(F.lit('```json\n{"user": '), user, F.lit(', "score": 1}\n```')), F.lit("none"))
    found = parse.json_object(said)
    one = (k % 4).cast("string")
    forms = _pick(k, F.concat(F.lit("["), one, F.lit(", 7]")), F.concat(F.lit('the list [{"id": '), one, F.lit('}, {"displayId": 7}]')), F.concat(F.lit('{"display_ids": ['), one, F.lit(", 7]}")), F.concat(F.lit('so ["'), one, F.lit('", 7]')))
    lookup = F.create_map(F.lit(1), F.col("user_id"), F.lit(3), F.col("event_id"))
    paths = F.when(found.isNull(), F.array(F.lit("user"), F.lit("score"))).otherwise(F.transform(projections.missing_paths(found, ["$.user", "$.score"]), lambda p: F.substring(p, 3, 99)))
    return Tables(spark, sf_dir).events.select("event_id", F.try_variant_get(found, "$.user", "bigint").alias("user"), F.array_join(paths, ",").alias("missing"), _joined(parse.collected_ids(forms)).alias("ids"), _joined(projections.map_ids(F.array(F.lit(1), F.lit(2), F.lit(3)), lookup)).alias("mapped"))


@query("""SELECT conv_id, turn, '[{"role":"user","content":"q' || turn || '"},{"role":"assistant","content":"' || role || '"}]' AS chat FROM conversations""")
def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two messages for tuning."""
    x = Tables(spark, sf_dir).conversations
    return x.select("conv_id", "turn", F.to_json(projections.chat_row(F.concat(F.lit("q"), F.col("turn").cast("string")), F.col("role"))).alias("chat"))
