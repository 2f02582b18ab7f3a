"""Question rows from ground truth, repairs after prompt changes, and the steps of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import ladders
from lodestar.functions.hashing import contract_hashes
from lodestar.functions.text import has_phrase
from lodestar.operators.contracts import require, validity
from lodestar.operators.joins import null_fill

#: Tasks that a view has once, and those that it has for each of its route candidates.
SET_TASKS, ROUTE_TASKS = ("a1", "b1"), ("a2", "b2", "c")


def typed_rows(views: DataFrame, candidates: DataFrame, view: list[str], route: str, eligible: Column) -> DataFrame:
    """(view, route, task, question_id): five kinds of rows; ids follow from task, view and route alone.

    A view that isn't eligible is an error when the rows are read.  A view without candidates has its set questions.
    """
    checked = require(views, {"view is eligible": eligible})
    tasks = lambda names: F.explode(F.array(*map(F.lit, names))).alias("task")
    sets = checked.select(*view, F.lit(None).cast(dict(candidates.dtypes)[route]).alias(route), tasks(SET_TASKS))
    routes = checked.select(*view).join(candidates.select(*view, route), view).select(*view, route, tasks(ROUTE_TASKS))
    parts = ["task", *view, route]
    return sets.unionByName(routes).withColumn("question_id", F.concat_ws("-", *[F.col(c).cast("string") for c in parts]))


def question_rows(truth: DataFrame, common: list[str], kinds: dict[str, tuple[list[str], Column, Column, list[str]]], task: str = "task") -> DataFrame:
    """A row for each question: the common columns, its prompt, its answer, ground truth as JSON, and the digests of its contract.

    ``kinds``: name of a kind to its tasks, prompt, answer and the columns of its ground truth.  Kinds
    differ in their ground truth, which is why it is JSON without nulls; tasks of no kind are left out.
    """
    out = None
    for name, (tasks, prompt, answer, fields) in kinds.items():
        x = truth.filter(F.col(task).isin(*tasks)).withColumns({"prompt": prompt, "answer": answer.cast("string"), "kind": F.lit(name)})
        packed = F.to_json(F.struct(F.col("answer").alias("answer"), *[F.col(f) for f in fields]))
        identity = {c: F.col(c) for c in common}
        hashes = contract_hashes(identity, {"answer": F.col("answer"), **{f: F.col(f) for f in fields}}, F.col("prompt"))
        rows = x.select(*common, "kind", "prompt", "answer", packed.alias("ground_truth"), *[h.alias(n) for n, h in hashes.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def repaired_mode(status: Column, cue_family: Column, cue_type: Column, mode: Column) -> Column:
    """The reference mode that a repaired prompt uses; others keep theirs, an unknown one is by category."""
    relation = (cue_family == "relation") | cue_type.isin("side", "near", "on", "inside", "under")
    distance = cue_family.isin("distance", "strict_distance") | (cue_type == "distance_rank")
    hold = lambda test: F.coalesce(test, F.lit(False))
    known = F.coalesce(mode, F.lit("category_only"))
    found = F.when(hold(relation), F.lit("relation_only")).when(hold(distance), F.lit("distance_only")).when(hold(cue_type == "color"), F.lit("color_only")).otherwise(known)
    return F.when(hold(status == "repaired"), found).otherwise(known)


def resynced(rows: DataFrame) -> DataFrame:
    """Rows with mode, reference axis and tier as they follow from the repaired prompt.

    ``rows``: prompt_repair_status, cue_family, cue_type, mode, top2_gap, repaired_gap, ambiguity,
    same_color, other_color, geometry_axis, embodiment_axis.
    """
    c = F.col
    x = rows.withColumn("mode", repaired_mode(c("prompt_repair_status"), c("cue_family"), c("cue_type"), c("mode")))
    # Unknown and 0 both mean that the gap isn't known.
    gap = F.coalesce(F.nullif(c("repaired_gap"), F.lit(0.0)), F.nullif(c("top2_gap"), F.lit(0.0)), F.lit(999.0))
    count = lambda name: F.coalesce(c(name), F.lit(0))
    x = x.withColumn("reference_axis", ladders.reference_axis(c("mode"), gap, F.greatest(count("ambiguity"), F.lit(1)), count("same_color"), count("other_color")))
    return x.withColumn("tier", ladders.compose_tier(c("reference_axis"), c("geometry_axis"), c("embodiment_axis")))


def hydrated(rows: DataFrame, candidates: DataFrame, keys: list[str], fields: list[str], uniqueness: Column) -> DataFrame:
    """Rows whose missing fields come from their candidate, with what became of them: kept, hydrated, or incomplete, and whether their cue is unique."""
    missing = lambda: sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    x = null_fill(rows.withColumn("__before", missing()), candidates.dropDuplicates(keys), keys, fields).withColumn("__after", missing())
    status = F.when(F.col("__after") > 0, F.lit("incomplete")).when(F.col("__before") > 0, F.lit("hydrated")).otherwise(F.lit("kept"))
    return x.withColumn("hydration", status).withColumn("cue_unique", F.coalesce(uniqueness == 1, F.lit(False))).drop("__before", "__after")


def truth_repair(candidates: DataFrame, targets: DataFrame, group: list[str], id_col: str, category: str, color: str, metric: str, top2: float = 0.4) -> DataFrame:
    """What supports each target in its view: rivals by category and colour, the gap to the nearest rival, the first cue that tells it, and its status."""
    w = Window.partitionBy(*group, category)
    same_color = F.count("*").over(Window.partitionBy(*group, category, color))
    ordered = w.orderBy(metric, id_col)
    gap = F.least(F.lead(metric).over(ordered) - F.col(metric), F.col(metric) - F.lag(metric).over(ordered))
    x = candidates.withColumns({"rivals": F.count("*").over(w) - 1, "same_color": same_color - 1, "place": F.row_number().over(ordered), "gap": gap})
    x = x.join(targets.select(*group, id_col), [*group, id_col], "left_semi")
    clear = F.col("gap") >= top2
    end = (F.col("place") == 1) | (F.col("place") == F.col("rivals") + 1)
    cue = F.when(F.col("rivals") == 0, F.lit("category")).when(F.col(color).isNotNull() & (F.col("same_color") == 0), F.lit("color")).when(clear & end, F.lit("distance"))
    x = x.withColumn("cue", cue)
    status = F.when(F.col("cue") == "category", F.lit("aligned")).when(F.col("cue").isNotNull(), F.lit("repaired")).otherwise(F.lit("uncertain"))
    return x.select(*group, id_col, "rivals", "same_color", "gap", "cue", F.when(F.col("cue").isNull(), F.lit("ambiguous")).otherwise(F.lit("unique")).alias("uniqueness"), status.alias("status"))


def intent_rows(embodied: DataFrame, repair: DataFrame, keys: list[str], family: Column) -> DataFrame:
    """Rows of the intent task out of embodied rows whose cue is unique, with the family asked for; others go."""
    unique = repair.filter("uniqueness = 'unique'").select(*keys, "cue")
    return embodied.join(unique, keys).withColumns({"task": F.lit("c"), "family": family}).filter("family IS NOT NULL")


def paired_removal(rows: DataFrame, unit: list[str], task: str, pair: list[str], bad: Column) -> DataFrame:
    """Rows without the units of which any paired task's row is bad: a pair stays whole or goes whole."""
    out = rows.filter(F.col(task).isin(*pair) & F.coalesce(bad, F.lit(True))).select(*unit).distinct().withColumn("__gone", F.lit(True))
    joined = rows.join(out, unit, "left")
    return joined.filter(F.col("__gone").isNull() | ~F.col(task).isin(*pair)).drop("__gone")


def refreshed(summary: DataFrame, metrics: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    """A summary with its metrics measured again, and how much each changed; runs that weren't measured keep theirs."""
    new = metrics.select(*keys, *[F.col(n).alias(f"__{n}") for n in names])
    x = summary.join(new, keys, "left")
    kept = {n: F.coalesce(f"__{n}", n) for n in names}
    return x.select(*keys, *[F.round(v, digits).alias(n) for n, v in kept.items()], *[F.round(v - F.col(n), digits).alias(f"delta_{n}") for n, v in kept.items()])


def by_subsets(rows: DataFrame, evaluator: str, subsets: dict[str, Column], rates: dict[str, Column]) -> DataFrame:
    """For each evaluator and subset of questions how many there are and the rates on them; 0 for none."""
    columns = []
    for s, test in subsets.items():
        inside = F.coalesce(test, F.lit(False))
        n = F.sum(inside.cast("long"))
        columns.append(n.alias(f"{s}_n"))
        columns += [F.round(F.sum((inside & F.coalesce(r, F.lit(False))).cast("long")) / F.greatest(n, F.lit(1)), 6).alias(f"{s}_{name}") for name, r in rates.items()]
    return rows.groupBy(evaluator).agg(*columns)


def best_with_interval(rates: DataFrame, task: str, run: str, rate: str, n: str) -> DataFrame:
    """The best run of each task (ties: the first by name) with the Wilson interval of its rate."""
    from lodestar.functions.stats import wilson

    best = rates.withColumn("__n", F.row_number().over(Window.partitionBy(task).orderBy(F.col(rate).desc(), run))).filter("__n = 1").drop("__n")
    low, high = wilson(F.col(rate), F.col(n))
    return best.select(task, run, F.round(rate, 6).alias(rate), n, F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def canonical_category(rows: DataFrame, aliases: DataFrame, category: str) -> DataFrame:
    """Rows with canonical name and semantic group of their category; a name without an alias stands for itself.

    ``aliases``: alias, canonical, semantic_group; names are compared trimmed and lower-cased.
    """
    plain = F.lower(F.trim(F.col(category)))
    table = aliases.select(F.lower(F.trim(F.col("alias"))).alias("__alias"), F.col("canonical").alias("__canonical"), F.col("semantic_group").alias("__group")).dropDuplicates(["__alias"])
    x = rows.withColumn("__plain", plain).join(table, F.col("__plain") == F.col("__alias"), "left")
    return x.withColumns({"canonical": F.coalesce("__canonical", "__plain"), "semantic_group": F.coalesce("__group", "__canonical", "__plain")}).drop("__plain", "__alias", "__canonical", "__group")


def adjudicated(rows: DataFrame, records: DataFrame, key: str, uncertain: Column) -> DataFrame:
    """The rows; an uncertain one needs a record that is approved and unique, and reading it without one is an error.

    ``records``: key, status, resolution.  A repeated key, or a record with a blank field, is an error too.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    known = records.groupBy(F.trim(F.col(key).cast("string")).alias("__key")).agg(F.count("*").alias("__n"), F.max(blank("status") | blank("resolution")).alias("__blank"), F.min("status").alias("__status"), F.min("resolution").alias("__resolution"))
    x = rows.withColumn("__uncertain", F.coalesce(uncertain, F.lit(True))).join(known, F.col(key).cast("string") == F.col("__key"), "left")
    rules = {
        "adjudication keys are unique": F.coalesce(F.col("__n") == 1, F.lit(True)),
        "adjudication fields are filled": F.coalesce(~F.col("__blank"), F.lit(True)),
        "an uncertain row is approved as unique": ~F.col("__uncertain") | ((F.col("__status") == "approved") & (F.col("__resolution") == "unique")),
    }
    return require(x, rules).drop("__uncertain", "__key", "__n", "__blank", "__status", "__resolution")


def prompt_slots(rows: DataFrame, catalog: DataFrame, family: str, category: str, old: str, banned: list[str]) -> DataFrame:
    """Rows with their slot and its text: the slot of family and category, else the family's default (null category).

    An old text is used again only if it names no id and has no banned phrase.  Rows without a slot have none.
    """
    fold = lambda c: F.lower(F.trim(F.col(c)))
    exact = catalog.filter("category IS NOT NULL").select(fold("family").alias("__f"), fold("category").alias("__c"), F.col("slot").alias("__slot"), F.col("text").alias("__text")).dropDuplicates(["__f", "__c"])
    default = catalog.filter("category IS NULL").select(fold("family").alias("__df"), F.col("slot").alias("__dslot"), F.col("text").alias("__dtext")).dropDuplicates(["__df"])
    x = rows.join(exact, (fold(family) == F.col("__f")) & (fold(category) == F.col("__c")), "left").join(default, fold(family) == F.col("__df"), "left")
    said = F.lower(F.col(old))
    names_id = said.rlike(r"\b(display\s*id|target\s*id|object\s*id|id)\s*[:#-]?\s*\d+\b")
    has_banned = F.lit(False)
    for phrase in banned:
        has_banned = has_banned | has_phrase(F.col(old), phrase)
    slot = F.coalesce("__slot", "__dslot")
    reuse = slot.isNotNull() & F.coalesce(~names_id & ~has_banned, F.lit(False))
    return x.withColumns({"slot": slot, "reused": reuse, "prompt": F.when(reuse, F.col(old)).otherwise(F.coalesce("__text", "__dtext"))}).drop("__f", "__c", "__slot", "__text", "__df", "__dslot", "__dtext")


def visible_path(path: Column, visible: Column) -> Column:
    """The visible ids of a path, each where it occurs first; null if fewer than two remain."""
    left = F.array_distinct(F.filter(path, lambda i: F.array_contains(visible, i)))
    return F.when(F.size(left) >= 2, left)


def endpoint_anchor(paths: DataFrame, points: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, id, distance): of the ids of a path, else of its fallback, the one nearest to the endpoint; ties by place, then id.

    ``paths``: key, x, y, primary, fallback; ``points``: id, x, y.  Distances are compared in steps of ``tolerance``.
    """
    listed = paths.select(key, F.col("x").alias("__x"), F.col("y").alias("__y"), F.posexplode(F.concat("primary", "fallback")).alias("place", "id"))
    near = listed.join(points.select("id", "x", "y"), "id").withColumn("distance", F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")))
    best = near.groupBy(key).agg(F.min(F.struct(F.round(F.col("distance") / tolerance).alias("step"), "place", "id", "distance")).alias("b"))
    return best.select(key, "b.id", "b.distance")


def fact_packet(task: Column, answer: Column, universe: Column, start: Column, goal: Column, length: Column) -> Column:
    """Facts of a question as a struct: the answer and its complement for sets, the route's ends, hops and length for routes."""
    route = task.isin(*ROUTE_TASKS)
    only = lambda test, value: F.when(test, value)
    return F.struct(
        task.alias("task"),
        F.when(task.isin("b1", "b2", "c"), F.lit("embodied")).otherwise(F.lit("point")).alias("body"),
        answer.alias("answer"),
        only(~route, F.array_except(universe, answer)).alias("complement"),
        only(route, start).alias("start"),
        only(route, goal).alias("goal"),
        only(route, F.greatest(F.size(answer) - 1, F.lit(0))).alias("hops"),
        only(route, F.round(length, 2)).alias("length"),
    )


def public_packet(packet: Column) -> Column:
    """The packet without what gives the answer away."""
    return F.struct(*[packet[n].alias(n) for n in ("task", "body", "start", "hops")])


def rationale(packet: Column) -> Column:
    """Sentences out of a packet, those without facts left out, and the answer in the last line."""
    listed = lambda ids: F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))
    body = F.when(packet["body"] == "embodied", F.lit("A body has to fit.")).otherwise(F.lit("A point is enough."))
    count = F.concat(F.size(packet["answer"]).cast("string"), F.when(F.size(packet["answer"]) == 1, F.lit(" point qualifies.")).otherwise(F.lit(" points qualify.")))
    rest = F.when(F.size(packet["complement"]) > 0, F.concat(F.lit("Blocked: "), listed(packet["complement"]), F.lit(".")))
    way = F.concat(F.lit("The route goes from "), packet["start"].cast("string"), F.lit(" to "), packet["goal"].cast("string"), F.lit(" in "), packet["hops"].cast("string"), F.lit(" hops over "), F.format_string("%.2f", packet["length"]), F.lit(" m."))
    sentences = F.concat_ws(" ", body, F.when(packet["complement"].isNotNull(), count), rest, way)
    return F.concat(sentences, F.lit("\n"), listed(packet["answer"]))


def surface_contract(checks: list[tuple[str, Column]]) -> Column:
    """(status, reason): pass, or drop with the first check that fails, in order; an unknown outcome fails."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])
    return F.struct(F.when(reason.isNull(), F.lit("pass")).otherwise(F.lit("drop")).alias("status"), reason.alias("reason"))


def released(rows: DataFrame, mined: Column, group: str, splits: Column, checks: dict[str, Column], per_bundle: int, bundle: list[str], order: list[Column]) -> DataFrame:
    """The release run: aligned rows are mined, the first of each bundle selected, split by what may not leak, and validated.

    Returns the selected rows with ``split``, ``eligible`` and ``failed_checks``.  A group is in one split, as
    ``splits`` is to depend on ``group`` alone.
    """
    hard = rows.filter(F.coalesce(mined, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*bundle).orderBy(*order))
    chosen = hard.withColumn("__n", place).filter(F.col("__n") <= per_bundle).drop("__n")
    judged = chosen.withColumn("split", splits).withColumn("__v", validity(checks))
    return judged.withColumns({"eligible": F.col("__v.eligible"), "failed_checks": F.array_join("__v.failed_checks", ",")}).drop("__v")
