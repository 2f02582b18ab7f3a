"""Reports: quality of answers of other kinds, of generations, of views and of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.stats import mean_relative_accuracy


def mixed_accuracy(rows: DataFrame, kind: str, numeric: list[str], merged: dict[str, str]) -> DataFrame:
    """(kind, n, accuracy): share of right answers by kind, mean relative accuracy for numeric kinds.

    ``rows`` has prediction and target as text.  Kinds that ``merged`` names are averaged under a
    common name; the row named ``overall`` is the mean over all names.
    """
    number = lambda c: F.col(c).try_cast("double")
    exact = (F.lower(F.trim("prediction")) == F.lower(F.trim("target"))).cast("double")
    score = F.when(F.col(kind).isin(numeric), mean_relative_accuracy(number("prediction"), number("target"))).otherwise(F.coalesce(exact, F.lit(0.0)))
    per = rows.groupBy(kind).agg(F.count("*").alias("n"), F.avg(score).alias("accuracy"))
    name = F.coalesce(*[F.when(F.col(kind) == a, F.lit(b)) for a, b in merged.items()], F.col(kind)) if merged else F.col(kind)
    named = per.groupBy(name.alias(kind)).agg(F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy"))
    return named.unionByName(named.agg(F.lit("overall").alias(kind), F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy")))


def generation_report(rows: DataFrame, key: str, position: Column, task: str, status: str) -> DataFrame:
    """By task: latest row of each id, how many accepted and rejected, and whether less than a hundredth is rejected."""
    w = Window.partitionBy(key).orderBy(position.desc())
    latest = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    of = lambda s: F.sum((F.col(status) == s).cast("int"))
    return latest.groupBy(task).agg(F.count("*").alias("n"), of("accepted").alias("accepted"), of("rejected").alias("rejected"), (of("rejected") / F.count("*") < 0.01).alias("ready"))


def routed(rows: DataFrame, accepted: DataFrame, packets: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of rows by where they go: already accepted, without packet, without text, or to be checked."""
    mark = lambda d, name: d.select(key).distinct().withColumn(name, F.lit(True))
    x = rows.join(mark(accepted, "__a"), key, "left").join(mark(packets, "__p"), key, "left")
    status = F.when(F.col("__a"), F.lit("skipped")).when(F.col("__p").isNull(), F.lit("missing_packet")).when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("no_text")).otherwise(F.lit("to_check"))
    return x.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def view_ambiguity(objects: DataFrame, view: list[str], same_type: str, supported: str, id_col: str) -> DataFrame:
    """By view and type: supported objects, their ids, and whether the type is empty, unique or ambiguous."""
    ids = F.array_sort(F.collect_list(F.when(F.col(supported), F.col(id_col))))
    x = objects.groupBy(*view, same_type).agg(F.sum(F.col(supported).cast("int")).alias("supported"), ids.alias("witnesses"))
    return x.withColumn("status", F.when(F.col("supported") == 0, F.lit("empty")).when(F.col("supported") == 1, F.lit("unique")).otherwise(F.lit("ambiguous")))


def edge_support(legal: Column, center: Column, corridor: Column, body: Column, center_min: float, corridor_min: float) -> Column:
    """Support class of an edge.

    ``center`` and ``corridor`` are structs of what is seen along the line and along the lanes of a
    body: in_frame_fraction, visually_free_fraction, in_frame_count, foreground_count, object_pixel_count.
    """
    pick = lambda name: F.when(body, corridor[name]).otherwise(center[name])
    seen = (center["in_frame_fraction"] >= center_min) & (center["visually_free_fraction"] >= center_min) & (pick("in_frame_fraction") >= corridor_min) & (pick("visually_free_fraction") >= corridor_min)
    foreground = pick("foreground_count") >= F.greatest(F.lit(1), F.ceil(0.02 * pick("in_frame_count")))
    blocked = F.when(foreground, F.lit("depth_obstruction_evidence")).when(pick("object_pixel_count") > 0, F.lit("object_only_obstruction_cue")).otherwise(F.lit("uncertain_blocked"))
    return F.when(legal, F.when(F.coalesce(seen, F.lit(False)), F.lit("observable_safe")).otherwise(F.lit("uncertain_safe"))).otherwise(blocked)


def support_by_question(edges: DataFrame, question: list[str], label: str) -> DataFrame:
    """Whether any and whether all edges of a question are supported."""
    ok = F.col(label) == "observable_safe"
    return edges.groupBy(*question).agg(F.count("*").alias("edges"), F.max(ok).alias("any_supported"), F.min(ok).alias("all_supported"))


def collision_summary(free_share: Column, loaded: Column, empty: Column) -> Column:
    """Share in collision; -1 where nothing could be loaded, 1 for an empty path."""
    return F.when(~loaded, F.lit(-1.0)).when(empty, F.lit(1.0)).otherwise(1 - free_share)


def by_sets(rows: DataFrame, sets: list[list[str]], value: str, unknown: float = -1.0) -> DataFrame:
    """Means over all rows and by each of several groupings in one pass; unknown values don't count."""
    names = sorted({c for s in sets for c in s})
    known = F.when(F.col(value) != unknown, F.col(value))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(known), F.lit(unknown)), 6).alias("mean"))


def severity_order(rows: DataFrame, status: str, codes: str, key: str) -> DataFrame:
    """Rows that aren't aligned, contradicted ones first, then those with more codes."""
    return rows.filter(F.col(status) != "aligned").orderBy((F.col(status) == "contradicted").desc(), F.size(codes).desc(), key)
