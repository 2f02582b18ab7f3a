"""Scores of set answers and of routes, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.stats import ratio
from lodestar.operators.joins import hops

#: First failing stage of a route, in the order of the gates.
STAGES = ("format", "invalid_id", "wrong_start", "illegal_edge", "wrong_goal", "non_shortest", "shortest")


def set_counts(universe: Column, truth: Column, prediction: Column) -> dict[str, Column]:
    """Counts for one question; a true id outside the universe is a miss, a null prediction is empty."""
    none = F.array().cast("array<bigint>")
    given = F.array_distinct(F.coalesce(prediction, none))
    u, t = F.array_distinct(universe), F.array_distinct(truth)
    p = F.array_intersect(given, u)
    size = lambda x: F.size(x).cast("long")
    rest = F.array_except(u, t)
    return {
        "invalid": size(F.array_except(given, u)),
        "tp": size(F.array_intersect(p, t)),
        "fp": size(F.array_except(p, t)),
        "fn": size(F.array_except(t, p)),
        "tn": size(F.array_except(rest, p)),
    }


def set_metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    """Micro-pooled precision, recall, accuracy, F1 and balanced accuracy, rounded to four digits."""
    pooled = counts.groupBy(*by).agg(F.count("*").alias("questions"), *[F.sum(c).cast("long").alias(c) for c in ("invalid", "tp", "fp", "fn", "tn")])
    c = F.col
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    accuracy = ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn"))
    balanced = (recall + ratio(c("tn"), c("tn") + c("fp"))) / 2
    values = {"precision": precision, "recall": recall, "f1": f1, "accuracy": accuracy, "balanced_accuracy": balanced}
    return pooled.select(*by, "questions", "invalid", "tp", "fp", "fn", "tn", *[F.round(v, 4).alias(k) for k, v in values.items()])


def route_flags(routes: DataFrame, strict: bool = True) -> DataFrame:
    """Gate flags of routes that carry path, visible, start, goals, optimal, hops, legal_hops, first_legal, length.

    The strict contract needs two ids and a start; the diagnostic one takes a single id and any start where none is set.
    """
    path = F.col("path")
    parsed = path.isNotNull() & (F.size(path) > 0)
    valid = parsed & (F.size(F.array_except(path, "visible")) == 0)
    begins = F.get(path, 0) == F.col("start")
    anchored = valid & ((F.coalesce(begins, F.lit(False)) & (F.size(path) >= 2)) if strict else F.coalesce(begins, F.lit(True)))
    legal = anchored & (F.coalesce("legal_hops", F.lit(0)) == F.greatest(F.size(path) - 1, F.lit(0)))
    success = legal & F.array_contains("goals", F.element_at(path, -1))
    no = F.lit(False)
    x = routes.withColumns({"parsed": F.coalesce(parsed, no), "valid": F.coalesce(valid, no), "anchored": F.coalesce(anchored, no), "legal": F.coalesce(legal, no), "success": F.coalesce(success, no)})
    spl = F.when(F.col("success"), F.col("optimal") / F.greatest("optimal", F.coalesce("length", F.lit(0.0)))).otherwise(0.0)
    return x.withColumn("spl_part", spl)


def failure_stage(tolerance: float = 1e-3) -> Column:
    """The first gate that a flagged route fails, or whether its length is the shortest."""
    c = F.col
    return (
        F.when(~c("parsed"), F.lit("format"))
        .when(~c("valid"), F.lit("invalid_id"))
        .when(~c("anchored"), F.lit("wrong_start"))
        .when(~c("legal"), F.lit("illegal_edge"))
        .when(~c("success"), F.lit("wrong_goal"))
        .when(c("length") > c("optimal") + tolerance, F.lit("non_shortest"))
        .otherwise(F.lit("shortest"))
    )


def route_metrics(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Gate rates over all questions; ``spl`` divides by successes, ``spl_all`` by all."""
    one = lambda name: F.sum(F.col(name).cast("int"))
    n = F.count("*")
    rate = lambda name: F.round(one(name) / n, 4)
    total = F.sum("spl_part")
    return flagged.groupBy(*by).agg(
        n.alias("questions"),
        rate("parsed").alias("parse_rate"),
        rate("valid").alias("valid_rate"),
        rate("legal").alias("legal_rate"),
        rate("success").alias("success_rate"),
        F.round(total / F.greatest(one("success"), F.lit(1)), 4).alias("spl"),
        F.round(total / n, 4).alias("spl_all"),
    )


def composite(set_scores: list[Column], route_scores: list[Column], chance_adjusted: bool = True) -> Column:
    """Mean of the set tasks' (chance-adjusted) balanced accuracies and the route tasks' success rates."""
    parts = [2 * s - 1 if chance_adjusted else s for s in set_scores] + list(route_scores)
    return sum(parts[1:], parts[0]) / len(parts)


def pooled(df: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates per group of all columns and per the first alone, which is named ``all`` in the others."""
    grouped = df.rollup(*by).agg(*aggregates, F.grouping_id().alias("__g")).filter(F.col("__g") < 2 ** (len(by)) - 1)
    return grouped.select(*[F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c) for c in by], *[c for c in grouped.columns if c not in by and c != "__g"])


def best_in_column(df: DataFrame, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """A flag for each column that says whether a row has its maximum."""
    top = df.agg(*[F.max(c).alias(f"__{c}") for c in columns])
    x = df.crossJoin(F.broadcast(top))  # one row
    return x.select(*df.columns, *[(F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance).alias(f"best_{c}") for c in columns])


def prefix_flags(path: Column, legal_pairs: Column) -> dict[str, Column]:
    """For a route and its legal pairs ``array<struct<src,dst>>``: eligibility, first hop, all hops, illegal suffix."""
    steps = hops(path)
    first = F.coalesce(F.array_contains(legal_pairs, F.get(steps, 0)), F.lit(False))
    every = F.forall(steps, lambda h: F.array_contains(legal_pairs, h))
    eligible = F.size(steps) > 0
    return {"eligible": eligible, "first_legal": eligible & first, "all_legal": eligible & every, "illegal_suffix": eligible & first & ~every}


def macro_means(df: DataFrame, group: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Unweighted means of per-task metrics; missing tasks are skipped."""
    return df.groupBy(*group).agg(*[F.round(F.avg(m), digits).alias(m) for m in metrics])


def ranked(df: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """Rows with their place by falling score.  Meant for tables of runs, which are few."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.col(score).desc(), *ties)))
