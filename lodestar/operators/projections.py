"""Projections and predicates on question rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_or_nested(row: Column, key: str, kind: str, parent: str = "ground_truth") -> Column:
    """A field of a variant row: the top-level one if it is present, even as null, else the nested one."""
    present = F.array_contains(F.map_keys(F.try_variant_get(row, "$", "map<string,variant>")), key)
    return F.when(F.coalesce(present, F.lit(False)), F.try_variant_get(row, f"$.{key}", kind)).otherwise(F.try_variant_get(row, f"$.{parent}.{key}", kind))


def embodied(task: Column, semantics: Column, source_task: Column, diameter: Column, builder: bool = False) -> Column:
    """Whether a route is judged for a body; the builder takes task c for one, the scorer doesn't."""
    said = (task == "b2") | (semantics == "embodied") | (source_task == "b2") | (diameter > 0)
    return F.coalesce(task == "c", F.lit(False)) | F.coalesce(said, F.lit(False)) if builder else F.coalesce((task == "b2"), F.lit(False)) | F.coalesce(semantics == "embodied", F.lit(False)) | F.coalesce(source_task == "b2", F.lit(False)) | F.coalesce(diameter > 0, F.lit(False))


def feasible(is_embodied: Column, for_body: Column, for_point: Column) -> Column:
    return F.when(is_embodied, for_body).otherwise(for_point)


def view_of(view_id: Column, path: Column) -> Column:
    """The view's number, or else the one in the path."""
    found = F.regexp_extract(path, r"view_(\d+)", 1)
    return F.coalesce(view_id.cast("int"), F.when(found != "", found).cast("int"))


def non_null_json(**fields: Column) -> Column:
    """JSON of the fields that aren't null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def first_usable(*values: Column) -> Column:
    """The first value that is neither null nor 0; lists count as their length."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values])


def allowed_only(df: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """The allowed columns that are there; an allowed column that is forbidden too is an error."""
    if both := sorted(set(allowed) & set(forbidden)):
        raise ValueError(f"allowed and forbidden: {both}")
    return df.select(*[c for c in allowed if c in df.columns])


def sheets(df: DataFrame, key: str, answers: list[str]) -> tuple[DataFrame, DataFrame]:
    """The question sheet without answers, and the answer key."""
    return df.drop(*answers), df.select(key, *answers)


def by_level(df: DataFrame, levels: list[tuple[int, float, float]], first: Column, second: Column, always: Column) -> DataFrame:
    """Rows once for each nested level whose two thresholds they reach."""
    table = df.sparkSession.createDataFrame(levels, "level int, __low double, __share double")
    return df.withColumns({"__a": first, "__b": second, "__c": always}).join(F.broadcast(table), F.col("__c") & (F.col("__a") >= F.col("__low")) & (F.col("__b") >= F.col("__share"))).drop("__a", "__b", "__c", "__low", "__share")


def recognizable(area: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: int, height: int, min_area: float, border: float) -> Column:
    """Large enough and not touching the border band; coordinates outside the image don't count as touching."""
    touch = lambda v, size: v.between(0, border) | v.between(size - 1 - border, size - 1)
    return (area >= min_area) & ~(touch(x0, width) | touch(x1, width) | touch(y0, height) | touch(y1, height))


def surface_visible(center: Column, ratio: Column, large: Column, small_min: float, large_min: float) -> Column:
    return center & (ratio >= F.when(large, F.lit(large_min)).otherwise(F.lit(small_min)))


def admission(objects: DataFrame, scene: str, counts: tuple[int, int], area: tuple[float, float], reach: tuple[float, float], margin: float = 0.5) -> DataFrame:
    """(scene, objects, area, reason): the first reason why a scene isn't admitted; none: admitted.

    ``objects`` has the scene and x, y.  Whether some pair lies within a distance window is told from
    the extent where that decides it, and else from the pairs of the scene.
    """
    facts = objects.groupBy(scene).agg(F.count("*").alias("objects"), ((F.max("x") - F.min("x") + 2 * margin) * (F.max("y") - F.min("y") + 2 * margin)).alias("area"))
    a, b = objects.select(scene, "x", "y"), objects.select(scene, F.col("x").alias("__x"), F.col("y").alias("__y"))
    fit = a.join(b, scene).groupBy(scene).agg(F.max(F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")).between(*reach)).alias("pair"))
    reason = F.when(~F.col("objects").between(*counts), F.lit("object_count")).when(~F.col("area").between(*area), F.lit("area")).when(~F.col("pair"), F.lit("no_pair_in_window"))
    return facts.join(fit, scene).select(scene, "objects", "area", reason.alias("reason"))


def chat_row(prompt: Column, answer: Column) -> Column:
    """A conversation of two messages."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("user", prompt), said("assistant", answer))


def map_ids(ids: Column, lookup: Column) -> Column:
    """Ids through a map; those that it doesn't have are dropped."""
    return F.filter(F.transform(ids, lambda i: F.try_element_at(lookup, i)), lambda x: x.isNotNull())


def missing_paths(value: Column, paths: list[str]) -> Column:
    """The paths at which a variant has nothing."""
    return F.array_compact(F.array(*[F.when(F.try_variant_get(value, p, "variant").isNull(), F.lit(p)) for p in paths]))


def target_phrase(name: Column, color: Column, rule: Column) -> Column:
    """the nearest red chair"""
    return F.concat_ws(" ", F.lit("the"), rule, color, name)
