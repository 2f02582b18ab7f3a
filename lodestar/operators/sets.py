"""Set algebra on edges and on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def undirected_set(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Each undirected edge once, ends in order."""
    return edges.select(*keys, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct()


def edge_flips(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: edges that only one side has, edges of either, and their ratio."""
    x = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), [*keys, "u", "v"], "full_outer")
    flipped = F.sum((F.col("__a").isNull() | F.col("__b").isNull()).cast("long"))
    return x.groupBy(*keys).agg(flipped.alias("flipped"), F.count("*").alias("either"), F.round(flipped / F.count("*"), 6).alias("flip_rate"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def visited_cells(points: Column, size: float) -> Column:
    """Distinct cells of ``array<struct<x,y>>``."""
    return F.array_distinct(F.transform(points, lambda p: F.struct(F.floor(p.x / size).alias("x"), F.floor(p.y / size).alias("y"))))
