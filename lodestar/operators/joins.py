"""Joins with the rules that scoring needs: null-fill, last row wins, key checks, hops and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.geometry import distance


def last_wins(df: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """The row with the greatest position of each key."""
    w = Window.partitionBy(*keys).orderBy(position.desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def null_fill(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Left join that fills the listed null fields; ``right`` must be unique on the keys."""
    filled = right.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = left.join(filled, keys, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in left.columns], *[F.col(f"__{f}").alias(f) for f in fields if f not in left.columns])


def key_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side's name."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def misaligned(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of both sides whose fields differ, null-safely."""
    a = left.select(*keys, F.struct(*fields).alias("left_value"))
    b = right.select(*keys, F.struct(*fields).alias("right_value"))
    return a.join(b, keys).filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def hops(path: Column) -> Column:
    """Consecutive pairs of an id array."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, 1, n), F.slice(path, 2, n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions of every edge."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(src, dst, *rest).unionByName(edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest))


def hop_sums() -> list[Column]:
    """Aggregates of hops (pos, dst, and distance where legal): how many, how many legal, whether the first is, and the legal length."""
    return [
        F.count("dst").alias("hops"),
        F.count("distance").alias("legal_hops"),
        F.max(F.when((F.col("pos") == 0) & F.col("distance").isNotNull(), 1).otherwise(0)).alias("first_legal"),
        F.sum("distance").alias("length"),
    ]


def route_edges(routes: DataFrame, edges: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Per route: hops, legal hops, whether the first is legal, and the legal length.

    ``edges`` has src, dst, distance (and any columns it shares with the routes' keys).
    """
    shared = [c for c in edges.columns if c in keys]
    each = routes.select(*keys, F.posexplode(hops(F.col(path))).alias("pos", "hop")).select(*keys, "pos", "hop.src", "hop.dst")
    hit = each.join(edges.select(*shared, "src", "dst", "distance"), [*shared, "src", "dst"], "left")
    return hit.groupBy(*keys).agg(*hop_sums())


def nearest(points: DataFrame, targets: DataFrame, group: list[str], metric: Column, point_id: str, target_id: str, ties: list[Column] | None = None) -> DataFrame:
    """For each point the target of its group with the least metric, ties by the given columns and the id.

    The metric may use columns of both sides, so all pairs of a group are compared; for the plain
    distance :func:`closest` isn't quadratic in a group.  A null metric is no match.
    """
    pairs = points.join(targets, group).filter(metric.isNotNull())
    order = F.struct(metric.alias("m"), *[c.alias(f"t{i}") for i, c in enumerate(ties or [])], F.col(target_id))
    best = pairs.groupBy(*group, point_id).agg(F.min(order).alias("b"))
    return best.select(*group, point_id, F.col(f"b.{target_id}").alias(target_id), F.col("b.m").alias("metric"))


def cell_join(left: DataFrame, right: DataFrame, keys: list[str], lx: Column, ly: Column, rx: Column, ry: Column, radius: float) -> DataFrame:
    """Pairs within a radius in the plane: one side is dealt to the nine cells around it, so it is an equi-join.

    Both sides need distinct column names apart from the keys.
    """
    wide = radius * (1 + 1e-9)  # rounding must not put a pair at just the radius two cells apart
    cell = lambda v: F.floor(v / wide).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    a = left.withColumn("__cx", cell(lx)).withColumn("__cy", cell(ly))
    b = right.withColumn("__dx", around).withColumn("__dy", around).withColumn("__cx", cell(rx) + F.col("__dx")).withColumn("__cy", cell(ry) + F.col("__dy"))
    return a.join(b.drop("__dx", "__dy"), [*keys, "__cx", "__cy"]).filter(F.hypot(lx - rx, ly - ry) <= radius).drop("__cx", "__cy")


def _around(cell: Column, dimensions: int) -> Column:
    """An array of a cell and all that touch it."""
    steps = [[]]
    for _ in range(dimensions):
        steps = [[*s, i] for s in steps for i in (-1, 0, 1)]
    return F.array(*[F.array(*[cell[d] + i for d, i in enumerate(s)]) for s in steps])


def closest(points: DataFrame, targets: DataFrame, group: list[str], coordinates: list[str], target_id: str | None = None, apart: bool = False, levels: int = 16) -> DataFrame:
    """(group, coordinates, distance and, if named, target_id): for each place of a point the closest target of its group.

    Both sides name their one to three coordinates alike.  Ties go to the least id; with ``apart`` a
    target at the very place doesn't count.  Rows without finite coordinates are left out, as are points
    of groups without a target.

    Repeated places collapse first.  Grids whose cells double in width from level to level are laid over
    a group.  The finest level at which a target lies in the cells around a point bounds its distance by
    twice a cell's diagonal, less than four cells, so all that may be closer lies in the cells around it
    two levels up: two equi-joins, in which crowded places meet few targets each, however large the group.
    """
    finite = lambda df: df.filter(" AND ".join(f"abs(`{c}`) < double('infinity')" for c in coordinates))
    places = finite(points.select(*group, *coordinates)).distinct()
    best = F.min(target_id) if target_id else F.min(F.lit(0))
    spots = finite(targets.select(*group, *coordinates, *([target_id] if target_id else []))).groupBy(*group, *coordinates).agg(best.alias("__t"))
    ends = [f(c).alias(f"__{name}_{c}") for c in coordinates for name, f in (("low", F.min), ("high", F.max))]
    extent = F.greatest(F.lit(1e-300), *[F.col(f"__high_{c}") - F.col(f"__low_{c}") for c in coordinates])
    both = places.unionByName(spots.drop("__t")).groupBy(*group).agg(*ends)
    frame = both.select(*group, *[f"__low_{c}" for c in coordinates], extent.alias("__extent"))

    def laid(df: DataFrame) -> DataFrame:
        x = df.join(frame, group).withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        width = F.col("__extent") * F.pow(F.lit(2.0), F.col("__level") - levels)
        cell = F.array(*[F.floor((F.col(c) - F.col(f"__low_{c}")) / width).cast("long") for c in coordinates])
        return x.withColumn("__cell", cell).drop("__extent", *[f"__low_{c}" for c in coordinates])

    at = [*group, "__level", "__cell"]
    dealt = laid(spots)
    counts = dealt.groupBy(*at).agg(F.count("*").alias("__n"))
    near = counts.withColumn("__cell", F.explode(_around(F.col("__cell"), len(coordinates)))).groupBy(*at).agg(F.sum("__n").alias("__n")).filter(F.col("__n") >= (2 if apart else 1))
    finest = laid(places).join(near, at).groupBy(*group, *coordinates).agg(F.min("__level").alias("__least"))
    level = F.least(F.col("__least") + 2, F.lit(levels))
    x = laid(finest).filter(F.col("__level") == level).withColumn("__cell", F.explode(_around(F.col("__cell"), len(coordinates)))).drop("__least")
    x = x.join(dealt.withColumnsRenamed({c: f"__q_{c}" for c in coordinates}), at)
    d = distance([F.col(c) for c in coordinates], [F.col(f"__q_{c}") for c in coordinates])
    if apart:
        x = x.filter(" OR ".join(f"`{c}` <> `__q_{c}`" for c in coordinates))
    found = x.groupBy(*group, *coordinates).agg(F.min(F.struct(d.alias("d"), "__t")).alias("b"))
    return found.select(*group, *coordinates, F.col("b.d").alias("distance"), *([F.col("b.__t").alias(target_id)] if target_id else []))
