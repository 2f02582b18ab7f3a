"""Ranking and sequence operators: cohort winners, cues, anchors, turns, runs and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.joins import closest


def cohort_winners(df: DataFrame, cohort: list[str], measure: str, id_col: str, eps: float, farthest: bool = False) -> DataFrame:
    """One row for each cohort: the extreme's least id, the extreme, how many ids tie within ``eps``, and the cohort's size."""
    extreme = F.max(measure) if farthest else F.min(measure)
    best = df.groupBy(*cohort).agg(extreme.alias("extreme"), F.count("*").alias("cohort_size"))
    near = df.join(best, cohort).filter(F.abs(F.col(measure) - F.col("extreme")) <= eps)
    return near.groupBy(*cohort).agg(F.min(id_col).alias("winner"), F.first("extreme").alias("extreme"), F.countDistinct(id_col).alias("tied"), F.first("cohort_size").alias("cohort_size"))


def annotate_cohort(df: DataFrame, cohort: list[str], measure: str, id_col: str) -> DataFrame:
    """Every row with its cohort's size, its place by (measure, id), and the gap to the next member."""
    w = Window.partitionBy(*cohort).orderBy(measure, id_col)
    whole = Window.partitionBy(*cohort)
    return df.withColumns({"cohort_size": F.count("*").over(whole), "place": F.row_number().over(w), "next_gap": F.lead(measure).over(w) - F.col(measure)})


def distance_cue(place: Column, size: Column) -> Column:
    """nearer/farther among two, else closest/farthest and none in between."""
    return F.when(place == 1, F.when(size == 2, F.lit("nearer")).otherwise(F.lit("closest"))).when(place == size, F.when(size == 2, F.lit("farther")).otherwise(F.lit("farthest")))


def side_cue(place: Column, size: Column) -> Column:
    return F.when(place == 1, F.lit("left")).when(place == size, F.lit("right"))


def ordinal_cue(place: Column) -> Column:
    return F.when(place == 1, F.lit("first")).when(place == 2, F.lit("second"))


def first_allowed(cues: dict[str, Column], allowed: list[str]) -> Column:
    """The first allowed cue that is there, with its type."""
    return F.coalesce(*[F.when(cues[k].isNotNull(), F.struct(F.lit(k).alias("type"), cues[k].alias("value"))) for k in allowed])


def best_by(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a lexicographic order of any number of keys."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("__n = 1").drop("__n")


def extreme_with_margin(df: DataFrame, group: list[str], measure: str, id_col: str, margin: float) -> DataFrame:
    """(group, side, id): ends of a group whose gap to the runner-up reaches the margin, if all members have the measure."""
    w = Window.partitionBy(*group)
    x = df.withColumns({"__all": F.count("*").over(w), "__some": F.count(measure).over(w)}).filter("__all = __some AND __all > 1")
    low = x.withColumns({"__n": F.row_number().over(w.orderBy(measure, id_col)), "__gap": F.lead(measure).over(w.orderBy(measure, id_col)) - F.col(measure)})
    high = x.withColumns({"__n": F.row_number().over(w.orderBy(F.col(measure).desc(), id_col)), "__gap": F.col(measure) - F.lead(measure).over(w.orderBy(F.col(measure).desc(), id_col))})
    pick = lambda d, side: d.filter((F.col("__n") == 1) & (F.col("__gap") >= margin)).select(*group, F.lit(side).alias("side"), id_col)
    return pick(low, "least").unionByName(pick(high, "greatest"))


def steps(df: DataFrame, group: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Ordered points with the move from the one before, the running length and the turn at each point in degrees."""
    from lodestar.functions.geometry import turn_degrees

    w = Window.partitionBy(*group).orderBy(*order)
    moved = df.withColumns({"dx": F.col(x) - F.lag(x).over(w), "dy": F.col(y) - F.lag(y).over(w)})
    moved = moved.withColumn("step", F.coalesce(F.hypot("dx", "dy"), F.lit(0.0)))
    ahead = moved.withColumns({"__nx": F.lead("dx").over(w), "__ny": F.lead("dy").over(w), "travelled": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    return ahead.withColumn("turn", turn_degrees(F.col("dx"), F.col("dy"), F.col("__nx"), F.col("__ny"))).drop("__nx", "__ny")


def directions(heading_change: Column, step: Column) -> Column:
    """left, right or straight for a heading change in radians, wrapped to half turns; then whether one moves."""
    import math

    wrapped = F.pmod(heading_change + math.pi, F.lit(2 * math.pi)) - math.pi
    turn = F.when(wrapped > math.radians(5), F.lit("turn_left")).when(wrapped < -math.radians(5), F.lit("turn_right"))
    return F.array_compact(F.array(turn, F.when(step > 0.05, F.lit("forward"))))


def without_repeats(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__p", F.lag(value).over(w)).withColumn("__f", F.row_number().over(w)).filter((F.col("__f") == 1) | ~F.col(value).eqNullSafe(F.col("__p"))).drop("__p", "__f")


def display_ids(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """1-based numbers within groups, and the same as text of three digits."""
    x = df.withColumn("display_id", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return x.withColumn("candidate_id", F.format_string("%03d", "display_id"))


def shard(df: DataFrame, group: list[str], order: list[str], count: int) -> DataFrame:
    """The number of each row's shard: its index within its group modulo the count."""
    return df.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1, F.lit(count)))


def match_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Every row with how many rows share its values."""
    return df.withColumn("matches", F.count("*").over(Window.partitionBy(*by)))


def unused_winner(df: DataFrame, used: DataFrame, group: list[str], order: list[Column], id_col: str) -> DataFrame:
    """The first row of each group whose id isn't used yet."""
    return best_by(df.join(used.select(id_col).distinct(), id_col, "left_anti"), group, order)


def start_anchor(df: DataFrame, group: list[str], id_col: str, snap: float) -> DataFrame:
    """Per group the point nearest to its anchor, then to the bottom centre of the screen, then in depth; none beyond ``snap``.

    ``df`` has anchor_distance, screen_x, screen_y, depth; an unknown depth comes last.
    """
    order = F.struct("anchor_distance", F.abs("screen_x").alias("x"), F.abs(F.col("screen_y") + 1).alias("y"), F.coalesce("depth", F.lit(1e9)).alias("d"), F.col(id_col).alias("i"))
    return df.filter(F.col("anchor_distance") <= snap).groupBy(*group).agg(F.min(order).alias("o")).select(*group, F.col("o.i").alias(id_col), "o.anchor_distance")


def anchor_distances(df: DataFrame, anchors: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """Each candidate's least screen distance to any anchor of its group; both have screen_x and screen_y."""
    place = [*group, "screen_x", "screen_y"]
    found = closest(df, anchors, group, ["screen_x", "screen_y"]).withColumnRenamed("distance", "anchor_distance")
    return df.select(*place, id_col).join(found, place).groupBy(*group, id_col).agg(F.min("anchor_distance").alias("anchor_distance"))


def candidate_pools(df: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """Ids of each pool in order."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(id_col)).alias("pool"))


def path_complexity(df: DataFrame, group: list[str], order: list[str], x: str, y: str, threshold: float = 20.0) -> DataFrame:
    """Length, detour over the straight line, and turns of at least the threshold, of each path."""
    s = steps(df, group, order, x, y)
    ends = s.groupBy(*group).agg(F.sum("step").alias("length"), F.sum((F.col("turn") >= threshold).cast("int")).alias("turns"), F.min(F.struct(*order, F.col(x).alias("__x"), F.col(y).alias("__y"))).alias("a"), F.max(F.struct(*order, F.col(x).alias("__x"), F.col(y).alias("__y"))).alias("b"))
    straight = F.hypot(F.col("a.__x") - F.col("b.__x"), F.col("a.__y") - F.col("b.__y"))
    return ends.select(*group, "length", (F.col("length") / F.greatest(straight, F.lit(1e-6))).alias("detour"), F.coalesce("turns", F.lit(0)).alias("turns"))
