"""Spatial joins: visible pairs, object relations, confusable objects, nearest neighbours, clutter."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import boxes, geometry, snapping
from lodestar.operators.joins import cell_join, closest

# Thresholds of the relations, in metres (overlap: share of the smaller area).
NEAR_GAP, ON_GAP, UNDER_GAP, MIN_OVERLAP, INSIDE_SLACK = 0.60, 0.12, 0.60, 0.25, 0.02
# At most so many targets and anchors of a cell go to one task of :func:`relation_counts` at once.
TARGETS, ANCHORS = 8192, 131_072
# And so many samples of a tile to one of :func:`snapped_paths`.
SAMPLES = 65_536


def pairs_within(df: DataFrame, group: list[str], id_col: str, x: str, y: str, radius: float) -> DataFrame:
    """(group, src, dst, distance) of all ordered pairs of a group within a radius, both directions.

    Points meet through grid cells, so pairs farther apart than two cells are never formed.
    """
    a = df.select(*group, F.col(id_col).alias("src"), F.col(x).alias("__ax"), F.col(y).alias("__ay"))
    b = df.select(*group, F.col(id_col).alias("dst"), F.col(x).alias("__bx"), F.col(y).alias("__by"))
    near = cell_join(a, b, group, F.col("__ax"), F.col("__ay"), F.col("__bx"), F.col("__by"), radius)
    return near.filter("src <> dst").select(*group, "src", "dst", F.round(F.hypot(F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")), 4).alias("distance"))


def neighbour_lists(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Each source with its neighbours by id."""
    return pairs.groupBy(*group, "src").agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("display_id"), F.col("distance").alias("distance_m")))).alias("neighbours"))


def _celled(objects: DataFrame, group: list[str]) -> DataFrame:
    """Boxes with a cell (__gx, __gy) as wide as the group's largest box and the gap that every relation keeps."""
    reach = objects.groupBy(*group).agg((F.max(F.greatest("sx", "sy")) + NEAR_GAP + INSIDE_SLACK).alias("__reach"))
    cell = lambda name: F.floor(F.col(name) / F.col("__reach")).cast("long")
    return objects.join(reach, group).withColumns({"__gx": cell("cx"), "__gy": cell("cy")}).drop("__reach")


def _dealt_around(celled: DataFrame) -> DataFrame:
    """Each row once for its cell and once for each of the eight around it."""
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    x = celled.withColumn("__dx", around).withColumn("__dy", around)
    return x.withColumns({"__gx": F.col("__gx") + F.col("__dx"), "__gy": F.col("__gy") + F.col("__dy")})


def relations(objects: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """(group, target, anchor, type, margin) for ordered pairs of boxes with centre cx, cy, cz and size sx, sy, sz.

    Every relation bounds the gap between the boxes in the plane, so pairs meet through cells as wide
    as the group's largest box and that gap; boxes farther apart than two cells are never paired.
    """
    c = F.col
    celled = _celled(objects, group)
    side = lambda p: celled.select(*group, F.col(id_col).alias(f"{p}id"), "__gx", "__gy", *[F.col(n).alias(f"{p}{n}") for n in ("cx", "cy", "cz", "sx", "sy", "sz")])
    x = side("a_").join(_dealt_around(side("b_")).drop("__dx", "__dy"), [*group, "__gx", "__gy"]).filter("a_id <> b_id")
    flat = lambda p: (c(f"{p}cx"), c(f"{p}cy"), c(f"{p}sx"), c(f"{p}sy"))
    overlap, gap = geometry.overlap_ratio(*flat("a_"), *flat("b_")), geometry.edge_gap(*flat("a_"), *flat("b_"))
    bottom, top = (lambda p: c(f"{p}cz") - c(f"{p}sz") / 2), (lambda p: c(f"{p}cz") + c(f"{p}sz") / 2)
    rest, clear = F.abs(bottom("a_") - top("b_")), bottom("b_") - top("a_")
    ends = lambda p, axis, sign: c(f"{p}c{axis}") + sign * c(f"{p}s{axis}") / 2
    depth = F.least(*[f for axis in "xyz" for f in (ends("a_", axis, -1) - ends("b_", axis, -1), ends("b_", axis, 1) - ends("a_", axis, 1))])
    known = sum((c(f"{p}{n}") for p in ("a_", "b_") for n in ("cx", "cy", "cz", "sx", "sy", "sz")), F.lit(0.0)).isNotNull()
    # Measures first, each once; the array is exploded whole and filtered afterwards, as a function on it would take the tests out of generated code.
    measured = {"gap": gap, "overlap": overlap, "rest": rest, "clear": clear, "depth": F.when(known, depth), "above": c("a_cz") > c("b_cz"), "below": c("a_cz") < c("b_cz")}
    x = x.select(*group, c("a_id").alias("target"), c("b_id").alias("anchor"), *[v.alias(f"__{k}") for k, v in measured.items()])
    gap, overlap, rest, clear, depth, above, below = (c(f"__{k}") for k in measured)
    found = F.array(
        *[
            F.when(test, F.struct(F.lit(name).alias("type"), F.round(margin, 6).alias("margin")))
            for name, test, margin in (
                ("near", gap <= NEAR_GAP, NEAR_GAP - gap),
                ("on", above & (rest <= ON_GAP) & (overlap >= MIN_OVERLAP), F.least(ON_GAP - rest, overlap - MIN_OVERLAP)),
                ("inside", depth >= -INSIDE_SLACK, depth + INSIDE_SLACK),
                ("under", below & clear.between(0, UNDER_GAP) & (overlap >= MIN_OVERLAP), F.least(UNDER_GAP - clear, overlap - MIN_OVERLAP)),
            )
        ]
    )
    return x.select(*group, "target", "anchor", F.explode(found).alias("r")).filter("r IS NOT NULL").select(*group, "target", "anchor", "r.type", "r.margin")


def relation_counts(objects: DataFrame, group: list[str], id_col: str, mark: str | None = None) -> DataFrame:
    """(group, target, type, n): how many of the relations of :func:`relations` each box has as target.

    With ``mark``, a whole number of each object, the counts are by that of the anchor too.  Boxes meet
    through the same cells, but in blocks that a task counts: no pair becomes a row, so shuffles carry objects
    and counts alone.  Crowded cells are dealt out to tasks; counts of an id may come in several rows.
    """
    c, at, pair = F.col, ["__gx", "__gy"], ["__tpart", "__apart"]
    known = F.col("cz").isNotNull() & F.col("sz").isNotNull()
    marked = objects.select(*group, c(id_col).alias("target"), (c(mark) if mark else F.lit(0)).cast("long").alias("mark"), known.alias("known"), *[c(n).cast("double").alias(n) for n in ("cx", "cy", "cz", "sx", "sy", "sz")])
    sized = _celled(marked, group).filter("target IS NOT NULL AND sx IS NOT NULL AND sy IS NOT NULL AND __gx IS NOT NULL AND __gy IS NOT NULL")
    here = (c("__dx") == 0) & (c("__dy") == 0)
    crowd = _dealt_around(sized.groupBy(*group, *at).agg(F.count("*").alias("__n"))).groupBy(*group, *at).agg(F.sum(F.when(here, c("__n"))).alias("__own"), F.sum("__n").alias("__all")).filter("__own IS NOT NULL")
    parts = crowd.select(*group, *at, F.ceil(c("__own") / TARGETS).alias("__tparts"), F.ceil(c("__all") / ANCHORS).alias("__aparts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), c(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("target", "cx", "cy", "cz", "sx", "sy", "sz"), c(n))
    targets = sized.drop("mark").join(parts, [*group, *at]).withColumn("__tpart", deal("__tparts")).withColumn("__apart", every("__aparts"))
    anchors = _dealt_around(sized).drop("__dx", "__dy").join(parts, [*group, *at]).withColumn("__apart", deal("__aparts")).withColumn("__tpart", every("__tparts"))
    keys = [*group, *at, *pair]
    limits = (NEAR_GAP, ON_GAP, INSIDE_SLACK, UNDER_GAP, MIN_OVERLAP)

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            code = pd.factorize(pd.concat([asked["target"], held["target"]], ignore_index=True))[0]
            a, a_id, held_id = boxes.faces(asked), code[: len(asked)], code[len(asked) :]
            for m in sorted(held["mark"].unique()):
                mine = (held["mark"] == m).to_numpy()
                n = boxes.count(a, a_id, boxes.faces(held[mine]), held_id[mine], *limits)
                found = n.any(axis=0)
                out.append(asked.loc[found, [*group, "target"]].assign(mark=m, **{t: v[found] for t, v in zip(boxes.TYPES, n, strict=True)}))
        names = [*group, "target", "mark", *boxes.TYPES]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    kinds = dict(marked.dtypes)
    schema = ", ".join([*[f"`{n}` {kinds[n]}" for n in (*group, "target")], "mark long", *[f"`{t}` long" for t in boxes.TYPES]])
    left = targets.drop("__tparts", "__aparts")
    right = anchors.select(*[c(n).alias(n) for n in anchors.columns if n not in (*group, "__tparts", "__aparts")], *[c(g).alias(g) for g in group])  # columns of its own, apart from the other side's
    wide = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), c(t).alias("n")) for t in boxes.TYPES]))
    told = wide.select(*group, "target", "mark", each.alias("r")).filter("r.n > 0")
    return told.select(*group, "target", "r.type", *([c("mark").alias(mark)] if mark else []), "r.n")


def uncertainty(margin: Column) -> Column:
    return F.when(margin >= 0.10, F.lit("low")).when(margin >= 0.03, F.lit("medium")).otherwise(F.lit("high"))


def project_relations(found: DataFrame, supported: DataFrame, confusable: DataFrame, group: list[str]) -> DataFrame:
    """Relations with the first reason for which a view can't use them; none: usable.

    ``supported`` and ``confusable`` have the group's columns and ``id``.
    """
    x = found.join(_marked(supported, group, "target", "__t"), [*group, "target"], "left").join(_marked(supported, group, "anchor", "__a"), [*group, "anchor"], "left").join(_marked(confusable, group, "anchor", "__c"), [*group, "anchor"], "left")
    return x.withColumn("reason", _reason(F.col("__t"), F.col("__a"), F.col("__c"))).drop("__t", "__a", "__c")


def _marked(ids: DataFrame, group: list[str], role: str, name: str) -> DataFrame:
    return ids.select(*group, F.col("id").alias(role), F.lit(True).alias(name)).distinct()


def _reason(target: Column, anchor: Column, confusable: Column) -> Column:
    """The first reason against a relation, from marks that are true or null."""
    return F.when(target.isNull(), F.lit("target_not_supported")).when(anchor.isNull(), F.lit("anchor_not_supported")).when(confusable.isNotNull(), F.lit("anchor_confusable"))


def projected_counts(objects: DataFrame, supported: DataFrame, confusable: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """(group, target, type, reason, n): how many relations of each box as target :func:`project_relations` gives a reason.

    Marks are put on the objects before they meet, so the joins are as long as the objects, not as their pairs.
    """
    c = F.col
    x = objects.join(_marked(supported, group, id_col, "__a"), [*group, id_col], "left").join(_marked(confusable, group, id_col, "__c"), [*group, id_col], "left")
    x = x.withColumn("__mark", c("__a").isNotNull().cast("int") + 2 * c("__c").isNotNull().cast("int"))
    n = relation_counts(x, group, id_col, "__mark").join(_marked(supported, group, "target", "__t"), [*group, "target"], "left")
    true = lambda bit: F.when(c("__mark").bitwiseAND(bit) > 0, F.lit(True))
    return n.select(*group, "target", "type", _reason(c("__t"), true(1), true(2)).alias("reason"), "n")


def confusable(objects: DataFrame, group: list[str], id_col: str, limits: tuple[float, float, float] = (0.35, 1.5, 2.0)) -> DataFrame:
    """Ordered pairs of different category in one family that are close on screen, in depth and in size.

    ``objects`` has category, family, screen_x, screen_y, depth and size; unknown depth or size doesn't exclude a pair.
    Objects meet through cells as wide as the limit on screen.
    """
    names = ("category", "screen_x", "screen_y", "depth", "size")
    side = lambda p: objects.select(*group, "family", F.col(id_col).alias(f"{p}id"), *[F.col(c).alias(f"{p}{c}") for c in names])
    c, (screen, depth, size) = F.col, limits
    reach = screen * 2**0.5  # the limit holds along each axis
    x = cell_join(side("a_"), side("b_"), [*group, "family"], c("a_screen_x"), c("a_screen_y"), c("b_screen_x"), c("b_screen_y"), reach * (1 + 1e-9))
    near = F.greatest(F.abs(c("a_screen_x") - c("b_screen_x")), F.abs(c("a_screen_y") - c("b_screen_y"))) <= screen
    deep = F.coalesce(F.abs(c("a_depth") - c("b_depth")) <= depth, F.lit(True))
    alike = F.coalesce((c("a_size") / c("b_size")).between(1 / size, size), F.lit(True))
    return x.filter((c("a_id") != c("b_id")) & (c("a_category") != c("b_category")) & near & deep & alike).select(*group, c("a_id").alias("id"), c("b_id").alias("confuser"))


def nearest_neighbours(df: DataFrame, group: list[str], id_col: str, coordinates: list[str]) -> DataFrame:
    """Each point's distance to the closest other point of its group."""
    places = df.groupBy(*group, *coordinates).agg(F.count("*").alias("__n"))
    other = closest(places, places, group, coordinates, apart=True)
    nearest = F.when(F.col("__n") > 1, F.lit(0.0)).otherwise(F.col("distance"))
    told = places.join(other, [*group, *coordinates], "left").select(*group, *coordinates, nearest.alias("nearest")).filter("nearest IS NOT NULL")
    return df.select(*group, id_col, *coordinates).join(told, [*group, *coordinates]).select(*group, id_col, "nearest")


def lattice_edges(nodes: DataFrame, group: list[str], id_col: str, gx: str, gy: str, stride: int) -> DataFrame:
    """Edges between the eight neighbours at a stride, each once (greater id as target)."""
    steps = F.explode(F.array(*[F.struct(F.lit(i * stride).alias("i"), F.lit(j * stride).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    a = nodes.select(*group, F.col(id_col).alias("source"), F.col(gx).alias("__x"), F.col(gy).alias("__y"), steps.alias("s"))
    a = a.select(*group, "source", (F.col("__x") + F.col("s.i")).alias(gx), (F.col("__y") + F.col("s.j")).alias(gy))
    return a.join(nodes.select(*group, F.col(id_col).alias("target"), gx, gy), [*group, gx, gy]).filter("target > source").select(*group, "source", "target")


def snapped_paths(paths: DataFrame, points: DataFrame, group: list[str], key: str, id_col: str, step: float, reach: float) -> DataFrame:
    """(group, key, ids): the points that a path passes, in order and without immediate repeats.

    ``paths``: group, key, hop, x0, y0, x1, y1, a row for each straight hop; ``points``: group, id, x, y.  Hops
    are sampled at equal steps; a sample takes the nearest point within ``reach`` (to nine decimals, ties: least
    id), and one without any is skipped.  Samples meet points through tiles four times as wide, in blocks that
    a task searches: no pair becomes a row.  A crowded tile's samples are dealt out to tasks.
    """
    c, at = F.col, ["__gx", "__gy"]
    finite = lambda df, *names: df.filter(" AND ".join(f"abs({n}) < double('infinity')" for n in names))
    wide, edge = 4 * reach, reach * (1 + 1e-9)  # rounding must not part a sample and a point at just the reach
    tile = lambda v: F.floor(v / wide).cast("long")
    spots = paths.select(*group, key, "hop", F.posexplode(geometry.segment_samples(c("x0"), c("y0"), c("x1"), c("y1"), step)).alias("i", "p"))
    spots = finite(spots.select(*group, key, "hop", "i", c("p.x").alias("__px"), c("p.y").alias("__py")), "__px", "__py").withColumns({"__gx": tile(c("__px")), "__gy": tile(c("__py"))})
    parts = spots.groupBy(*group, *at).agg(F.ceil(F.count("*") / SAMPLES).alias("__parts"))
    asked = spots.join(parts, [*group, *at]).withColumn("__part", F.pmod(F.xxhash64(key, "hop", "i"), c("__parts"))).drop("__parts")
    held = finite(points.select(*group, c(id_col).alias("__id"), c("x").cast("double").alias("__qx"), c("y").cast("double").alias("__qy")).filter("__id IS NOT NULL"), "__qx", "__qy")
    for g, q in zip(at, ("__qx", "__qy"), strict=True):
        held = held.withColumn(g, F.explode(F.sequence(tile(c(q) - edge), tile(c(q) + edge))))
    held = held.join(parts, [*group, *at]).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), c("__parts") - 1)))
    held = held.select(*[c(n).alias(n) for n in (*group, *at, "__part", "__id", "__qx", "__qy")])  # columns of its own, apart from the other side's
    names = [*group, key, "hop", "i"]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        order = pc.sort_indices(held["__id"])
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        found = snapping.nearest_within(*(t[n].to_numpy() for t, n in ((asked, "__px"), (asked, "__py"), (held, "__qx"), (held, "__qy"))), rank, reach)
        taken = asked.select(names).filter(pa.array(found >= 0))
        return taken.append_column("id", held["__id"].take(order).take(pa.array(found[found >= 0])))

    kinds = dict(asked.dtypes)
    schema = ", ".join([*[f"`{n}` {kinds[n]}" for n in names], f"id {dict(held.dtypes)['__id']}"])
    keys = [*group, *at, "__part"]
    taken = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, schema)
    w = Window.partitionBy(*group, key).orderBy("hop", "i")
    kept = taken.withColumn("__before", F.lag("id").over(w)).filter(~c("id").eqNullSafe(c("__before")))
    return kept.groupBy(*group, key).agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "i", "id"))), lambda x: x.id).alias("ids"))


def path_deviation(predicted: DataFrame, reference: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Mean over the predicted points of the distance to the nearest reference point."""
    places = predicted.groupBy(*group, x, y).agg(F.count("*").alias("__n"))
    near = places.join(closest(places, reference, group, [x, y]), [*group, x, y])
    return near.groupBy(*group).agg((F.sum(F.col("distance") * F.col("__n")) / F.sum("__n")).alias("deviation"))


def met_boxes(points: DataFrame, boxes: DataFrame, group: list[str], margin: float, how: str) -> DataFrame:
    """Points (x, y) joined with the boxes (cx, cy, sx, sy, yaw) that may lie within the margin.

    They meet through cells as wide as half the diagonal of the group's largest box and the margin.
    """
    reach = boxes.groupBy(*group).agg((F.max(F.hypot("sx", "sy")) / 2 + margin + 1e-9).alias("__reach"))
    cell = lambda c: F.floor(F.col(c) / F.col("__reach")).cast("long")
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = boxes.join(reach, group).withColumn("__dx", around).withColumn("__dy", around).withColumns({"__gx": cell("cx") + F.col("__dx"), "__gy": cell("cy") + F.col("__dy")}).drop("__reach", "__dx", "__dy")
    placed = points.join(reach, group, how).withColumns({"__gx": cell("x"), "__gy": cell("y")}).drop("__reach")
    return placed.join(near, [*group, "__gx", "__gy"], "left").drop("__gx", "__gy")


def box_collisions(points: DataFrame, boxes: DataFrame, group: list[str], point_id: str, inflate: float, box_id: str | None = None) -> DataFrame:
    """Share of each group's points inside any inflated box (cx, cy, sx, sy, yaw); with ``box_id`` a point's own box doesn't count."""
    inside = geometry.box_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("sx"), F.col("sy"), F.col("yaw")) <= inflate
    other = F.lit(True) if box_id is None else F.coalesce(F.col(box_id) != F.col(point_id), F.lit(True))
    hit = met_boxes(points, boxes, group, inflate, "inner").groupBy(*group, point_id).agg(F.max(F.coalesce(inside & other, F.lit(False)).cast("int")).alias("hit"))
    return hit.groupBy(*group).agg(F.avg("hit").alias("collision_rate"))


def clutter_facts(points: DataFrame, group: list[str], id_col: str, coordinates: list[str], close: float) -> DataFrame:
    """Per group: points, lower quartile of nearest distances (999 without any), share of close ones."""
    d = nearest_neighbours(points, group, id_col, coordinates)
    stats = d.groupBy(*group).agg(F.percentile("nearest", F.lit(0.25)).alias("p25"), F.sum((F.col("nearest") < close).cast("int")).alias("close"))
    total = points.groupBy(*group).agg(F.count("*").alias("points"))
    return total.join(stats, group, "left").select(*group, "points", F.coalesce("p25", F.lit(999.0)).alias("nearest_p25"), (F.coalesce("close", F.lit(0)) / F.greatest("points", F.lit(1))).alias("close_share"))


def competition(df: DataFrame, group: list[str], family: str, color: str, metric: str) -> DataFrame:
    """Every candidate with how many of its family share or differ in colour, and the gap to its nearest competitor (999: none)."""
    whole, same = Window.partitionBy(*group, family), Window.partitionBy(*group, family, color)
    w = whole.orderBy(metric)
    gap = F.least(F.lead(metric).over(w) - F.col(metric), F.col(metric) - F.lag(metric).over(w))
    return df.withColumns({"same_color": F.count("*").over(same) - 1, "other_color": F.count("*").over(whole) - F.count("*").over(same), "nearest_gap": F.coalesce(gap, F.lit(999.0))})


def surface_samples(objects: DataFrame, small: float = 400.0, wide: float = 1.8) -> DataFrame:
    """(columns of objects, px, py): one to three pixels on each object's box (x0, y0, x1, y1), more on large or elongated ones."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    at = lambda fx, fy: F.struct((F.col("x0") + w * fx).cast("int").alias("px"), (F.col("y0") + h * fy).cast("int").alias("py"))
    across, along = F.array(at(0.5, 0.5), at(0.25, 0.5), at(0.75, 0.5)), F.array(at(0.5, 0.5), at(0.5, 0.25), at(0.5, 0.75))
    spots = F.when(w * h < small, F.array(at(0.5, 0.5))).when(w > wide * h, across).when(h > wide * w, along).otherwise(F.array(at(0.5, 0.35), at(0.5, 0.65)))
    return objects.withColumn("__p", F.explode(spots)).select("*", "__p.px", "__p.py").drop("__p").distinct()
