"""Plane and image geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance in as many dimensions as are given."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def _positive(x: Column) -> Column:
    """At least 0, null for null: ``greatest`` alone would skip the null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def box_distance(px: Column, py: Column, cx: Column, cy: Column, sx: Column, sy: Column, yaw: Column) -> Column:
    """Distance in the plane to a rotated rectangle; 0 inside, null if anything is unknown."""
    dx, dy = px - cx, py - cy
    u, v = dx * F.cos(yaw) + dy * F.sin(yaw), dy * F.cos(yaw) - dx * F.sin(yaw)
    return F.hypot(_positive(F.abs(u) - sx / 2), _positive(F.abs(v) - sy / 2))


def overlap_ratio(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Area shared by two upright boxes over the smaller area."""
    side = lambda c, s, d, t: F.when((c + s + d + t).isNotNull(), F.greatest(F.least(c + s / 2, d + t / 2) - F.greatest(c - s / 2, d - t / 2), F.lit(0.0)))
    return side(ax, aw, bx, bw) * side(ay, ah, by, bh) / F.greatest(F.least(aw * ah, bw * bh), F.lit(1e-9))


def edge_gap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Distance between the edges of two upright boxes."""
    side = lambda c, s, d, t: _positive(F.abs(c - d) - (s + t) / 2)
    return F.hypot(side(ax, aw, bx, bw), side(ay, ah, by, bh))


def pinhole(x: Column, y: Column, z: Column, fov_degrees: float, width: int, height: int, near: float = 0.05) -> Column:
    """Pixel and depth of a point in camera axes (right, up, forward); null if behind, near or outside."""
    import math

    f = 1.0 / math.tan(math.radians(fov_degrees) / 2)
    nx, ny = x / z * f / (width / height), y / z * f
    return F.when((z > near) & nx.between(-1, 1) & ny.between(-1, 1), F.struct(F.round((nx + 1) / 2 * (width - 1)).cast("int").alias("px"), F.round((1 - ny) / 2 * (height - 1)).cast("int").alias("py"), z.alias("depth")))


def to_local_frame(x: Column, y: Column, ox: Column, oy: Column, yaw: Column) -> Column:
    """Forward, right, distance and bearing of a point from a pose."""
    dx, dy = x - ox, y - oy
    forward, right = dx * F.cos(yaw) + dy * F.sin(yaw), dx * F.sin(yaw) - dy * F.cos(yaw)
    return F.struct(forward.alias("forward"), right.alias("right"), F.hypot(dx, dy).alias("distance"), F.atan2(right, forward).alias("bearing"))


def path_length(points: Column) -> Column:
    """Length of ``array<array<double>>`` over all dimensions."""
    hops = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)))
    return F.aggregate(hops, F.lit(0.0), lambda s, v: s + v)


def turn_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two segments; null where one has no length."""
    na, nb = F.hypot(ax, ay), F.hypot(bx, by)
    return F.when((na > 0) & (nb > 0), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (na * nb))))))


def segment_samples(x0: Column, y0: Column, x1: Column, y1: Column, step: float) -> Column:
    """Points at equal steps along a segment, both ends included."""
    n = F.greatest(F.ceil(F.hypot(x1 - x0, y1 - y0) / step).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((x0 + (x1 - x0) * i / n).alias("x"), (y0 + (y1 - y0) * i / n).alias("y")))


def index_samples(total: Column, count: int) -> Column:
    """Evenly spaced whole indices from 0 to total - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor((total - 1) * i / F.lit(max(count - 1, 1))).cast("long"))


def legacy_spl(success: Column, reference: Column, predicted: Column) -> Column:
    return F.when(success & (predicted > 0), reference / F.greatest(reference, predicted)).otherwise(0.0)


def to_pixel(x: Column, y: Column, width: int, height: int) -> Column:
    """Screen coordinates from -1 to 1 as pixels."""
    return F.struct(F.round((x + 1) / 2 * (width - 1)).cast("int").alias("px"), F.round((1 - y) / 2 * (height - 1)).cast("int").alias("py"))


def to_screen(px: Column, py: Column, width: int, height: int) -> Column:
    return F.struct((2 * px / (width - 1) - 1).alias("x"), (1 - 2 * py / (height - 1)).alias("y"))


def radius_pixels(depth: Column, radius: float, fov_degrees: float, height: int, low: int = 0, high: int = 12) -> Column:
    """A metric radius at a depth in pixels, clamped."""
    import math

    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(radius / F.greatest(depth, F.lit(1e-6)) * height / (2 * math.tan(math.radians(fov_degrees) / 2))).cast("int")))


def image_box(points: Column, width: int, height: int) -> Column:
    """Extent of ``array<struct<px,py>>`` (nulls left out) and its area inside the image; null for fewer than three."""
    seen = F.filter(points, lambda p: p.isNotNull())
    low, high = (lambda f: F.array_min(F.transform(seen, f))), (lambda f: F.array_max(F.transform(seen, f)))
    x0, x1, y0, y1 = low(lambda p: p.px), high(lambda p: p.px), low(lambda p: p.py), high(lambda p: p.py)
    clip = lambda v, size: F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(size - 1), v)))
    area = F.greatest(clip(x1, width) - clip(x0, width), F.lit(0)) * F.greatest(clip(y1, height) - clip(y0, height), F.lit(0))
    return F.when(F.size(seen) >= 3, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), area.alias("area")))


def keypoints(points: Column, turn_degrees_min: float = 20.0, spacing: float = 0.6) -> Column:
    """Of ``array<struct<x,y>>`` the ends, the turns, and points at least ``spacing`` from the last one kept."""
    n = F.size(points)

    def step(kept: Column, i: Column) -> Column:
        p, last, before, after = F.get(points, i), F.element_at(kept, -1), F.get(points, i - 1), F.get(points, i + 1)
        bend = turn_degrees(p.x - before.x, p.y - before.y, after.x - p.x, after.y - p.y)
        keep = (i == n - 1) | F.coalesce(bend >= turn_degrees_min, F.lit(False)) | (F.hypot(p.x - last.x, p.y - last.y) >= spacing)
        return F.when(keep, F.concat(kept, F.array(p))).otherwise(kept)

    return F.when(n < 2, points).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(points, 1, 1), step))
