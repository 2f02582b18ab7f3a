"""Difficulty ladders: levels of single axes, tiers composed of them, and status ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH = "low", "medium", "high"


def _level(high: Column, low: Column) -> Column:
    return F.when(F.coalesce(high, F.lit(False)), F.lit(HIGH)).when(F.coalesce(low, F.lit(False)), F.lit(LOW)).otherwise(F.lit(MEDIUM))


def compose_tier(*levels: Column) -> Column:
    """Any high level or two medium ones make hard, one medium makes medium."""
    count = lambda name: sum((F.when(x == name, 1).otherwise(0) for x in levels), F.lit(0))
    return F.when((count(HIGH) > 0) | (count(MEDIUM) >= 2), F.lit("hard")).when(count(MEDIUM) == 1, F.lit("medium")).otherwise(F.lit("easy"))


# Limits of the two rule sets, v1 (older) and v2 (maintained).
GEOMETRY_LOW = {"v1": (3.0, 1.10, 1, 1), "v2": (3.0, 1.08, 0, 0)}
EMBODIMENT_LOW = {"v1": (0.20, None, 0.10, 0.30, 0, 0.85), "v2": (0.07, 0.07, 0.12, 0.30, 0, 0.90)}
EXTRA_LENGTH_HIGH, EXTRA_DECISIONS_HIGH = {"v1": 1.00, "v2": 0.60}, {"v1": 2, "v2": 1}
LEGACY_EASY, LEGACY_MEDIUM = (1.10, 1, 4.0, 0.10, 1), (1.35, 2, 7.0, 0.25, 2)
AXIS_SCORE = {LOW: 0, MEDIUM: 1, HIGH: 2}
REFERENCE_MODE_SCORE = {"category_only": 0, "distance_only": 1, "color_only": 2, "color_and_distance": 3, "relation_only": 3}


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def geometry_axis(length: Column, detour: Column, turns: Column, decisions: Column, policy: str = "v2") -> Column:
    low = _all([x <= limit for x, limit in zip((length, detour, turns, decisions), GEOMETRY_LOW[policy], strict=True)])
    if policy == "v1":
        return _level((length > 6.0) | (detour > 1.35) | (turns >= 4) | (decisions >= 3), low)
    return _level(((turns >= 2) & (decisions >= 1)) | ((length > 3.5) & (detour > 1.05) & (turns >= 1)), low)


def reference_axis(mode: Column, top2_gap: Column, cohort: Column, same_color: Column, other_color: Column | None = None, policy: str = "v2") -> Column:
    """How hard the target is to tell.  v2 never takes colour alone for low, and takes it for high among two others of other colours."""
    high = (mode == "color_and_distance") | (top2_gap < 0.40) | (cohort >= 3) | (same_color >= 2)
    apart = (top2_gap >= 0.80) & (cohort <= 1)
    if policy == "v1":
        return _level(high, (mode == "category_only") | (mode.isin("distance_only", "color_only") & apart))
    others = F.coalesce(other_color, F.lit(0)) if other_color is not None else F.lit(0)
    return _level(high | ((mode == "color_only") & (others >= 2)), (mode == "category_only") | ((mode == "distance_only") & apart))


def embodiment_axis(margin: Column, goal_margin: Column, narrow: Column, extra_length: Column, extra_decisions: Column, overlap: Column, policy: str = "v2") -> Column:
    """v1: any violation is high; v2: one of clearance and one along the route are needed."""
    clearance = (margin < 0.05) | (goal_margin < 0.05) | (narrow > 0.35)
    route = (overlap < 0.50) | (extra_length > EXTRA_LENGTH_HIGH[policy]) | (extra_decisions >= EXTRA_DECISIONS_HIGH[policy])
    least, least_goal, most_narrow, most_length, most_decisions, least_overlap = EMBODIMENT_LOW[policy]
    low = [margin >= least, narrow <= most_narrow, extra_length <= most_length, extra_decisions <= most_decisions, overlap >= least_overlap]
    if least_goal is not None:
        low.append(goal_margin >= least_goal)
    return _level((clearance | route) if policy == "v1" else (clearance & route), _all(low))


def clutter_axis(count: Column, nearest_p25: Column, overlap: Column) -> Column:
    return _level((count > 65) | (nearest_p25 < 28) | (overlap > 0.15), (count <= 35) & (nearest_p25 >= 42) & (overlap <= 0.05))


def boundary_axis(near_point: Column, near_body: Column) -> Column:
    return _level((near_point > 0.25) | (near_body > 0.25), (near_point <= 0.10) & (near_body <= 0.10))


def gap_axis(disagreement: Column, hard_negative: Column) -> Column:
    return _level((disagreement > 0.30) | (hard_negative > 0.20), disagreement <= 0.10)


def legacy_tier(detour: Column, turns: Column, length: Column, narrow: Column, cohort: Column) -> Column:
    fits = lambda limits: F.coalesce(_all([x <= n for x, n in zip((detour, turns, length, narrow, cohort), limits, strict=True)]), F.lit(False))
    return F.when(fits(LEGACY_EASY), F.lit("easy")).when(fits(LEGACY_MEDIUM), F.lit("medium")).otherwise(F.lit("hard"))


def _scored(value: Column, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def affordance_hardness(legality: Column, eligible: Column, tier: Column, clutter: Column, boundary: Column, gap: Column) -> Column:
    """Struct of score and rejection reasons of a set question; only one without reasons scores."""
    both = (boundary == HIGH) & (gap == HIGH)
    reasons = _reasons([(legality != "legal", F.concat(F.lit("human_visible_"), legality)), (~eligible, F.lit("affordance_ineligible")), (tier != "hard", F.lit("affordance_tier_not_hard")), (clutter != HIGH, F.lit("clutter_axis_not_high")), ((boundary != HIGH) & (gap != HIGH), F.lit("boundary_or_gap_not_high"))])
    return _judged(reasons, 25 + 5 * _scored(boundary, AXIS_SCORE) + 7 * _scored(gap, AXIS_SCORE) + F.when(both, 6).otherwise(0))


def navigation_hardness(legality: Column, eligible: Column, tier: Column, mode: Column, reference: Column, geometry: Column, embodiment: Column) -> Column:
    """The same for a route question; geometry weighs most."""
    reasons = _reasons([(legality != "legal", F.concat(F.lit("human_visible_"), legality)), (~eligible, F.lit("navigation_ineligible")), (tier != "hard", F.lit("navigation_tier_not_hard")), (mode == "category_only", F.lit("reference_resolution_category_only")), (reference == LOW, F.lit("reference_axis_low")), (geometry == LOW, F.lit("geometry_axis_low"))])
    score = 60 * _scored(geometry, AXIS_SCORE) + 8 * _scored(reference, AXIS_SCORE) + 5 * _scored(mode, REFERENCE_MODE_SCORE) + 2 * _scored(embodiment, AXIS_SCORE) + F.when(geometry == HIGH, 20).otherwise(0)
    return _judged(reasons, score)


def _reasons(tests: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for test, name in tests]))


def _judged(reasons: Column, score: Column) -> Column:
    return F.struct(F.when(F.size(reasons) == 0, score).otherwise(0).alias("score"), reasons.alias("reasons"))


def legality(support: Column, uniqueness: Column, truth: Column, leaks: Column) -> Column:
    """Whether a person could answer: leakage first, then support and uniqueness."""
    return F.when(leaks, F.lit("illegal")).when((support == "supported") & (uniqueness == "unique"), F.lit("legal")).when((truth == "reject") | (uniqueness == "ambiguous"), F.lit("illegal")).otherwise(F.lit("uncertain"))


def truth_bucket(status: Column) -> Column:
    return F.when(status.isin("reject", "uncertain", "contradicted"), F.lit("uncertain")).otherwise(F.lit("truth_aligned"))


def visibility_status(visible: Column, verified: Column, x: Column, y: Column) -> Column:
    on_screen = x.between(-1, 1) & y.between(-1, 1)
    return F.when(~F.coalesce(visible, F.lit(False)), F.lit("not_reliable")).when(F.coalesce(verified & on_screen, F.lit(False)), F.lit("visible")).otherwise(F.lit("partial"))


def color_name(r: Column, g: Column, b: Column) -> Column:
    """A name for a colour with channels from 0 to 1: dark and unsaturated ones first, then by the leading channel."""
    top, spread = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    flat = F.when(top > 0.82, F.lit("white")).when((top <= 0.55) & (r > g + 0.04), F.lit("brown")).otherwise(F.lit("gray"))
    brown = (r > 0.35) & (g > 0.18) & (b < 0.28) & (r > g) & (g > b)
    return (
        F.when(r.isNull() | g.isNull() | b.isNull(), F.lit("unknown"))
        .when(top < 0.12, F.lit("black"))
        .when(spread < 0.08, flat)
        .when(brown, F.lit("brown"))
        .when(r == top, F.when(g < 0.55, F.lit("red")).otherwise(F.lit("yellow")))
        .when(g == top, F.lit("green"))
        .otherwise(F.lit("blue"))
    )


def support_type(occluded: Column, walkable: Column, structural: Column, on_object: Column, source: Column) -> Column:
    """What a candidate point stands on; pixels tell before the source that proposed it."""
    said = lambda name: F.lower(F.trim(source)) == f"visible_{name}_surface"
    return (
        F.when(occluded, F.lit("excluded_occluded"))
        .when(walkable, F.lit("ground"))
        .when(structural, F.lit("structural_surface"))
        .when(on_object, F.lit("object_surface"))
        .when(said("structural"), F.lit("structural_surface"))
        .when(said("object"), F.lit("object_surface"))
        .otherwise(F.lit("plain_floor_blocked"))
    )


def resolution_mode(same_color: Column, other_color: Column) -> Column:
    """What tells a target from others of its group: their colour, the distance, both, or just its category."""
    same, other = same_color > 0, other_color > 0
    return F.when(same & other, F.lit("color_and_distance")).when(same, F.lit("distance_only")).when(other, F.lit("color_only")).otherwise(F.lit("category_only"))


def removable(category: Column, keep: list[str], remove: list[str], sx: Column, sy: Column, sz: Column, z: Column) -> Column:
    """Whether an object on the floor is clutter: small, and named as such or very small; kept names win.

    Names match either way round as parts of each other.
    """
    name = F.lower(F.trim(category))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w) | F.contains(w, name))
    volume, footprint = sx * sy * sz, sx * sy
    small = (z - sz / 2 <= 0.20) & (z + sz / 2 <= 0.6) & (footprint <= 0.5) & (volume <= 0.2)
    return ~has(keep) & small & (has(remove) | ((volume < 0.05) & (footprint < 0.15)))


def layout_consistent(relation: Column, target_x: Column, target_y: Column, anchor_x: Column, anchor_y: Column) -> Column:
    """Whether a relation agrees with where target and anchor are on the screen; unknown places don't."""
    beside = F.abs(target_x - anchor_x) <= 0.25
    agrees = F.when(relation == "under", beside & (target_y < anchor_y - 0.03)).when(relation == "on", beside & (target_y > anchor_y + 0.03)).otherwise(F.lit(True))
    return agrees & target_x.isNotNull() & target_y.isNotNull() & anchor_x.isNotNull() & anchor_y.isNotNull()


def why_not(reasons: Column) -> Column:
    """The alphabetically first reason, or that there is none."""
    return F.coalesce(F.array_min(reasons), F.lit("no_relation"))
