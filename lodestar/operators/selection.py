"""Limits, samples, goal rings and greedy selection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_top(df: DataFrame, group: str, order: list[Column], caps: DataFrame) -> DataFrame:
    """The first rows of each group, as many as its cap says; groups without a cap are left out.

    ``caps`` has the group's column and ``cap``, one row for each group.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.join(caps.select(group, F.col("cap").alias("__cap")), group).withColumn("place", place).filter("place <= __cap").drop("__cap")


def stable_order(id_col: Column, seed: int) -> Column:
    """A shuffled order that depends on the id and the seed alone."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def stable_sample(df: DataFrame, group: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, drawn by hash."""
    w = Window.partitionBy(*group).orderBy(stable_order(F.col(id_col), seed), id_col)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def stratified_fraction(df: DataFrame, group: list[str], order: list[str], fraction: float) -> DataFrame:
    """The first share of each group, one row at least."""
    w = Window.partitionBy(*group)
    quota = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * fraction))
    return df.withColumn("__q", quota).withColumn("__n", F.row_number().over(w.orderBy(*order))).filter("__n <= __q").drop("__q", "__n")


def stratified_limit(df: DataFrame, group: str, order: list[str], total: int) -> DataFrame:
    """Equal quotas for all groups, the remainder to the first ones; what small groups leave over goes to the next rows in order.

    Quotas come from the table of group sizes, which has a row for each group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__size"))
    everything = Window.partitionBy()
    base = sizes.withColumn("__k", F.count("*").over(everything)).withColumn("__i", F.row_number().over(Window.orderBy(group)))
    share = F.floor(F.lit(total) / F.col("__k")) + F.when(F.col("__i") <= F.lit(total) % F.col("__k"), 1).otherwise(0)
    quotas = base.withColumn("__quota", F.least(share, F.col("__size"))).withColumn("__left", F.lit(total) - F.sum("__quota").over(everything))
    spare = F.col("__size") - F.col("__quota")
    before = F.coalesce(F.sum(spare).over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = quotas.withColumn("__quota", F.col("__quota") + F.greatest(F.lit(0), F.least(spare, F.col("__left") - before))).select(group, "__quota")
    x = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return x.join(quotas, group).filter("__n <= __quota").drop("__n", "__quota")


def balanced_sample(df: DataFrame, group: list[str], positive: str, id_col: str, limit: int | Column, seed: int) -> DataFrame:
    """``limit`` rows of each group, or all of a smaller one, drawn by hash: negatives no fewer than positives while there are enough.

    Slots that scarce positives leave go to negatives, then those that scarce negatives leave to positives.
    """
    w = Window.partitionBy(*group)
    good = F.coalesce(F.col(positive), F.lit(False))
    x = df.withColumns({"__good": good, "__limit": F.greatest(F.lit(0), limit if isinstance(limit, Column) else F.lit(limit))})
    x = x.withColumns({"__p": F.sum(F.col("__good").cast("int")).over(w), "__n": F.sum((~F.col("__good")).cast("int")).over(w)})
    core = F.least("__p", "__n", F.floor(F.col("__limit") / 2))
    negatives = F.least(F.col("__n"), F.col("__limit") - core)
    positives = F.least(F.col("__p"), F.col("__limit") - negatives)
    place = F.row_number().over(Window.partitionBy(*group, "__good").orderBy(stable_order(F.col(id_col), seed), id_col))
    x = x.withColumn("__k", F.when(F.col("__good"), positives).otherwise(negatives)).withColumn("__i", place)
    return x.filter("__i <= __k").drop("__good", "__limit", "__p", "__n", "__k", "__i")


def classification_points(df: DataFrame, group: list[str], positive: str, surface: str, gap: str, id_col: str, limit: int, seed: int, surface_keep: int = 4, gap_keep: int = 4) -> DataFrame:
    """``limit`` rows of each group: some surface and then some body-gap rows are reserved, the rest is a balanced sample."""
    w = Window.partitionBy(*group)
    place = lambda flag: F.row_number().over(Window.partitionBy(*group, flag).orderBy(stable_order(F.col(id_col), seed), id_col))
    held = F.coalesce(F.sum(F.col("__held").cast("int")).over(w), F.lit(0))
    x = df.withColumn("__flag", F.coalesce(F.col(surface), F.lit(False)))
    x = x.withColumn("__held", F.col("__flag") & (place("__flag") <= min(limit, max(1, min(surface_keep, limit // 2)))))
    x = x.withColumn("__flag", F.coalesce(F.col(gap), F.lit(False)) & ~F.col("__held")).withColumn("__quota", F.least(F.lit(gap_keep), F.lit(limit) - held))
    x = x.withColumn("__held", F.col("__held") | (F.col("__flag") & (place("__flag") <= F.col("__quota"))))
    x = x.withColumn("__rest", F.lit(limit) - held)
    rest = balanced_sample(x.filter("NOT __held"), group, positive, id_col, F.col("__rest"), seed)
    return x.filter("__held").unionByName(rest).drop("__flag", "__held", "__quota", "__rest")


def radius_or_nearest(df: DataFrame, group: list[str], metric: str, id_col: str, radius: float, cap: int | None = None) -> DataFrame:
    """All rows within the radius, or else the nearest one; at most ``cap``."""
    w = Window.partitionBy(*group)
    x = df.withColumn("__near", F.sum((F.col(metric) <= radius).cast("int")).over(w)).withColumn("__n", F.row_number().over(w.orderBy(metric, id_col)))
    x = x.filter(((F.col("__near") > 0) & (F.col(metric) <= radius)) | ((F.col("__near") == 0) & (F.col("__n") == 1)))
    return (x if cap is None else x.filter(F.col("__n") <= cap)).drop("__near", "__n")


def goal_ring(df: DataFrame, group: list[str], metric: str, tolerance: float) -> DataFrame:
    """Rows whose rounded metric is within the tolerance of their group's least."""
    x = df.withColumn("__least", F.min(metric).over(Window.partitionBy(*group)))
    return x.filter(F.round(metric, 4) <= F.col("__least") + tolerance + 1e-9).drop("__least")


def target_score(metric: Column, volume: Column, verified: Column) -> Column:
    return 1 / (1 + F.abs(metric - 4)) * F.least(volume, F.lit(2.0)) * F.when(verified, 1.5).otherwise(1.0)


def thin(df: DataFrame, group: list[str], order: list[str], x: str, y: str, spacing: float) -> DataFrame:
    """Rows kept in order if they are at least ``spacing`` from all kept before them; a grid makes each test local."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable")
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        keep = []
        for a, b in zip(rows[x].to_numpy(float), rows[y].to_numpy(float), strict=True):
            i, j = int(np.floor(a / spacing)), int(np.floor(b / spacing))
            near = (p for di in (-1, 0, 1) for dj in (-1, 0, 1) for p in cells.get((i + di, j + dj), ()))
            free = all((a - u) ** 2 + (b - v) ** 2 >= spacing**2 for u, v in near)
            keep.append(free)
            if free:
                cells.setdefault((i, j), []).append((a, b))
        return rows[np.array(keep, bool)] if len(rows) else rows

    return df.groupBy(*group).applyInPandas(run, df.schema)


def greedy(df: DataFrame, group: list[str], id_col: str, objective: Callable[[dict, list[dict]], float], limit: int, least_wins: bool = False) -> DataFrame:
    """Rows chosen one at a time by the greatest gain given what is chosen (ties: greater id, or the least); stops when no gain is left.

    Meant for summaries (a row for each scene): a group is chosen from in one task.
    """
    fields = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        chosen: list[dict] = []
        while rows and len(chosen) < limit:
            scored = [(objective(r, chosen), r[id_col], i) for i, r in enumerate(rows)]
            top = max(s[0] for s in scored)
            gain, _, best = (min if least_wins else max)((s for s in scored if s[0] == top), key=lambda s: s[1])
            if gain <= 0:
                break
            chosen.append(rows.pop(best) | {"place": len(chosen) + 1, "gain": float(gain)})
        return pd.DataFrame(chosen, columns=[*pdf.columns, "place", "gain"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", place int, gain double"
    return df.groupBy(*group).applyInPandas(run, schema)


def window_objective(total: str, target: float, low: float, high: float) -> Callable[[dict, list[dict]], float]:
    """Gain of coming closer to a target sum, with a bonus inside a window and a penalty above it."""

    def value(s: float) -> float:
        return -abs(target - s) + (10_000 if low <= s <= high else 0) - 200 * max(0.0, s - high)

    return lambda row, chosen: value(sum(c[total] for c in chosen) + row[total]) - value(sum(c[total] for c in chosen))


def coverage_objective(items: str, weight: float = 6.0, base: str | None = None) -> Callable[[dict, list[dict]], float]:
    """Gain of items that no chosen row covers yet, plus a share of a base score."""

    def gain(row: dict, chosen: list[dict]) -> float:
        seen = {x for c in chosen for x in c[items]}
        return weight * len(set(row[items]) - seen) + (0.3 * row[base] if base else 0.0)

    return gain


def diversity_objective(base: str, items: str, bonus: float, overlap: float) -> Callable[[dict, list[dict]], float]:
    """A base score, a bonus for each item that no chosen row has, less the largest Jaccard overlap with a chosen row."""

    def gain(row: dict, chosen: list[dict]) -> float:
        mine = set(row[items])
        seen = {x for c in chosen for x in c[items]}
        share = max((len(mine & set(c[items])) / max(len(mine | set(c[items])), 1) for c in chosen), default=0.0)
        return row[base] + bonus * len(mine - seen) - overlap * share

    return gain


def camera_objective(items: str, score: str, weight: float, clearance: str, x: str, y: str, spacing: float) -> Callable[[dict, list[dict]], float]:
    """Newly covered items, a share of all visible ones and the path score, shrunk by scarce clearance and by nearness to chosen cameras."""

    def gain(row: dict, chosen: list[dict]) -> float:
        seen = {i for c in chosen for i in c[items]}
        value = 6.0 * len(set(row[items]) - seen) + 0.3 * len(row[items]) + weight * row[score]
        nearest = min((float(np.hypot(row[x] - c[x], row[y] - c[y])) for c in chosen), default=spacing)
        return value * min(1.0, row[clearance]) * min(1.0, nearest / spacing)

    return gain


def deficit_objective(counts: list[str], targets: list[int], penalty: float) -> Callable[[dict, list[dict]], float]:
    """Stages in order: what a row takes off the first target that isn't met yet, less a penalty for what it adds beyond any target."""

    def gain(row: dict, chosen: list[dict]) -> float:
        have = [sum(c[k] for c in chosen) for k in counts]
        stage = next((i for i, (h, t) in enumerate(zip(have, targets, strict=True)) if h < t), None)
        if stage is None:
            return 0.0
        over = sum(max(0, h + row[k] - t) - max(0, h - t) for h, k, t in zip(have, counts, targets, strict=True))
        return min(row[counts[stage]], targets[stage] - have[stage]) - penalty * over

    return gain


def budgeted(df: DataFrame, group: list[str], required: str, metric: str, id_col: str, limit: int) -> DataFrame:
    """Required rows first, then the nearest, up to a limit for each group."""
    w = Window.partitionBy(*group).orderBy(F.col(required).desc(), metric, id_col)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col(required) | (F.col("__n") <= limit)).drop("__n")


def spaced_candidates(df: DataFrame, group: list[str], required: str, metric: str, id_col: str, x: str, y: str, limit: int, spacing: float) -> DataFrame:
    """Required rows, then the nearest that are ``spacing`` from all chosen before them, up to a limit; of all these the nearest remain."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([metric, id_col], kind="stable").drop_duplicates(id_col).reset_index(drop=True)
        at = rows[[x, y]].to_numpy(float)
        must = rows[required].fillna(False).to_numpy(bool)
        chosen = list(np.flatnonzero(must))
        for i in np.flatnonzero(~must):
            if len(chosen) >= limit:
                break
            if not chosen or (((at[chosen] - at[i]) ** 2).sum(1) >= spacing**2).all():
                chosen.append(i)
        return rows.iloc[sorted(chosen)[:limit]]

    return df.groupBy(*group).applyInPandas(run, df.schema)


def best_pairs(starts: DataFrame, goals: DataFrame, lengths: DataFrame, group: list[str], top: int = 18) -> DataFrame:
    """The shortest known path between the first ``top`` starts and goals of each group.

    ``starts`` and ``goals``: group, id, rank; ``lengths``: group, start, goal, length.
    """
    head = lambda d, name: d.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("rank", "id"))).filter(F.col("__n") <= top).select(*group, F.col("id").alias(name))
    x = lengths.join(head(starts, "start"), [*group, "start"], "left_semi").join(head(goals, "goal"), [*group, "goal"], "left_semi")
    return x.groupBy(*group).agg(F.min(F.struct("length", "start", "goal")).alias("b")).select(*group, "b.start", "b.goal", "b.length")


def lattice(spark_range: DataFrame, stride: int) -> DataFrame:
    """Cells of a grid at a stride; ``spark_range`` has gx and gy."""
    return spark_range.filter((F.col("gx") % stride == 0) & (F.col("gy") % stride == 0))


def blocked_inside(cells: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """Occupied cells with at least so many occupied ones among their eight neighbours, all of which are known."""
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    around = cells.select(*group, (F.col("gx")).alias("__x"), F.col("gy").alias("__y"), "occupied").select(*group, "__x", "__y", "occupied", ring.alias("o")).filter("occupied")
    around = around.select(*group, "__x", "__y", (F.col("__x") + F.col("o.i")).alias("gx"), (F.col("__y") + F.col("o.j")).alias("gy"))
    near = around.join(cells.select(*group, "gx", "gy", F.col("occupied").alias("__n")), [*group, "gx", "gy"])
    return near.groupBy(*group, F.col("__x").alias("gx"), F.col("__y").alias("gy")).agg(F.count("*").alias("known"), F.sum(F.col("__n").cast("int")).alias("blocked")).filter((F.col("known") == 8) & (F.col("blocked") >= least)).select(*group, "gx", "gy")
