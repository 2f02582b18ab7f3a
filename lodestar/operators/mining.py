"""Mining of hard bundles, splits without leakage, and reports on datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.hashing import hash_bucket


def bundle_key(scene: Column, view: Column, route: Column | None = None) -> Column:
    """scene::vN or scene::vN::route."""
    parts = [scene.cast("string"), F.concat(F.lit("v"), view.cast("string"))]
    return F.concat_ws("::", *parts, *([route.cast("string")] if route is not None else []))


def source_group(scene_id: Column, grouped_dataset: str) -> Column:
    """What may not be split: for one dataset the first two segments of the id, for others all of it."""
    parts = F.filter(F.split(scene_id, "__"), lambda x: x != "")
    return F.when((F.get(parts, 0) == grouped_dataset) & (F.size(parts) >= 2), F.array_join(F.slice(parts, 1, 2), "__")).otherwise(scene_id)


def source_dataset(scene_id: Column) -> Column:
    return F.when(F.contains(scene_id, F.lit("__")), F.get(F.split(scene_id, "__"), 0)).otherwise(F.lit("unknown"))


def family(task: Column) -> Column:
    return F.when(task.isin("a1", "b1"), F.lit("affordance")).when(task.isin("a2", "b2", "c"), F.lit("navigation")).otherwise(F.raise_error(F.concat(F.lit("unknown task "), F.coalesce(task, F.lit("null")))))


def bundle_violations(rows: DataFrame, keys: list[str], task: str, required: list, allowed: list) -> DataFrame:
    """Bundles that lack a required member or have one that isn't allowed, with both lists."""
    has = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(task)).alias("members"))
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    x = has.withColumns({"missing": F.array_sort(F.array_except(lit(required), "members")), "unexpected": F.array_sort(F.array_except("members", lit(sorted({*required, *allowed}))))})
    return x.filter((F.size("missing") > 0) | (F.size("unexpected") > 0))


def consistent(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], member: str) -> DataFrame:
    """The first row of each key with its members, and whether the fields agree over the group."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("f"), F.countDistinct(F.struct(*fields)).alias("versions"), F.array_sort(F.collect_set(member)).alias("members"))
    return first.select(*keys, *[F.col(f"f.{c}").alias(c) for c in fields], (F.col("versions") == 1).alias("agrees"), "members")


def scene_summaries(rows: DataFrame, scene: list[str], bundle: str, kind: str, score: str) -> DataFrame:
    """Per scene: rows, bundles, kinds, mean and greatest score."""
    return rows.groupBy(*scene).agg(F.count("*").alias("questions"), F.countDistinct(bundle).alias("bundles"), F.countDistinct(kind).alias("kinds"), F.round(F.avg(score), 3).alias("mean_score"), F.max(score).alias("max_score"))


def entity_counts(rows: DataFrame, label: str, labels: list[str], entities: dict[str, Column]) -> DataFrame:
    """Distinct entities by label, with a row for every label."""
    base = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    found = rows.groupBy(label).agg(*[F.countDistinct(e).alias(k) for k, e in entities.items()])
    return F.broadcast(base).join(found, label, "left").select(label, *[F.coalesce(k, F.lit(0).cast("long")).alias(k) for k in entities])


def cell_table(rows: DataFrame, axes: list[str], levels: list[str]) -> DataFrame:
    """Counts of every combination of levels, those that don't occur included."""
    domain = rows.sparkSession.range(0, 1, 1, 1)  # one partition: joins of local lists would multiply theirs
    for a in axes:
        domain = domain.withColumn(a, F.explode(F.array(*map(F.lit, levels))))
    domain = domain.drop("id")
    counts = rows.groupBy(*axes).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, axes, "left").select(*axes, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    """How often each reason occurs in arrays of reasons."""
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def split_of(group: Column, buckets: int, benchmark: int, validation: int) -> Column:
    """benchmark, validation or train, by the hash of what may not be split."""
    b = hash_bucket(group, buckets)
    return F.when(b < benchmark, F.lit("benchmark")).when(b < benchmark + validation, F.lit("validation")).otherwise(F.lit("train"))


def disjoint(rows: DataFrame, chosen: DataFrame, scene: str, group: str, hard: Column) -> DataFrame:
    """Rows with a split: chosen scenes keep their hard rows as benchmark, other scenes of their groups go, the rest is train.

    ``chosen`` has the scene column.
    """
    picked = chosen.select(scene).distinct()
    groups = rows.join(picked, scene, "left_semi").select(group).distinct()
    benchmark = rows.join(picked, scene, "left_semi").filter(hard).withColumn("split", F.lit("benchmark"))
    rest = rows.join(groups, group, "left_anti").withColumn("split", F.lit("train"))
    return benchmark.unionByName(rest)


def funnel(rows: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """How many rows survive each stage and all before it."""
    alive, out = F.lit(True), []
    for name, test in stages.items():
        alive = alive & F.coalesce(test, F.lit(False))
        out.append(F.sum(alive.cast("long")).alias(name))
    return rows.groupBy(*by).agg(F.count("*").alias("candidates"), *out)


def axis_shares(rows: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, level, n, share) of several axes in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in axes])).alias("x")).select("x.axis", "x.level")
    counts = long.groupBy("axis", "level").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("axis")))
