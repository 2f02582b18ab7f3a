"""Summaries, ranks, correlations, intervals and apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(column: str, digits: int = 3) -> list[Column]:
    """Count, minimum, maximum, mean and median."""
    return [F.count(column).alias("n"), F.round(F.min(column), digits).alias("min"), F.round(F.max(column), digits).alias("max"), F.round(F.avg(column), digits).alias("mean"), F.round(F.percentile(column, F.lit(0.5)), digits).alias("median")]


def domain_counts(df: DataFrame, column: str, domain: list, keep_zero: bool = True) -> DataFrame:
    """Counts in the domain's order; values that don't occur count 0 or are left out."""
    spark = df.sparkSession
    base = spark.createDataFrame([(v, i) for i, v in enumerate(domain)], f"{column} {dict(df.dtypes)[column]}, place int")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(base).join(counts, column, "left" if keep_zero else "inner").select(column, "place", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """1-based ranks within groups; ties share their mean.

    Values are counted first, so the ordered window runs over distinct values, not over rows.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn(name, F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2).drop("__n")
    return df.join(placed, [*group, value])


def pearson(a: str, b: str) -> Column:
    """0 where either side has no spread."""
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """Pearson correlation of average ranks."""
    x = average_ranks(average_ranks(df, a, group, "__ra"), b, group, "__rb")
    return x.groupBy(*group).agg(F.count("*").alias("n"), pearson("__ra", "__rb").alias("rho"))


def kendall(df: DataFrame, a: str, b: str, key: str, group: list[str]) -> DataFrame:
    """Tau-b over the pairs of each group.  Meant for tables of runs: the pairs of a group are formed."""
    left, right = df.select(*group, F.col(key).alias("k1"), F.col(a).alias("a1"), F.col(b).alias("b1")), df.select(*group, F.col(key).alias("k2"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    pairs = left.join(right, group).filter("k1 < k2").select(*group, F.signum(F.col("a1") - F.col("a2")).alias("da"), F.signum(F.col("b1") - F.col("b2")).alias("db"))
    below = F.sqrt(F.sum(F.abs("da")) * F.sum(F.abs("db")))
    return pairs.groupBy(*group).agg(F.when(below > 0, F.sum(F.col("da") * F.col("db")) / below).otherwise(0.0).alias("tau"))


def apportion(weights: DataFrame, weight: str, name: str, total: int) -> DataFrame:
    """Whole targets that add up to ``total``: floors, and one more for the largest remainders (ties: larger weight, later name)."""
    sums = weights.agg(F.sum(weight).alias("__sum"))
    x = weights.crossJoin(F.broadcast(sums)).withColumn("__share", F.lit(float(total)) * F.col(weight) / F.col("__sum")).withColumn("__floor", F.floor("__share"))
    left = F.lit(total) - F.sum("__floor").over(Window.partitionBy())
    order = Window.orderBy((F.col("__share") - F.col("__floor")).desc(), F.col(weight).desc(), F.col(name).desc())
    return x.withColumn("__left", left).withColumn("__n", F.row_number().over(order)).select(*weights.columns, (F.col("__floor") + F.when(F.col("__n") <= F.col("__left"), 1).otherwise(0)).cast("long").alias("target"))


def _poisson_steps() -> list[float]:
    """Cumulative probabilities of a Poisson(1) count below 11."""
    steps, p, total = [], 0.36787944117144233, 0.0
    for i in range(1, 12):
        total += p
        steps.append(total)
        p /= i
    return steps


POISSON_STEPS = _poisson_steps()


def resampled(sums: DataFrame, group: list[str], cluster: str, replicates: int, seed: int) -> DataFrame:
    """(group, replicate, m): means of resampled clusters; ``sums`` has the group, the cluster, and s and n of each.

    Each cluster draws a hashed Poisson(1) weight for every replicate, the same in every group; a replicate
    without any cluster has no mean.  Nothing but (replicate, sum, count) is shuffled.
    """
    drawn = sums.select(*group, "s", "n", cluster, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    digest = F.md5(F.concat_ws(":", F.col(cluster).cast("string"), F.col("replicate").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    weight = sum((F.when(F.col("__u") >= t, 1).otherwise(0) for t in POISSON_STEPS), F.lit(0))
    weighed = drawn.withColumn("__u", u).withColumn("__w", weight)
    total = F.sum(F.col("n") * F.col("__w"))
    return weighed.groupBy(*group, "replicate").agg(F.sum(F.col("s") * F.col("__w")).alias("__s"), total.alias("__n")).filter("__n > 0").select(*group, "replicate", (F.col("__s") / F.col("__n")).alias("m"))


def _interval() -> list[Column]:
    return [F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high")]


def cluster_bootstrap(df: DataFrame, value: str, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(estimate, low, high): mean with a 95% interval from resampling whole clusters, which collapse to sums first."""
    sums = df.groupBy(cluster).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("n"))
    point = sums.agg((F.sum("s") / F.sum("n")).alias("estimate"))
    return point.crossJoin(F.broadcast(resampled(sums, [], cluster, replicates, seed).agg(*_interval())))


def paired_bootstrap(df: DataFrame, group: list[str], cluster: str, before: str, after: str, replicates: int, seed: int) -> DataFrame:
    """(group, low, high): 95% interval of the mean difference of two measurements of the same items."""
    sums = df.groupBy(*group, cluster).agg(F.sum(F.col(after) - F.col(before)).cast("double").alias("s"), F.count(F.col(after) - F.col(before)).alias("n"))
    return resampled(sums, group, cluster, replicates, seed).groupBy(*group).agg(*_interval())


def cross_benchmark(df: DataFrame, benchmark: str, cluster: str, before: str, after: str, replicates: int, seed: int, digits: int = 6) -> DataFrame:
    """Per benchmark both means, their difference and its paired interval; then the mean over benchmarks (macro) and over all items (pooled)."""
    means = [F.count("*").alias("n"), F.avg(before).alias("before"), F.avg(after).alias("after")]
    per = df.groupBy(benchmark).agg(*means)
    whole = per.join(paired_bootstrap(df, [benchmark], cluster, before, after, replicates, seed), benchmark)
    unknown = F.lit(None).cast("double")
    macro = per.agg(F.sum("n").alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after")).select(F.lit("macro").alias(benchmark), "n", "before", "after", unknown.alias("low"), unknown.alias("high"))
    pooled = df.agg(*means).select(F.lit("pooled").alias(benchmark), "n", "before", "after", unknown.alias("low"), unknown.alias("high"))
    rounded = lambda c: F.round(c, digits)
    rows = whole.unionByName(macro).unionByName(pooled)
    return rows.select(benchmark, "n", rounded("before").alias("before"), rounded("after").alias("after"), rounded(F.col("after") - F.col("before")).alias("delta"), rounded("low").alias("low"), rounded("high").alias("high"))


def collapse_warnings(counts: DataFrame, axis: str, n: str, threshold: float = 0.9) -> DataFrame:
    """Levels that hold more than the threshold's share of their axis."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(axis))
    return counts.withColumn("share", share).filter(F.col("share") > threshold)


def modal_gates(values: dict[str, Column], limits: dict[str, float]) -> Column:
    """The names of values below their limits, in order."""
    return F.array_compact(F.array(*[F.when(v < limits[k], F.lit(k)) for k, v in values.items()]))
