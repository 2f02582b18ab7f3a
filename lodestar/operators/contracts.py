"""Checks that return violations, or raise where asked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows, or an error that names the first broken rule when they are read."""
    first = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.filter(F.when(first.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("contract broken: "), first)).cast("boolean")))


def validity(checks: dict[str, Column]) -> Column:
    """Struct of an eligible flag and the failed checks in a fixed order."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return F.struct((F.size(failed) == 0).alias("eligible"), failed.alias("failed_checks"))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first test that holds."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in reasons.items()])


def risk_status(codes: Column, severe: list[str], mild: list[str]) -> Column:
    lit = lambda xs: F.array(*map(F.lit, xs))
    return F.when(F.arrays_overlap(codes, lit(severe)), F.lit("contradicted")).when(F.arrays_overlap(codes, lit(mild)), F.lit("uncertain")).otherwise(F.lit("aligned"))


def window_gates(counts: dict[str, int], windows: dict[str, tuple[int, int]]) -> list[str]:
    """The names of counts outside their windows."""
    return [k for k, (low, high) in windows.items() if not low <= counts.get(k, 0) <= high]


def window_checks(counts: DataFrame, name: str, n: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """(name, n, low, high, inside) for every window; a name that isn't counted counts 0."""
    rows = F.array(*[F.struct(F.lit(k).alias(name), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")) for k, (low, high) in windows.items()])
    asked = counts.sparkSession.range(1).select(F.explode(rows).alias("w")).select("w.*")
    x = asked.join(counts.select(name, F.col(n).cast("long").alias("__n")), name, "left").withColumn(n, F.coalesce("__n", F.lit(0).cast("long")))
    return x.select(name, n, "low", "high", F.col(n).between(F.col("low"), F.col("high")).alias("inside"))


def delta_gates(after: DataFrame, before: DataFrame, key: str, thresholds: dict[str, float]) -> DataFrame:
    """Rounded deltas of metrics between two runs and the names of those below their thresholds."""
    b = before.select(key, *[F.col(m).alias(f"__{m}") for m in thresholds])
    delta = {m: F.round(F.col(m) - F.col(f"__{m}"), 6) for m in thresholds}
    x = after.join(b, key)
    failing = F.array_compact(F.array(*[F.when(~F.coalesce(d >= thresholds[m], F.lit(False)), F.lit(m)) for m, d in delta.items()]))
    return x.select(key, *[d.alias(f"delta_{m}") for m, d in delta.items()], failing.alias("failing"), (F.size(failing) == 0).alias("passed"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that the tables hold differently often, with how much more often the left one has them; nulls are equal."""
    signed = left.withColumn("__sign", F.lit(1).cast("long")).unionByName(right.withColumn("__sign", F.lit(-1).cast("long")))
    return signed.groupBy(*left.columns).agg(F.sum("__sign").alias("surplus")).filter("surplus <> 0")


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables have the same rows, as often."""
    return multiset_difference(left, right).isEmpty()
