"""Writers: lines, documents, tables with the union of columns, shards, buckets and checked archives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.hashing import hash_bucket
from lodestar.operators.ranking import display_ids
from lodestar.sources.readers import exists


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], keys: list[str], schema: str) -> DataFrame:
    """A sidecar table, partitioned by its keys: read where it was written in full before, else built and written once.

    The schema is stated, as a table without rows leaves no file to read it from.
    """
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").partitionBy(*keys).parquet(path)
    return spark.read.schema(schema).parquet(path)


def csv_union(frames: list[DataFrame], path: str) -> None:
    """One table with the union of all columns, in first-seen order."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.mode("overwrite").option("header", True).csv(path)


def by_task(df: DataFrame, path: str, task: str = "task") -> None:
    df.write.mode("overwrite").partitionBy(task).json(path)


def by_task_and_shard(df: DataFrame, path: str, task: str, order: list[str], shard_rows: int) -> None:
    numbered = display_ids(df, [task], order).withColumn("shard", F.floor((F.col("display_id") - 1) / shard_rows)).drop("display_id", "candidate_id")
    numbered.write.mode("overwrite").partitionBy(task, "shard").json(path)


def split_lists(df: DataFrame, path: str, split: str, name: str) -> None:
    """A list of names for each split."""
    df.select(split, F.col(name).cast("string").alias("value")).write.mode("overwrite").partitionBy(split).text(path)


def hash_buckets(df: DataFrame, path: str, key: str, buckets: int = 32) -> None:
    df.withColumn("bucket", hash_bucket(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_mismatches(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the manifest that are missing or differ in size or digest."""
    return manifest.join(found, ["file", "bytes", "sha256"], "left_anti")


def relocate(column: Column, old: str, new: str) -> Column:
    """A path with its prefix replaced."""
    return F.when(column.startswith(old), F.concat(F.lit(new), F.substring(column, F.lit(len(old) + 1), F.char_length(column)))).otherwise(column)


def without(df: DataFrame, key: str, gone: list[str]) -> DataFrame:
    """The rows that aren't withdrawn."""
    return df.filter(~F.col(key).isin(gone))


def json_document(df: DataFrame, path: str) -> None:
    """One JSON array in one file.  Meant for manifests, which are small."""
    df.select(F.struct("*").alias("r")).agg(F.to_json(F.collect_list("r")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def patched(df: DataFrame, struct: str, values: dict[str, Column]) -> DataFrame:
    """A struct column with fields replaced, where it has them."""
    names = [f.name for f in df.schema[struct].dataType.fields]
    out = F.col(struct)
    for k, v in values.items():
        if k in names:
            out = out.withField(k, v)
    return df.withColumn(struct, out)
