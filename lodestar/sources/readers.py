"""Readers of question, prediction, waypoint and edge documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.operators.joins import last_wins, undirected


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches a path or glob, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; a bad line raises, blank lines are skipped, a missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object per line as a variant, for rows of different shapes; with the file it came from."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    return text.select(F.parse_json("value").alias("row"), F.col("_metadata.file_path").alias("file"))


def whole_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, parsed, with its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("doc"))


def visible_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints of view documents: file, display_id, waypoint_id, world_xyz."""
    docs = whole_documents(spark, path, "visible_waypoints array<struct<display_id bigint, waypoint_id bigint, world_xyz array<double>>>")
    return docs.select("file", F.explode("doc.visible_waypoints").alias("w")).select("file", "w.*")


def json_array(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """Rows of top-level arrays; the last row of a key wins."""
    text = spark.read.text(path, wholetext=True)
    element = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = text.select(F.posexplode(F.from_json("value", f"array<struct<{_typed(element)}>>")).alias("__pos", "r")).select("__pos", "r.*")
    return last_wins(rows, [key], F.col("__pos")).drop("__pos")


def _typed(ddl: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns strings."""
    return spark.read.option("header", True).csv(path)


def with_path_parts(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns taken from the ``file`` column by the groups of a pattern."""
    return df.withColumns({n: F.regexp_extract("file", pattern, i + 1) for i, n in enumerate(names)})


def versioned(df: DataFrame, version: str) -> DataFrame:
    """Rows whose schema_version is as expected; another one raises."""
    wrong = F.raise_error(F.concat(F.lit("schema_version "), F.coalesce("schema_version", F.lit("missing"))))
    return df.filter(F.when(F.col("schema_version") == version, F.lit(True)).otherwise(wrong.cast("boolean")))


def shards(spark: SparkSession, paths: list[str], schema: StructType | str, key: str) -> DataFrame:
    """Union of prediction shards with their file; missing shards are ignored, an id in two shards raises."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(found).withColumn("file", F.col("_metadata.file_path"))
    files = F.size(F.collect_set("file").over(Window.partitionBy(key)))
    twice = F.raise_error(F.concat(F.lit("in more than one shard: "), F.col(key).cast("string")))
    return rows.withColumn("__n", files).filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(twice.cast("boolean"))).drop("__n")


def direct_pairs(sidecars: DataFrame, waypoints: DataFrame | None = None) -> DataFrame:
    """Directed edges of ``neighbors`` maps<string, array<struct<display_id, distance_m>>>.

    Keys that aren't numbers are skipped.  A missing distance is taken from waypoint coordinates
    (display_id, world_xyz) or else drops the edge.
    """
    keys = [c for c in sidecars.columns if c != "neighbors"]
    each = sidecars.select(*keys, F.explode("neighbors").alias("src", "out")).select(*keys, F.expr("try_cast(src as bigint)").alias("src"), F.explode("out").alias("o")).select(*keys, "src", F.col("o.display_id").alias("dst"), F.col("o.distance_m").alias("distance")).filter("src IS NOT NULL AND dst IS NOT NULL")
    if waypoints is None:
        return each.filter("distance IS NOT NULL")
    at = lambda name: waypoints.select(*keys, F.col("display_id").alias(name), F.col("world_xyz").alias(f"__{name}"))
    x = each.join(at("src"), [*keys, "src"], "left").join(at("dst"), [*keys, "dst"], "left")
    span = F.sqrt(F.aggregate(F.zip_with("__src", "__dst", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return x.select(*keys, "src", "dst", F.coalesce("distance", span).alias("distance")).filter("distance IS NOT NULL")


def sparse_graph(edges: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Undirected edges with default length 1; of repeated edges the last wins."""
    filled = edges.select(*keys, F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("distance", F.lit(1.0)).alias("distance"), position)
    return last_wins(undirected(filled), [*keys, "src", "dst"], F.col(position)).drop(position)


def resolve(refs: DataFrame, catalogue: DataFrame, anchors: list[str]) -> DataFrame:
    """Each ``ref`` with the first path of the catalogue (``path``) among itself and its place under the anchors."""
    tries = F.array(F.col("ref"), *[F.concat(F.lit(a.rstrip("/") + "/"), F.col("ref")) for a in anchors])
    each = refs.select("ref", F.posexplode(tries).alias("__i", "path")).join(catalogue.select("path").distinct(), "path")
    hit = each.groupBy("ref").agg(F.min_by("path", "__i").alias("path"))
    return refs.join(hit, "ref", "left")


def adapt(df: DataFrame, benchmark: str, fields: dict[str, str]) -> DataFrame:
    """A foreign question table in the common shape; ``fields`` maps its names to expressions."""
    names = ("question_id", "question", "choices", "gold_letter", "gold_text")
    return df.select(F.lit(benchmark).alias("benchmark"), *[F.expr(fields.get(n, "null")).alias(n) for n in names])


def scene_list(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Scenes of a list file in order, the first ``limit`` of them."""
    names = spark.read.text(path).select(F.trim("value").alias("scene_id")).filter("scene_id <> ''").distinct().orderBy("scene_id")
    return names if limit is None else names.limit(limit)


def scenes(spark: SparkSession, root: str, grouped_dataset: str) -> DataFrame:
    """(scene_id, dataset, source_group) of the folders that hold a layout or metadata; metadata wins over what the id says."""
    from lodestar.operators.mining import source_dataset, source_group

    found = None
    for name in ("layout", "metadata"):
        if exists(spark, f"{root}/*/{name}.json"):
            docs = with_path_parts(whole_documents(spark, f"{root}/*/{name}.json", "dataset string, source_group_id string"), rf"([^/]+)/{name}\.json$", ["scene_id"])
            meta = (lambda c: F.col(f"doc.{c}")) if name == "metadata" else (lambda c: F.lit(None).cast("string"))  # noqa: B023
            rows = docs.select("scene_id", meta("dataset").alias("dataset"), meta("source_group_id").alias("group"))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "scene_id string, dataset string, source_group string")
    known = found.groupBy("scene_id").agg(F.max("dataset").alias("dataset"), F.max("group").alias("group"))
    return known.select("scene_id", F.coalesce("dataset", source_dataset(F.col("scene_id"))).alias("dataset"), F.coalesce("group", source_group(F.col("scene_id"), grouped_dataset)).alias("source_group"))


def complete_views(rows: DataFrame, view: list[str], tasks: list[str], task: str = "task") -> DataFrame:
    """The rows of views that have every task."""
    whole = rows.filter(F.col(task).isin(tasks)).groupBy(*view).agg(F.countDistinct(task).alias("__n")).filter(F.col("__n") == len(tasks)).drop("__n")
    return rows.join(whole, view, "left_semi")
