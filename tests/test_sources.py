from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestar.sources import readers, writers
from lodestar.streaming import scorer


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "v": "x"}\n\n{"id": 2}\n')
    assert readers.json_lines(spark, str(p), "id long, v string").count() == 2
    assert readers.json_lines(spark, f"{tmp_path}/none.jsonl", "id long").count() == 0
    (tmp_path / "b.jsonl").write_text('{"id": 1\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, f"{tmp_path}/b.jsonl", "id long").collect()
    assert readers.variant_lines(spark, str(p)).select(F.variant_get("row", "$.id", "long").alias("i")).orderBy("i").collect()[1].i == 2


def test_documents_and_arrays(spark, tmp_path):
    view = tmp_path / "scene1" / "view_3.json"
    view.parent.mkdir()
    view.write_text(json.dumps({"visible_waypoints": [{"display_id": 1, "waypoint_id": 11, "world_xyz": [0, 0, 0]}, {"display_id": 2, "waypoint_id": 12, "world_xyz": [3, 4, 0]}]}, indent=1))
    w = readers.with_path_parts(readers.visible_waypoints(spark, f"{tmp_path}/*/view_*.json"), r"([^/]+)/view_(\d+)\.json$", ["scene", "view"])
    assert {(r.scene, r["view"], r.display_id) for r in w.collect()} == {("scene1", "3", 1), ("scene1", "3", 2)}
    (tmp_path / "p.json").write_text('[{"id": 1, "o": "a"}, {"id": 1, "o": "b"}]')
    assert readers.json_array(spark, f"{tmp_path}/p.json", "id long, o string", "id").first().o == "b"
    side = spark.createDataFrame([("t", {"1": [(2, None), (9, None)], "x": [(1, 1.0)]})], "k string, neighbors map<string,array<struct<display_id:bigint,distance_m:double>>>")
    points = w.withColumn("k", F.lit("t"))
    assert [(r.src, r.dst, r.distance) for r in readers.direct_pairs(side, points).collect()] == [(1, 2, 5.0)]
    assert readers.direct_pairs(side).count() == 0
    graph = readers.sparse_graph(spark.createDataFrame([(1, 2, None, 0), (1, 2, 3.0, 1)], "source long, target long, distance double, p int"), [], "p")
    assert {(r.src, r.dst, r.distance) for r in graph.collect()} == {(1, 2, 3.0), (2, 1, 3.0)}


def test_shards_versions_and_paths(spark, tmp_path):
    for name, i in (("a", 1), ("b", 2), ("c", 2)):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": i}) + "\n")
    files = [f"{tmp_path}/{n}.jsonl" for n in "ab"]
    assert readers.shards(spark, [*files, f"{tmp_path}/gone.jsonl"], "id long", "id").count() == 2
    with pytest.raises(Exception, match="more than one shard"):
        readers.shards(spark, [*files, f"{tmp_path}/c.jsonl"], "id long", "id").collect()
    docs = spark.createDataFrame([("v3",), ("v2",)], "schema_version string")
    assert readers.versioned(docs.limit(1), "v3").count() == 1
    with pytest.raises(Exception, match="schema_version"):
        readers.versioned(docs, "v3").collect()
    refs, known = spark.createDataFrame([("x.png",), ("/abs/y.png",), ("z",)], "ref string"), spark.createDataFrame([("/b/x.png",), ("/a/x.png",), ("/abs/y.png",)], "path string")
    assert {r.ref: r.path for r in readers.resolve(refs, known, ["/a", "/b/"]).collect()} == {"x.png": "/a/x.png", "/abs/y.png": "/abs/y.png", "z": None}
    both = readers.adapt(spark.range(2), "one", {"question_id": "id", "gold_letter": "'A'"})
    assert both.columns == ["benchmark", "question_id", "question", "choices", "gold_letter", "gold_text"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a1", i, f"s{i % 2}") for i in range(5)] + [("b1", 9, "s0")], "task string, id long, split string")
    writers.by_task_and_shard(df, f"{tmp_path}/t", "task", ["id"], 2)
    assert {(r.task, r.shard, r["count"]) for r in spark.read.json(f"{tmp_path}/t").groupBy("task", "shard").count().collect()} == {("a1", 0, 2), ("a1", 1, 2), ("a1", 2, 1), ("b1", 0, 1)}
    writers.json_lines(df, f"{tmp_path}/j")
    writers.json_lines(df, f"{tmp_path}/j", append=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 12
    writers.csv_union([df.select("id"), df.select("task")], f"{tmp_path}/c")
    assert readers.csv_strings(spark, f"{tmp_path}/c").columns == ["id", "task"]
    writers.split_lists(df, f"{tmp_path}/s", "split", "id")
    writers.hash_buckets(df, f"{tmp_path}/h", "task")
    writers.by_task(df, f"{tmp_path}/b")
    assert spark.read.json(f"{tmp_path}/h").count() == spark.read.json(f"{tmp_path}/b").count() == spark.read.text(f"{tmp_path}/s").count() == 6
    found = writers.file_manifest(spark, f"{tmp_path}/j/*.json")
    assert writers.manifest_mismatches(found, found).count() == 0 and writers.manifest_mismatches(found, found.withColumn("sha256", F.lit("0"))).count() > 0
    moved = spark.createDataFrame([("/old/a",), ("/other",)], "p string").select(writers.relocate(F.col("p"), "/old", "/new").alias("p"))
    assert [r.p for r in moved.collect()] == ["/new/a", "/other"] and writers.without(df, "task", ["b1"]).count() == 5


def test_streamed_scores_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    events.select("ts", "event_type", "value").orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        scorer.follow(spark, f"{tmp_path}/in", events.select("ts", "event_type", "value").schema.simpleString()[7:-1].replace(":", " "), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = {(r.window_start, r.event_type): r.n for r in scorer.windowed(events).collect()}
    streamed = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())


def test_scenes(spark, tmp_path):
    for name, files in {"d__g__1": {"layout": {}}, "d__g__2": {"layout": {}, "metadata": {"dataset": "m", "source_group_id": "q"}}, "plain": {"layout": {}}, "empty": {}}.items():
        (tmp_path / name).mkdir()
        for f, doc in files.items():
            (tmp_path / name / f"{f}.json").write_text(json.dumps(doc))
    got = {r.scene_id: (r.dataset, r.source_group) for r in readers.scenes(spark, str(tmp_path), "d").collect()}
    assert got == {"d__g__1": ("d", "d__g"), "d__g__2": ("m", "q"), "plain": ("unknown", "plain")}
    (tmp_path / "list.txt").write_text("b\n\n a \nc\n")
    assert [r.scene_id for r in readers.scene_list(spark, f"{tmp_path}/list.txt", 2).collect()] == ["a", "b"]
    rows = spark.createDataFrame([(1, "a1"), (1, "b1"), (2, "a1")], "v int, task string")
    assert {r.v for r in readers.complete_views(rows, ["v"], ["a1", "b1"]).collect()} == {1}
    writers.json_document(rows, f"{tmp_path}/doc")
    assert spark.read.option("multiLine", True).json(f"{tmp_path}/doc").count() == 3
    df = spark.createDataFrame([(1, (2, 3))], "k int, s struct<a:int,b:int>")
    assert writers.patched(df, "s", {"a": F.lit(9), "z": F.lit(1)}).first().s.asDict() == {"a": 9, "b": 3}
