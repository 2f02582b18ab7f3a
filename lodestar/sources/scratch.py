"""Folders for intermediate files, in the place that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master falls back to a temporary folder of its machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lodestar-files-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path there, under the application's own folder."""
    return f"{shared(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
