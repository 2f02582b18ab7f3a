"""What the operators of this subpackage share: table access, the shared scratch folder and text rules."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run on executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Tables of up to so many bytes of files are dealt out anew, as a single small file would keep all but one core waiting.
SMALL_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; the path is only ever opened by Spark's own reader."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the master is
    local (tests) a temporary folder of this machine is used; elsewhere that would be an error, as
    executors would write to disks of their own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.lodestar.scratch", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.lodestar.scratch", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_registered: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's own folder, which goes when the driver's Python ends before its session does."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _registered:
        _registered.add(own)
        atexit.register(_clear, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _clear(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session has ended already: the folder stays, like a checkpoint
        drop_stored(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; frames that only derive from one keep it."""
    for df in frames:
        if path := df.__dict__.get("_scratch"):
            drop_stored(df.sparkSession, path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bounds of the batches in which rows go to Python: rows, and bytes where this Spark bounds them.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds, so that batches of long texts stay small in the JVM and in Python."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is not None and not 0 < int(now.rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  Pure ASCII text takes the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
