"""Tables settled in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of this process that are still there.
_MADE: dict[str, SparkSession] = {}


def settled(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; it goes with the process.

    For tables that a plan refers to several times, such as the variants of a
    panel: the work behind them is done once, and lost executors can't bring it
    back. A folder of our own is set only where the session names none and
    everything runs on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-"))
    path = f"{context.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    _MADE[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_all() -> None:
    """Delete every settled table; nothing may read them any more."""
    for path, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        del _MADE[path]


atexit.register(discard_all)
