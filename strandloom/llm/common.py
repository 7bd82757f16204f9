"""Table access and lineage cuts shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _importable(spark: SparkSession) -> None:
    """Let Python workers import this package where they share its path, whatever folder the driver runs in."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that go to a Python worker at once, at most, and their bytes.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keep the batches small that Python workers get from this session.

    Texts have no bounded length, so a batch of the default ten thousand takes
    memory that depends on the data. Settings that are smaller already stay.
    """
    _importable(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def _shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    A folder of our own is set only where the session has none and everything
    runs on one machine, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandloom-"))
    return context.getCheckpointDir()


#: Tables of this process that are still there, by path.
_MADE: dict[str, SparkSession] = {}


def durable(df: DataFrame, label: str = "t", codec: str = "snappy") -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: (table, its path).

    Cuts lineage, so that what follows neither recomputes the plan nor can see
    another outcome of it when an executor is lost. The table goes with discard(),
    at the end of a scratch() block, or at last with the process. Tables that
    hold texts take the codec zstd, which makes them smaller.
    """
    spark = df.sparkSession
    _importable(spark)
    path = f"{_shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by durable() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _MADE.pop(path, None)


#: Bytes that a broadcast side may have, and parts that rows of a hot key are dealt to.
BROADCAST_BYTES = 32 << 20
PARTS = 64
#: A key is hot from this share of the rows on, so that there are fewer hot keys than its inverse.
HOT_SHARE = 0.002


def spread_join(rows: DataFrame, small: DataFrame, key: str, row_bytes: int | Column, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Join rows with small, which has one row for each value of a key, without skew.

    small is broadcast if its bytes, measured as rows times row_bytes or as the
    sum of a column of them, are within BROADCAST_BYTES. Beyond, both sides are
    shuffled, rows of hot or null keys in PARTS parts and small's rows of hot keys
    once for each part. Hot keys are fewer than 1 / HOT_SHARE. counts (key, n) has
    the numbers of rows that all keys have, or all but rare ones, where they are known.
    """
    per_row = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    if (small.agg(F.sum(per_row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), key, how)
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        counts, _ = durable(counts, "hot-keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[key] for r in counts.where(F.col("n") > HOT_SHARE * total).collect()]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    dealt = rows.withColumn("_part", F.when(F.col(key).isNull() | is_hot, part).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(small.withColumn("_part", F.explode(copies)).hint("merge"), [key, "_part"], how).drop("_part")


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Delete the tables made inside the block at its end, but for paths added to the set it yields."""
    before, kept = set(_MADE), set()
    try:
        yield kept
    finally:
        discard(spark, *(set(_MADE) - before - kept))


#: Results and the tables made on the way to them, in order.
_LEFT: list[tuple[weakref.ref, set[str]]] = []


def step(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A step (spark, docs, ...) of a chain whose results are written before the next step reads them.

    At its start a step deletes what earlier ones have left, unless docs still
    reads it or the earlier result is still held.
    """

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, *rest) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        for entry in list(_LEFT):
            ref, paths = entry
            if ref() is None and not any(f"/{path.rsplit('/', 1)[1]}/" in f for path in paths for f in files):
                discard(spark, *paths)
                _LEFT.remove(entry)
        before = set(_MADE)
        out = function(spark, docs, *rest)
        _LEFT.append((weakref.ref(out), set(_MADE) - before))
        return out

    return run


@atexit.register
def _discard_all() -> None:
    for path, spark in list(_MADE.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            discard(spark, path)
