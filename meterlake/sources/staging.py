"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session names it in spark.checkpoint.dir. Only a local session without
    that setting gets one of its own; a cluster without it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


#: Folders staged since each open scratch() began, the innermost last; each thread has its own.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there goes with the scratch() around it, or else when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch.get():
        _scratch.get()[-1].append(path)
    else:
        fs, at = _folder(spark, path)
        fs.deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a share, so that the tasks that sort shares do it in memory.
_SHARE = 1_500_000


def shares_of(rows: DataFrame) -> int:
    """How many shares to deal rows of this number to: one for each core at least. The rows are counted, which takes a table's footers alone."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _SHARE))


def dealt(spark: SparkSession, make: Callable[[], DataFrame], name: str, by: Sequence[str], shares: int) -> DataFrame:
    """What make() returns, staged in so many shares by the hash of some columns; all that make staged on the way is deleted.

    A join, window or aggregate by those columns reads a share as one task's
    and needs no shuffle. Compressed columns take a fraction of a shuffle's rows
    on disk, and are gone as soon as the next step is dealt, where a shuffle's
    files stay until the driver collects its garbage. The table's name goes at
    once, its files go as those of staged().
    """
    path, table = new_folder(spark, name), f"dealt_{uuid.uuid4().hex}"
    with scratch(spark):
        made = make()
        made.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(shares, *by).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table's files stay
    return out


@contextmanager
def scratch(spark: SparkSession):
    """What this thread stages inside is deleted at the end: read it before."""
    held: list[str] = []
    outer = _scratch.set((*_scratch.get(), held))
    try:
        yield
    finally:
        _scratch.reset(outer)
        for path in held:
            fs, at = _folder(spark, path)
            fs.delete(at, True)


def whole(make: Callable[..., DataFrame], name: str = "") -> Callable[..., DataFrame]:
    """Stages what make(df, ...) returns and deletes all that it staged on the way."""

    @wraps(make)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        path = new_folder(df.sparkSession, name or make.__name__)
        with scratch(df.sparkSession):
            made = make(df, *args, **kwargs)
            made.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(made.schema).parquet(path)

    return run
