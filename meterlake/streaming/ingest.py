"""Incremental ingest: batches merge into the ledger so that any split of the input gives the result of one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("input", "output", "cache_read", "cache_write")


def summarize(batch: DataFrame) -> DataFrame:
    """A batch's events: each component at its greatest, the bounds of their instants."""
    return batch.groupBy("native_id").agg(*[F.max(k).alias(k) for k in KINDS], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_events(ledger: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The ledger after a batch: new events added, components raised, bounds widened. Late rows are never dropped."""
    new = summarize(batch)
    if ledger is None:
        return new
    return ledger.unionByName(new).groupBy("native_id").agg(*[F.max(k).alias(k) for k in KINDS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def ingest_stream(spark: SparkSession, source: str, schema: T.StructType, ledger: str, checkpoint: str, files_per_batch: int = 100):
    """A started query that merges parquet files of usage, as they come, into a ledger folder.

    Each batch writes a new generation beside the old one and then names it as
    current, so a batch that is run again overwrites its own generation only.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = None if number == 0 else spark.read.parquet(f"{ledger}/generation={number - 1}")
        merge_events(before, batch).write.mode("overwrite").parquet(f"{ledger}/generation={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(stored: DataFrame, current: DataFrame, parser_version: int) -> DataFrame:
    """current files (path, identity, size, mtime) plus change: what happened to each since it was last read.

    Another file at the path, or a shorter one, is read anew before anything
    else is asked: no offset of the old one means anything there. A new parser
    reads even an unchanged file again.
    """
    s = stored.select("path", *[F.col(c).alias(f"old_{c}") for c in ("identity", "size", "mtime", "parser_version")])
    change = (
        F.when(F.col("old_size").isNull(), "new")
        .when((F.col("old_identity") != F.col("identity")) | (F.col("size") < F.col("old_size")), "rebuild_required")
        .when(F.col("old_parser_version") != parser_version, "parser_version_changed")
        .when((F.col("old_size") == F.col("size")) & (F.col("old_mtime") == F.col("mtime")), "unchanged")
        .when(F.col("size") > F.col("old_size"), "appended")
        .otherwise("rebuild_required")
    )
    return current.join(s, "path", "left").select(*current.columns, change.alias("change"))
