"""A ledger that batches are added to, at the cost of a batch.

Messages lie in buckets by their id. A batch writes its own summary as an
increment; readers merge increments with the base, and now and then they are
merged into a new base. Merging takes greatest values and bounds, so that any
split of the input gives one ledger, and a batch that comes twice changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import published
from ..sources.staging import _folder
from .ingest import KINDS, summarize

BUCKETS = 64
#: Increments that a base is left behind by, before they are merged into it.
BEHIND = 16
_KEY = "native_id"


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", _KEY).agg(*[F.max(k).alias(k) for k in KINDS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


class Ledger:
    """A ledger below root. Increments are named by who writes them and the number of their batch: a batch run again replaces its own."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _children(self, name: str) -> list[str]:
        fs, at = _folder(self.spark, f"{self.root}/{name}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _base(self) -> dict:
        try:
            return published.read_pointer(self.spark, f"{self.root}/BASE")
        except published.Unavailable as e:
            if e.reason == "missing":
                return {"base": None, "number": 0, "merged": []}
            raise

    def _increments(self, base: dict) -> list[str]:
        """Whole increments that the base doesn't hold. One that was merged and then written again holds nothing new."""
        fs, _ = _folder(self.spark, self.root)
        return [n for n in self._children("increments") if n not in base["merged"] and fs.exists(_folder(self.spark, f"{self.root}/increments/{n}/_SUCCESS")[1])]

    def add(self, batch: DataFrame, writer: str, number: int) -> None:
        """A batch of usage: written by its own size."""
        if not re.fullmatch(r"[A-Za-z0-9_.]+", writer):
            raise ValueError("a writer's name has letters, digits, _ and .")
        name = f"{writer}-{number:012d}"
        if name in self._base()["merged"]:
            return
        new = summarize(batch).withColumn("bucket", F.pmod(F.xxhash64(_KEY), F.lit(self.buckets)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/increments/{name}")
        published.raise_counter(self.spark, self.root, "ingest")

    def _parts(self, base: dict, names: list[str]) -> DataFrame | None:
        paths = [*([f"{self.root}/{base['base']}"] if base["base"] else []), *[f"{self.root}/increments/{n}" for n in names]]
        out = None
        for p in paths:
            part = self.spark.read.parquet(p)
            out = part if out is None else out.unionByName(part)
        return out

    def read(self) -> DataFrame | None:
        """All messages; None where nothing was ever added."""
        base = self._base()
        rows = self._parts(base, self._increments(base))
        return None if rows is None else _merge(rows).drop("bucket")

    def compact(self, behind: int = BEHIND) -> bool:
        """Merge increments into a new base if there are `behind` or more. A base is named only when it is whole; what it replaces goes afterwards."""
        base = self._base()
        names = self._increments(base)
        if len(names) < behind:
            return False
        number = base["number"] + 1
        _merge(self._parts(base, names)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/base-{number:012d}")
        # The names of merged increments stay, so that a batch that comes again is known.
        published.write_pointer(self.spark, f"{self.root}/BASE", {"schema_version": published.SCHEMA_VERSION, "base": f"base-{number:012d}", "number": number, "merged": _spanned([*base["merged"], *names])})
        published.raise_counter(self.spark, self.root, "ledger")
        fs, _ = _folder(self.spark, self.root)
        for old in [*[f"increments/{n}" for n in names], *([base["base"]] if base["base"] else [])]:
            fs.delete(_folder(self.spark, f"{self.root}/{old}")[1], True)
        return True


def _spanned(names: list[str]) -> list[str]:
    """Of each writer the last 64 names: a stream only ever repeats its last batch."""
    out: list[str] = []
    for writer in sorted({n.rpartition("-")[0] for n in names}):
        out += sorted(n for n in names if n.rpartition("-")[0] == writer)[-64:]
    return out


def ledger_stream(spark: SparkSession, source: str, schema: T.StructType, root: str, checkpoint: str, files_per_batch: int = 100, behind: int = BEHIND):
    """A started query that adds parquet files of usage to a ledger as they come, and merges its increments now and then.

    Increments are named by the query's id, which its checkpoint keeps: another
    checkpoint adds to the same ledger and replaces nothing.
    """
    held = Ledger(spark, root)

    def add(batch: DataFrame, number: int) -> None:
        held.add(batch, "q" + batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId").replace("-", ""), number)
        held.compact(behind)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
