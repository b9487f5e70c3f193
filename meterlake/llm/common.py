"""What the training-data operators share: table access, shared storage, keys, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_folder, scratch, shared_dir, staged, whole

__all__ = ["LOWER_AZ", "WORD", "dealt_in_blocks", "doc_text", "groups", "new_folder", "scratch", "shared_dir", "slices", "staged", "table", "text_key", "whole"]

#: Bytes that separate words: space, \t \n \v \f \r. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key() -> Column:
    """The SHA-256 of a text, 32 bytes; null for null."""
    return F.unhex(F.sha2("text", 256))


def doc_text() -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col("text"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, max_chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in runs of rows whose texts together stay near max_chars, so that memory follows that bound: only a run's texts become strings."""
    texts = batch.column(column)
    start, held = 0, 0
    for i, n in enumerate(pc.utf8_length(texts).fill_null(0).to_pylist()):
        if i > start and held + n > max_chars:
            yield batch.slice(start, i - start), [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield batch.slice(start), [t or "" for t in texts.slice(start).to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (whole numbers), from batches sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(bounds):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def dealt_in_blocks(rows: DataFrame, key: str, item: str, block: int, size: str, most: int) -> DataFrame:
    """rows plus mine, p and q, sorted by (key, p, q) in their partitions: groups in which any two rows of a key meet.

    A key's rows are cut in blocks of about `block` rows, or fewer so that their
    sizes sum to about `most`, by a hash of item; a group is a pair of blocks,
    and mine a row's own, so that pairs inside a block can be left to the groups
    with p = q.
    """
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(size) / most)).cast("int")
    full = rows.groupBy(key).agg(blocks.alias("blocks")).where("blocks > 1")
    dealt = rows.join(full, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("mine", "other")).withColumn("q", F.greatest("mine", "other"))
    return dealt.drop("blocks", "other").repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")
