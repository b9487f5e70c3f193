"""Greedy batches of an ordered list of events, found without any task that sees them all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged, whole
from .timeline import asof_by_bins

#: Events of a block, within which pointers are followed at once.
BLOCK = 1 << 20
#: As long as blocks need not be larger than that, there are at most so many.
BLOCKS = 256
#: Tasks that blocks are dealt to: what a block is made of is too small to be dealt by its size, the work on it isn't.
TASKS = 64


def numbered(rows: DataFrame, order: str, size: str) -> DataFrame:
    """rows plus ordinal and start: how many rows, and how much of `size`, come before each in the order. Ranges are numbered apart and moved by the totals of those before."""
    dealt = staged(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("s")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    w = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("ordinal", F.count("*").over(w)).withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))
    out = inside.join(totals, "part").withColumn("ordinal", F.col("ordinal") + F.col("n")).withColumn("start", F.col("start") + F.col("s"))
    return out.drop("part", "n", "s")


def _next(df: pd.DataFrame, lo: int, hi: int, most: int) -> np.ndarray:
    """For each event of [lo, hi) the one that its batch would end before."""
    df = df.sort_values("start")
    start, limit = df["start"].to_numpy(np.int64), df["limit"].to_numpy(np.int64)
    p = np.arange(lo, hi, dtype=np.int64)
    return np.minimum(p + most, limit[np.searchsorted(start, p, side="right") - 1])


def _leaving(ahead: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each event of a block the first batch start at or behind the block's end, if a batch began at it."""
    while True:
        inside = ahead < hi
        if not inside.any():
            return ahead
        ahead = np.where(inside, ahead[np.where(inside, ahead - lo, 0)], ahead)


@whole
def greedy_batches(files: DataFrame, file: str, most_events: int, most_files: int, block: int = BLOCK) -> DataFrame:
    """(batch, start, events, files, first_file, last_file): an ordered list of events cut greedily, so that no batch has more than so many events and files.

    files(file, events): events of a file follow each other, files in order of
    their names; a file may be cut. From an event, the next batch starts after
    most_events, or where the file begins that would be one too many. Blocks of
    events follow these pointers apart to where each leaves the block; few
    different events are reached so, and doubling their pointers tells which of
    them the first batch leads to. Each block then walks from its own entry.
    A block has `block` events at least, and more where that made more than
    BLOCKS of them: rounds, pointers and groups then don't grow with the events.
    """
    rows = staged(numbered(files.where("events > 0").select(file, F.col("events").cast("bigint").alias("events")), file, "events"), "files")
    total = rows.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
    block = max(block, min(BLOCK, -(-total // BLOCKS)))
    tasks = max(1, min(TASKS, -(-total // block)))
    limits = rows.select((F.col("ordinal") - most_files).alias("ordinal"), F.col("start").alias("limit"))
    rows = rows.join(limits, "ordinal", "left").withColumn("limit", F.coalesce("limit", F.lit(total)))
    dealt = staged(rows.select("start", "limit", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + events - 1) div {block}"))).alias("block")), "blocks")

    def exits(df: pd.DataFrame) -> pd.DataFrame:
        lo = int(df["block"].iloc[0]) * block
        hi = min(lo + block, total)
        return pd.DataFrame({"p": np.unique(_leaving(_next(df, lo, hi, most_events), lo, hi))})

    def of_entries(key, df: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        lo = int(key[0]) * block
        hi = min(lo + block, total)
        p = entries["p"].to_numpy(np.int64)
        return pd.DataFrame({"p": p, "to": _leaving(_next(df, lo, hi, most_events), lo, hi)[p - lo]} if len(df) and len(p) else {"p": p[:0], "to": p[:0]})

    def starts(key, df: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        lo = int(key[0]) * block
        hi = min(lo + block, total)
        out = []
        if len(df):
            ahead = _next(df, lo, hi, most_events)
            for p in entries["p"].tolist():
                while p < hi:
                    out.append(p)
                    p = int(ahead[p - lo])
        return pd.DataFrame({"p": np.array(out, np.int64)})

    by_block = lambda x: x.repartition(tasks, "block").groupBy("block")
    blocked = lambda nodes: by_block(nodes.withColumn("block", F.expr(f"p div {block}")))
    reached = files.sparkSession.range(1 if total else 0).select(F.col("id").alias("p"))
    nodes = by_block(dealt).applyInPandas(exits, "p bigint").where(F.col("p") < total).union(reached).distinct()
    jumps = staged(by_block(dealt).cogroup(blocked(nodes)).applyInPandas(of_entries, "p bigint, to bigint").where(F.col("to") < total), "jumps")
    count = 0
    while (now := reached.count()) > count:
        count = now
        further = reached.join(jumps, "p").select(F.col("to").alias("p"))
        reached = staged(reached.union(further).distinct(), "reached")
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.p")).select("a.p", "b.to")
        jumps = staged(twice, "jumps")
    found = by_block(dealt).cogroup(blocked(reached)).applyInPandas(starts, "p bigint")
    cuts = numbered(found.withColumn("one", F.lit(1)), "p", "one").select(F.col("ordinal").alias("batch"), "p")
    ends = cuts.select((F.col("batch") - 1).alias("batch"), F.col("p").alias("end"))
    spans = cuts.join(ends, "batch", "left").withColumn("end", F.coalesce("end", F.lit(total)))
    # A batch's first file is the last that starts by its first event, its last file the last that starts before its end.
    place = lambda at, c: _last_start(spans.select("batch", at.alias("at")), rows.select("start", F.col("ordinal").alias(f"{c}_ordinal"), F.col(file).alias(c)), block)
    out = spans.join(place(F.col("p"), "first_file"), "batch").join(place(F.col("end") - 1, "last_file"), "batch")
    return out.select("batch", F.col("p").alias("start"), (F.col("end") - F.col("p")).alias("events"), (F.col("last_file_ordinal") - F.col("first_file_ordinal") + 1).alias("files"), "first_file", "last_file")


def _last_start(asked: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(batch, and the columns of starts but start) of the last start at or before each asked place, by bins: a bin that has no start by then takes the last one before it."""
    what = [c for c in starts.columns if c != "start"]
    return asof_by_bins(asked.withColumn("all", F.lit(1)), starts.withColumnRenamed("start", "at").withColumn("all", F.lit(1)), ["all"], "at", what, width).select("batch", *what)
