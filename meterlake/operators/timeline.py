"""The four shapes that the ledger's ordered questions come down to: as-of joins, gaps, interval merges, ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import floor_div


def asof(events: DataFrame, facts: DataFrame, by: Sequence[str], ts: str, keep: Sequence[str], ties: Sequence[Column | str] = (), inclusive: bool = True) -> DataFrame:
    """events plus each kept column of the last fact of the same key at or before (inclusive) the event.

    Facts at one instant are taken in the order of `ties`. One shuffle on the
    key brings both sides together; a running last value does the rest, so a
    fact that holds for many events is never joined with each of them.
    """
    mine = [c for c in events.columns if c not in by and c != ts]
    left = events.select(*by, ts, F.struct(*[F.col(c) for c in mine]).alias("__event"), F.lit(None).cast(facts.select(F.struct(*keep)).schema[0].dataType).alias("__fact"), F.lit(1 if inclusive else 0).alias("__side"), *[F.lit(None).cast(facts.select(F.col(t) if isinstance(t, str) else t).schema[0].dataType).alias(f"__tie{i}") for i, t in enumerate(ties)])
    right = facts.select(*by, ts, F.lit(None).cast(left.schema["__event"].dataType).alias("__event"), F.struct(*keep).alias("__fact"), F.lit(0 if inclusive else 1).alias("__side"), *[(F.col(t) if isinstance(t, str) else t).alias(f"__tie{i}") for i, t in enumerate(ties)])
    order = [ts, "__side", *[F.col(f"__tie{i}").asc_nulls_first() for i in range(len(ties))]]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__held", F.last("__fact", ignorenulls=True).over(w))
    return both.where("__event is not null").select(*by, ts, "__event.*", *[F.col(f"__held.{c}").alias(c) for c in keep])


def asof_by_bins(events: DataFrame, facts: DataFrame, by: Sequence[str], ts: str, keep: Sequence[str], width: int, ties: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """asof for keys, or none at all, that hold more than one task can sort: bins of time are sorted apart, each with what held when it opened.

    The bins of a key are ordered in one task: as many as time has in `width`.
    """
    at = floor_div(F.col(ts), width)
    mine, theirs = events.withColumn("__bin", at), facts.withColumn("__bin", at).withColumn("__kept", F.struct(*keep))
    last = theirs.groupBy(*by, "__bin").agg(F.max_by("__kept", F.struct(ts, *ties)).alias("__opening"))
    opened = asof(mine.select(*by, "__bin").distinct().withColumn("__row", F.lit(1)), last, by, "__bin", ["__opening"], inclusive=False).drop("__row")
    inside = asof(mine, theirs, [*by, "__bin"], ts, ["__kept"], ties, inclusive)
    a, b = inside.alias("a"), opened.alias("b")
    held = F.coalesce("a.__kept", "b.__opening")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, "__bin")], "left")
    return joined.select(*[F.col(f"a.{c}") for c in events.columns], *[held[c].alias(c) for c in keep])


def sums_within(intervals: DataFrame, facts: DataFrame, by: Sequence[str], sums: Sequence[str], start: Column, end: Column, closed: bool = True) -> DataFrame:
    """intervals plus the total of each of `sums` over the facts (by, a, b, sums) of its key that overlap [start, end], or (start, end) if not closed.

    A fact lies in [a, b]; without b it is open-ended. Facts that begin by the
    interval's end, less those that end before its start: running totals give
    both, so that no fact is joined with the intervals it lies in. Equal
    intervals are one.
    """
    row = F.struct(*intervals.columns)
    none = F.lit(None).cast(intervals.select(row).schema[0].dataType)
    zero = F.lit(0).cast("bigint")

    def mark(at: str, side: str) -> DataFrame:
        totals = [(F.coalesce(F.col(s).cast("bigint"), zero) if x == side else zero).alias(f"{x}_{s}") for x in ("begun", "ended") for s in sums]
        return facts.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("__at"), F.lit(1).alias("__turn"), none.alias("__row"), F.lit(None).cast("boolean").alias("__end"), *totals)

    edge = lambda at, is_end: F.struct(at.alias("at"), F.lit(2 if is_end == closed else 0).alias("turn"), F.lit(is_end).alias("end"))
    asks = intervals.select(*by, row.alias("__row"), F.explode(F.array(edge(end, True), edge(start, False))).alias("e"))
    asks = asks.select(*by, F.col("e.at").alias("__at"), F.col("e.turn").alias("__turn"), "__row", F.col("e.end").alias("__end"), *[zero.alias(f"{x}_{s}") for x in ("begun", "ended") for s in sums])
    w = Window.partitionBy(*by).orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = mark("a", "begun").union(mark("b", "ended")).union(asks)
    run = rows.withColumns({f"{x}_{s}": F.sum(f"{x}_{s}").over(w) for x in ("begun", "ended") for s in sums}).where("__row is not null")
    return run.groupBy("__row").agg(*[(F.max(F.when(F.col("__end"), F.col(f"begun_{s}"))) - F.max(F.when(~F.col("__end"), F.col(f"ended_{s}")))).alias(s) for s in sums]).select("__row.*", *sums)


def gaps(rows: DataFrame, by: Sequence[str], ts: str, start: int, end: int, keys: DataFrame | None = None) -> DataFrame:
    """(by, previous, ts, gap) over [start, end): from start to each key's first instant, between its instants, and from the last to end. keys names those that may have no instant and so one gap."""
    inside = rows.where((F.col(ts) >= start) & (F.col(ts) < end)).select(*by, F.col(ts).cast("bigint").alias(ts))
    every = inside.select(*by).distinct() if keys is None else keys.select(*by).distinct()
    w = Window.partitionBy(*by).orderBy(ts)
    out = inside.union(every.withColumn(ts, F.lit(end).cast("bigint"))).withColumn("previous", F.coalesce(F.lag(ts).over(w), F.lit(start)))
    return out.withColumn("gap", F.col(ts) - F.col("previous"))


def longest_gap(gapped: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """The longest gap of each key; of equal ones the last."""
    return gapped.groupBy(*by).agg(F.max(F.struct("gap", ts)).alias("m")).select(*by, F.col("m.gap").alias("gap"), F.col(f"m.{ts}").alias("until"))


def merge_intervals(rows: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of each key that overlap or touch, merged."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.select(*by, start, end).withColumn("opens", (F.col(start) > F.coalesce(F.max(end).over(before), F.col(start) - 1)).cast("int"))
    return opened.withColumn("island", F.sum("opens").over(upto)).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def thin_instants(rows: DataFrame, by: Sequence[str], ts: str, apart: int) -> DataFrame:
    """Of each key's instants those that lie more than `apart` after the last one kept, as an exact ordered fold.

    An instant more than `apart` after the one before it is always kept, so the
    runs between such instants are folded apart: sorted rows stream by, and one
    kept instant is held.
    """
    w = Window.partitionBy(*by).orderBy(ts)
    runs = rows.select(*by, ts).where(F.col(ts).isNotNull()).withColumn("__run", F.sum(F.coalesce((F.col(ts) - F.lag(ts).over(w) > apart).cast("int"), F.lit(0))).over(w))
    keys = [*by, "__run"]

    def fold(batches):
        now, kept = None, None
        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            keep = []
            for k, t in zip(key, batch.column(ts).to_pylist(), strict=True):
                if k != now or t - kept > apart:
                    now, kept = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_())).select([*by, ts])

    return runs.repartition(*keys).sortWithinPartitions(*keys, ts).mapInArrow(fold, runs.drop("__run").schema)


def islands(rows: DataFrame, by: Sequence[str], order: Sequence[str], reset: Column) -> DataFrame:
    """rows plus island (how many resets so far) and nth (the place inside the island, from 1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumn("island", F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "island").orderBy(*order)))
