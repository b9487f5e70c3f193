"""One event for each message: strong identities, heuristic keys, payload digests, cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import DAY
from ..functions.exact import floor_div

KINDS = ("input", "output", "cache_read", "cache_write")


def _comparable(rows: DataFrame, column: str) -> Column:
    """A map as its sorted entries, which can be compared and ordered; any other column as it is."""
    return F.array_sort(F.map_entries(column)).alias(column) if isinstance(rows.schema[column].dataType, T.MapType) else F.col(column)


def _with_held(rows: DataFrame, key: str, order: Sequence[str], same: Sequence[str], grows: str) -> DataFrame:
    """rows plus ord, class and rank: the greatest rank of a message is its kept row."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("ord", F.row_number().over(w)).withColumn("rank", F.struct(F.col(grows).alias("g"), (-F.col("ord")).alias("o")))
    state = F.struct("rank.g", "rank.o", *[_comparable(rows, c) for c in same])
    held = numbered.withColumn("held", F.max(state).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(f"held.{c}").eqNullSafe(_comparable(rows, c))
    return held.withColumn("class", F.when(F.col("held").isNull(), "new").when(equal, "replay").otherwise("collision")).drop("held")


SAME = ("input", "cache_read", "cache_write")


def classify_identities(rows: DataFrame, key: str = "native_id", order: Sequence[str] = ("ts",), same: Sequence[str] = SAME, grows: str = "output") -> DataFrame:
    """rows plus ord, is_kept and class.

    A message's kept row is the one with the most output, the earliest of
    equals. A later row is a replay if it equals, output aside, the row that was
    kept when it came, else a collision; the first is new. Among what has to be
    equal may be a map of counts that no parser knows.
    """
    held = _with_held(rows, key, order, same, grows)
    return held.withColumn("is_kept", F.col("rank") == F.max("rank").over(Window.partitionBy(key))).drop("rank")


def dedup_identities(rows: DataFrame, key: str = "native_id", order: Sequence[str] = ("ts",), same: Sequence[str] = SAME, grows: str = "output") -> DataFrame:
    """The kept row of each message, with how many replays and collisions it had: one sort by message, then an aggregate over the same partitions."""
    held = _with_held(rows, key, order, same, grows)
    count = lambda c: F.count_if(F.col("class") == c).alias(f"{c}s")
    best = held.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "rank").alias("best"), count("replay"), count("collision"))
    return best.select(*[F.col(key) if c == key else F.col(f"best.{c}") for c in rows.columns], "replays", "collisions")


def kept_identities(rows: DataFrame, key: Sequence[str], order: Sequence[str] = ("ts",), grows: str = "output") -> DataFrame:
    """The kept row of each message as in dedup_identities, whose id may be in several columns, without counts of the others: one sort by the message."""
    w = Window.partitionBy(*key).orderBy(F.desc(grows), *order)
    return rows.withColumn("ord", F.row_number().over(w)).where("ord = 1").drop("ord")


def heuristic_key(ts: Column, session: Column, version: str = "hk1") -> Column:
    """What identifies a message without an id: when and where it was, and what went in. Output is left out, as it grows while a message streams."""
    return F.concat_ws("|", F.lit(version), ts.cast("string"), session.cast("string"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("input", "cache_read", "cache_write")]))


def payload_digest(*fields: Column) -> Column:
    """SHA-256 over length-delimited fields; null is told from empty."""
    parts = [F.coalesce(F.concat(F.length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws("|", *parts), 256)


def pair_quarantine(rows: DataFrame, key: str, digest: str, order: Sequence[str], width: int = DAY) -> DataFrame:
    """(key, kept, replays, quarantined) for each heuristic key.

    In order, a digest is held; its equals are replays; another digest sends
    both to quarantine and frees the key, so that the next one starts anew.
    What is held at the end is kept. Rows without a digest are left out.

    A key's rows are cut into bins of `width` of the first order column, which
    are folded apart as sorted streams. What a bin does depends on what was held
    before it only in this: nothing or its first digest (as from the start), or
    another one, which takes the first digest away. Both ways are folded, and
    the bins' summaries are put together in order.
    """
    keys = [key, "__bin"]
    runs = rows.where(F.col(digest).isNotNull()).select(key, floor_div(F.col(order[0]), width).alias("__bin"), F.col(digest).alias("__digest"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(order)])
    parts = [f"{c}{i}" for i in (0, 1) for c in ("held", "replays", "quarantined")]
    schema = ", ".join([f"{key} {rows.schema[key].dataType.simpleString()}", "__bin bigint", "first string", *(f"{p} {'string' if p.startswith('held') else 'bigint'}" for p in parts)])

    def step(held, replays, quarantined, d):
        if held is None:
            return d, replays, quarantined
        return (held, replays + 1, quarantined) if held == d else (None, replays, quarantined + 2)

    def fold(batches):
        now, first, ways, out = None, None, None, None
        for batch in batches:
            out = pa.schema([*(batch.schema.field(k) for k in keys), ("first", pa.string()), *((p, pa.string() if p.startswith("held") else pa.int64()) for p in parts)])
            done = []
            for *at, d in zip(*(batch.column(c).to_pylist() for c in (*keys, "__digest")), strict=True):
                if at == now:
                    ways = [step(*w, d) for w in ways]
                    continue
                if now is not None:
                    done.append((*now, first, *ways[0], *ways[1]))
                now, first, ways = at, d, [(d, 0, 0), (None, 0, 2)]
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in done], out)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*now, first, *ways[0], *ways[1]), strict=True))], out)

    bins = runs.repartition(*keys).sortWithinPartitions(*keys, *[f"__by{i}" for i in range(len(order))], "__digest").mapInArrow(fold, schema)
    start = F.struct(F.lit(None).cast("string").alias("held"), F.lit(0).cast("bigint").alias("replays"), F.lit(0).cast("bigint").alias("quarantined"))

    def join(acc, b):
        same = acc["held"] == b["first"]
        as_new = acc["held"].isNull() | same
        pick = lambda c: F.when(as_new, b[f"{c}0"]).otherwise(b[f"{c}1"])
        again = F.when(same, 1).otherwise(0)
        return F.struct(pick("held").alias("held"), (acc["replays"] + pick("replays") + again).alias("replays"), (acc["quarantined"] + pick("quarantined")).alias("quarantined"))

    summaries = F.array_sort(F.collect_list(F.struct("__bin", "first", *parts)))
    return bins.groupBy(key).agg(F.aggregate(summaries, start, join).alias("s")).select(key, F.col("s.held").isNotNull().alias("kept"), "s.replays", "s.quarantined")


def version_drift(rows: DataFrame, running: dict[str, int], parser: str = "parser", version: str = "parser_version") -> DataFrame:
    """Parsers with rows of another version than runs now."""
    now = F.coalesce(*[F.when(F.col(parser) == p, F.lit(v)) for p, v in running.items()])
    return rows.groupBy(parser, version).agg(F.count("*").alias("events")).where(~F.col(version).eqNullSafe(now)).withColumn("running", now)


def cumulative_deltas(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], kinds: Sequence[str]) -> DataFrame:
    """rows plus delta_<kind> and decreased (the kinds that fell).

    A counter's first row is its own delta. A row in which any kind fell has no
    deltas, and still is what the next one is compared with.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    fell = F.filter(F.array(*[F.when(F.col(k) < F.lag(k).over(w), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    out = rows.withColumn("decreased", fell)
    for k in kinds:
        out = out.withColumn(f"delta_{k}", F.col(k) - F.coalesce(F.lag(k).over(w), F.lit(0)))
    for k in kinds:
        out = out.withColumn(f"delta_{k}", F.when(F.size("decreased") == 0, F.col(f"delta_{k}")))
    return out
