"""Spend with what qualifies it, on every node of an ordered grouping.

A node's state can be merged: sums, counts, and sets as bits of longs. Events
are staged once, dealt by their first dimensions, and a share is sorted by all of
them; in that order each node is a run, and one pass merges the runs of each
depth out of those of the depth below it. Only the few nodes above the first
dimensions are merged by shuffles of their own. No event is shuffled, none is
copied for the depths it counts in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import dealt, staged

#: Evidence of a count that its harness reported itself; any other evidence is the name of an estimator.
REPORTED = "reported"
#: The estimator of events whose hour is a guess, so that schedules can't be told.
UNSCHEDULED = "schedule-unresolved"
_SETS = ("methods", "missing", "sources")
_WORD = 62
#: So many leading dimensions deal events to tasks.
_DEALT = 2
#: Sets of up to so many values are looked up among all their subsets.
_LISTED = 7


def vocabulary(rows: DataFrame, column: str) -> list[str]:
    """The different values in a column of sets, sorted: names of estimators, kinds of components or sources, a few words for any number of events."""
    return sorted(r[0] for r in rows.select(F.explode(column).alias("v")).where("v is not null").distinct().collect())


def _words(values: Sequence[str]) -> list[Sequence[str]]:
    return [values[i : i + _WORD] for i in range(0, len(values), _WORD)]


def to_bits(column: str, values: Sequence[str]) -> list[Column]:
    """A set as longs: a bit for each value, as many longs as they need."""

    def word_of(word: Sequence[str]) -> Column:
        bit = F.create_map(*[x for i, v in enumerate(word) for x in (F.lit(v), F.lit(1 << i).cast("bigint"))])
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(F.coalesce(F.try_element_at(bit, x), F.lit(0).cast("bigint"))))

    return [word_of(word).alias(f"{column}_{n}") for n, word in enumerate(_words(values))]


def from_bits(column: str, values: Sequence[str]) -> Column:
    """The set again, sorted."""
    none = F.array().cast("array<string>")
    if 0 < len(values) <= _LISTED:
        subsets = [[F.lit(v) for i, v in enumerate(values) if n >> i & 1] for n in range(1 << len(values))]
        return F.get(F.array(*[F.array(*x) if x else none for x in subsets]), F.col(f"{column}_0").cast("int"))
    named = [F.when(F.col(f"{column}_{n}").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(v)) for n, word in enumerate(_words(values)) for i, v in enumerate(word)]
    return F.filter(F.array(*named), lambda v: v.isNotNull()) if named else none


def merged(states: DataFrame, dims: Sequence[str], sums: Sequence[str], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """States, of which an event is the smallest, merged to groups of the dims."""
    bits = [f"{c}_{n}" for c in _SETS for n in range(len(_words(values[c])))]
    return states.groupBy(*dims).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("events", *sums, "measured", "heuristic")], *[F.bit_or(c).alias(c) for c in bits])


def _runs(batches: Iterable[pa.RecordBatch], dims: Sequence[str], sums: Sequence[str], bits: Sequence[str], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dims as nodes of all depths from the deepest to `least`: runs of equal dims, merged; dims beyond a node's depth are null.

    changed is the first dimension in which a row differs from the one before. A
    depth's runs of a batch are merged out of those of the depth below. The last
    run of each depth stays open for the next batch: its values are held, its
    dims are those of the last row seen.
    """
    deep, last, held = len(dims), None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pa.Table.from_batches([last if last is not None else batch.select(dims).slice(0, 1), batch.select(dims)]).combine_chunks()
        changed = np.concatenate(([deep], batch.column("changed").to_numpy()))
        if last is None:
            changed[1] = deep
            held = {d: (np.zeros((len(sums), 1), np.int64), np.zeros((len(bits), 1), np.int64)) for d in range(least, deep + 1)}
        at, add, some = np.arange(1, len(names)), _longs(batch, sums), _longs(batch, bits)
        found = []
        for d in range(deep, least - 1, -1):
            begins = changed[at] < d
            begins[0] = True
            begins = np.flatnonzero(begins)
            at, add, some = at[begins], _totals(add, begins), np.bitwise_or.reduceat(some, begins, axis=1)
            # The batch's runs, the first of which may go on with what is held; the last is held.
            begins = np.arange(len(at) + 1)
            if changed[1] >= d:
                begins = np.delete(begins, 1)
            whole_add, whole_some = _totals(np.concatenate((held[d][0], add), axis=1), begins), np.bitwise_or.reduceat(np.concatenate((held[d][1], some), axis=1), begins, axis=1)
            held[d] = whole_add[:, -1:], whole_some[:, -1:]
            found.append((d, np.concatenate(([0], at))[begins[:-1]], whole_add[:, :-1], whole_some[:, :-1]))
        last = batch.select(dims).slice(batch.num_rows - 1, 1)
        yield _nodes(names, found, dims, sums, bits)
    if last is not None:
        yield _nodes(pa.Table.from_batches([last]), [(d, np.array([0]), *held[d]) for d in range(deep, least - 1, -1)], dims, sums, bits)


def _longs(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def _totals(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of runs; an error where one doesn't fit in a long, as in Spark's sums."""
    if max(int(values.max()), -int(values.min())) * values.shape[1] < 1 << 63:
        return np.add.reduceat(values, begins, axis=1)
    return np.add.reduceat(values.astype(object), begins, axis=1).astype(np.int64)


def _nodes(names: pa.Table, found: Sequence[tuple], dims: Sequence[str], sums: Sequence[str], bits: Sequence[str]) -> pa.RecordBatch:
    depth = np.concatenate([np.full(len(at), d, np.int32) for d, at, _, _ in found])
    at = np.concatenate([at for _, at, _, _ in found])
    labels = [names.column(i).combine_chunks().take(pa.array(at, mask=depth <= i)) for i in range(len(dims))]
    add, some = np.concatenate([x[2] for x in found], axis=1), np.concatenate([x[3] for x in found], axis=1)
    return pa.RecordBatch.from_arrays([*labels, pa.array(depth), *[pa.array(x) for x in (*add, *some)]], names=[*dims, "depth", *sums, *bits])


def _changed(rows: DataFrame, dims: Sequence[str], dealt_by: int) -> DataFrame:
    """rows in the order of dims, those that share the first ones in one task, with changed: the first dimension in which a row differs from the one before it."""
    rest = dims[dealt_by:]
    before = F.lag(F.struct(F.lit(1).alias("__any"), *rest)).over(Window.partitionBy(*dims[:dealt_by]).orderBy(*(rest or dims or [F.lit(0)])))
    differs = F.when(F.col("__before").isNull(), 0)
    for i, d in enumerate(rest):
        differs = differs.when(~F.col(f"__before.`{d}`").eqNullSafe(F.col(d)), dealt_by + i)
    return rows.withColumn("__before", before).withColumn("changed", differs.otherwise(len(dims))).drop("__before")


def qualified_rollup(events: DataFrame | Callable[[], DataFrame], dims: Sequence[str], sums: Sequence[str], account: str = "account", unknown: str = "unknown-account", shares: int | None = None) -> DataFrame:
    """(dims, depth, path, events, sums, coverage, missing, quality, methods, sources) for each group at each depth, down from the total.

    events have the dims, the sums (whole numbers; null if no event of a group
    has one), evidence, heuristic (their instant is a guess), missing (array of
    component kinds) and source. A group is measured if all its events are,
    estimated if none is, else mixed; one event of guessed instant makes it
    estimated, by one more method. It is complete if no event lacks anything; a
    group of the unknown account, and all below it, lacks the account.

    events may be a function that makes them; what it stages is deleted when they
    are dealt. Events that share the first two dimensions are in one of `shares`
    (as many as shuffles have partitions), each a task's sorted stream of which
    it holds a batch. The nodes are made when they are asked for; only events
    are staged.
    """
    spark = SparkSession.active() if callable(events) else events.sparkSession
    first = min(_DEALT, len(dims))  # without dims there is only the total
    reported = F.coalesce(F.col("evidence") == REPORTED, F.lit(False))
    none = F.array().cast("array<string>")
    guessed = F.coalesce(F.col("heuristic").cast("bigint"), F.lit(0))
    methods = F.when(reported, none).otherwise(F.array(F.coalesce("evidence", F.lit("unknown"))))

    def rows_of() -> DataFrame:
        rows = events() if callable(events) else events
        return rows.select(
            *dims, *[F.col(c).cast("bigint").alias(c) for c in sums], reported.cast("bigint").alias("measured"), guessed.alias("heuristic"),
            F.when(guessed > 0, F.array_append(methods, F.lit(UNSCHEDULED))).otherwise(methods).alias("methods"), F.coalesce("missing", none).alias("missing"), F.array("source").alias("sources"),
        )

    rows = dealt(spark, rows_of, "events", dims[:first], shares or int(spark.conf.get("spark.sql.shuffle.partitions"))) if dims else staged(rows_of(), "events")
    values = {c: vocabulary(rows, c) for c in _SETS}
    values["missing"] = sorted({*values["missing"], "account"})
    bits = [f"{c}_{n}" for c in _SETS for n in range(len(_words(values[c])))]
    totals = ["events", *sums, "measured", "heuristic"]
    states = rows.select(*dims, F.lit(1).cast("bigint").alias("events"), *sums, "measured", "heuristic", *[b for c in _SETS for b in to_bits(c, values[c])])
    known = F.lit(0).cast("bigint")
    for i, c in enumerate(sums):
        known = known.bitwiseOR(F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    plain = states.select(*dims, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in totals], *bits, known.alias("known"))
    types = ", ".join([*(f"`{d}` {rows.schema[d].dataType.simpleString()}" for d in dims), "depth int", *(f"`{c}` bigint" for c in (*totals, *bits, "known"))])
    deep = _changed(plain, dims, first).mapInArrow(lambda batches: _runs(batches, dims, totals, [*bits, "known"], first), types)
    out = deep.withColumns({c: F.when(F.col("known").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.col(c)) for i, c in enumerate(sums)}).drop("known")
    for depth in range(first - 1, -1, -1):
        states = merged(states, dims[:depth], sums, values)
        part = states.select(*[F.col(d) if i < depth else F.lit(None).cast(rows.schema[d].dataType).alias(d) for i, d in enumerate(dims)], F.lit(depth).alias("depth"), *totals, *bits)
        out = out.unionByName(part)
    path = F.concat_ws(" / ", *[F.concat(F.lit(f"{d}="), F.col(d)) for d in dims])  # null beyond the depth
    quality = F.when(F.col("heuristic") > 0, "estimated").when(F.col("measured") == F.col("events"), "measured").when(F.col("measured") == 0, "estimated").otherwise("mixed")
    out = out.where("events is not null")
    if account in dims:
        word, bit = divmod(values["missing"].index("account"), _WORD)
        out = out.withColumn(f"missing_{word}", F.when(F.col(account) == unknown, F.col(f"missing_{word}").bitwiseOR(F.lit(1 << bit).cast("bigint"))).otherwise(F.col(f"missing_{word}")))
    complete = F.lit(True)
    for n in range(len(_words(values["missing"]))):
        complete = complete & (F.col(f"missing_{n}") == 0)
    return out.select(*dims, "depth", path.alias("path"), "events", *sums, F.when(complete, "complete").otherwise("partial").alias("coverage"), from_bits("missing", values["missing"]).alias("missing"), quality.alias("quality"), *[from_bits(c, values[c]).alias(c) for c in ("methods", "sources")])
