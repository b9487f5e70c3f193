"""Spend: filters with their exclusions, roll-ups over ordered dimensions, qualified sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketed(value: Column, dimension: str) -> Column:
    """A dimension's value; null and empty go to the dimension's own unknown bucket."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(f"unknown-{dimension}"))


def within(rows: DataFrame, ts: str, since: int, until: int) -> DataFrame:
    """Rows in [since, until); rows without an instant are outside."""
    return rows.where((F.col(ts) >= since) & (F.col(ts) < until))


def filter_outcomes(rows: DataFrame, filters: Sequence[tuple[str, Sequence[str]]], session: str = "session") -> DataFrame:
    """(filter, dimension, events, sessions, unknown) for each filter in turn: what it excludes of its predecessors' survivors, and how much of that is in the unknown bucket.

    One pass: the first filter that a row fails takes it.
    """
    passes = [F.col(d).isin(list(values)) for d, values in filters]
    first = F.coalesce(*[F.when(~p, F.lit(i)) for i, p in enumerate(passes)])
    unknown = F.coalesce(*[F.when(~p, F.col(d) == f"unknown-{d}") for p, (d, _) in zip(passes, filters, strict=True)])
    failed = rows.withColumn("filter", first).withColumn("u", unknown).where("filter is not null")
    names = F.element_at(F.array(*[F.lit(d) for d, _ in filters]), F.col("filter") + 1)
    return failed.groupBy("filter").agg(F.count("*").alias("events"), F.count_distinct(session).alias("sessions"), F.count_if("u").alias("unknown")).withColumn("dimension", names)


def surviving(rows: DataFrame, filters: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    for d, values in filters:
        rows = rows.where(F.col(d).isin(list(values)))
    return rows


def rollup(rows: DataFrame, dims: Sequence[str], sums: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """A row for each group at each depth, down from the grand total: its dimensions, depth, path, events and sums."""
    out = rows.rollup(*dims).agg(F.grouping_id().alias("gid"), F.count("*").alias("events"), *[F.sum(c).cast("bigint").alias(c) for c in sums], *more)
    depth = len(dims) - F.bit_count("gid")
    path = F.concat_ws(" / ", *[F.when(depth > i, F.concat(F.lit(f"{d}="), F.col(d))) for i, d in enumerate(dims)])
    return out.withColumn("depth", depth.cast("int")).withColumn("path", path).drop("gid")


def uniform(value: Column) -> Column:
    """Aggregate: the value that all rows of a group share, null included; null if they differ."""
    return F.when((F.count("*") == F.count(value)) & (F.min(value) == F.max(value)), F.min(value))


def map_sum(rows: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Maps of counts summed by key within each group, as one map with sorted keys."""
    long = rows.select(*by, F.explode(column).alias("k", "v")).groupBy(*by, "k").agg(F.sum("v").cast("bigint").alias("v"))
    return long.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(column))


def quality(measured: Column, estimated: Column) -> Column:
    """Aggregate: measured, estimated or mixed evidence."""
    return F.when(F.bool_and(measured), "measured").when(F.bool_and(estimated), "estimated").otherwise("mixed")


def missing(column: str) -> Column:
    """Aggregate: the union of rows' missing facts, sorted; empty means complete."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def share_sets(column: str) -> Column:
    """Aggregate: the sorted distinct values."""
    return F.array_sort(F.collect_set(column))


def limiting(value: str, index: str, keep: Sequence[str]) -> Column:
    """Aggregate: the kept columns of the row with the least value, the first of equals."""
    return F.min_by(F.struct(*keep), F.struct(value, index))
