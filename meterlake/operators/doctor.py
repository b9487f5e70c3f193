"""Health checks over the ledger: each is an aggregate and a threshold, all of them one table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, rows: DataFrame, measured: Column, warn: int, fail: int | None = None) -> DataFrame:
    """(name, measured, status): ok below warn, warning from there, failing from fail up; unknown where nothing was measured."""
    m = rows.agg(measured.cast("bigint").alias("measured"))
    status = F.when(F.col("measured").isNull(), "unknown")
    if fail is not None:
        status = status.when(F.col("measured") >= fail, "failing")
    return m.select(F.lit(name).alias("name"), "measured", status.when(F.col("measured") >= warn, "warning").otherwise("ok").alias("status"))


def doctor(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


@dataclass(frozen=True)
class Finding:
    """What makes a row a finding; which rows a check is about (all, if not said); what names the row; how bad a finding is: fail, warn or note."""

    bad: Column
    label: Column
    about: Column | None = None
    severity: str = "fail"


def panel(rows: DataFrame, checks: Mapping[str, Finding], samples: int = 5) -> DataFrame:
    """(name, status, found, about, sample) of several checks over one relation.

    Status is not_applicable where a check is about no row, pass without
    findings, else the severity of the check; note passes with a detail. A null
    condition is no finding. The sample holds the first `samples` different labels
    in order. One pass counts all checks; samples are cut by row numbers below a
    constant, which Spark limits before the shuffle.
    """
    about = {n: F.coalesce(F.lit(True) if c.about is None else c.about, F.lit(False)) for n, c in checks.items()}
    bad = {n: about[n] & F.coalesce(c.bad, F.lit(False)) for n, c in checks.items()}
    counts = rows.agg(*[F.struct(F.count_if(bad[n]).alias("found"), F.count_if(about[n]).alias("about")).alias(n) for n in checks])
    severity = lambda n: F.lit(checks[n].severity)
    stacked = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), severity(n).alias("severity"), F.col(f"`{n}`.found").alias("found"), F.col(f"`{n}`.about").alias("about")) for n in checks])).alias("c")).select("c.*")
    labels = rows.select(F.explode(F.array_compact(F.array(*[F.when(bad[n], F.struct(F.lit(n).alias("name"), c.label.cast("string").alias("label"))) for n, c in checks.items()]))).alias("l")).select("l.*")
    w = Window.partitionBy("name").orderBy("label")
    shown = labels.where("label is not null").distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= samples).groupBy("name").agg(F.array_sort(F.collect_list("label")).alias("sample"))
    status = F.when(F.col("about") == 0, "not_applicable").when(F.col("found") == 0, "pass").otherwise(F.col("severity"))
    return stacked.join(shown, "name", "left").select("name", status.alias("status"), "found", "about", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))
