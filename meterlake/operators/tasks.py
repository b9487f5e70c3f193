"""Reports of tasks with what qualifies them: usage by kind, coverage, quality, credits or why there are none, by task and by session."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .qualified import REPORTED


def _union(column: str) -> Column:
    """All values in a column of sets, sorted: estimators or classes of failure, a few words however many rows."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column)


def session_usage(usage: DataFrame, kinds: Sequence[str], quarantine: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(task, session, events, kinds, measured, methods, quarantined): the state of a task's usage in one session, which merges to the task's.

    usage(task, session, evidence, kinds): a null count is none, null evidence
    an unknown estimator, a null session one of its own; usage without a task
    belongs to no report. quarantine(scope, class) holds the records that could
    not be read: without a scope one of them touches all usage, with session as
    scope that of its session only (null sessions are touched by null sessions).
    """
    reported = F.coalesce(F.col("evidence") == REPORTED, F.lit(False))
    per = usage.where("task is not null").groupBy("task", "session").agg(
        F.count("*").alias("events"),
        *[F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in kinds],
        F.count_if(reported).alias("measured"),
        F.array_sort(F.collect_set(F.when(~reported, F.coalesce("evidence", F.lit("unknown"))))).alias("methods"),
    )
    touched = quarantine.groupBy(*[F.col(c).alias(f"q_{c}") for c in scope]).agg(F.array_sort(F.collect_set(F.coalesce("class", F.lit("unknown")))).alias("quarantined"))
    if scope:
        joined = per.join(touched, [per[c].eqNullSafe(touched[f"q_{c}"]) for c in scope], "left")
    else:
        joined = per.join(F.broadcast(touched))  # one row
    return joined.select(*per.columns, F.coalesce("quarantined", F.array().cast("array<string>")).alias("quarantined"))


def task_usage(sessions: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(task, sessions, events, kinds, measured, methods, quarantined): session_usage's states merged to tasks."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("events", *kinds, "measured")]
    return sessions.groupBy("task").agg(F.count("*").alias("sessions"), *sums, _union("methods"), _union("quarantined"))


def qualify(states: DataFrame, kinds: Sequence[str], rates: Mapping[str, int] | None) -> DataFrame:
    """States with coverage, missing, quality, credits and refused in place of measured.

    A state that a quarantined record touches is partial, and any of its kinds
    may lack something. It is measured if all its events are, estimated if none
    is, else mixed. Credits are refused without a cost model (rates None) and
    where a kind that was used has no rate; refused names what is missing.
    """
    none = F.array().cast("array<string>")
    hit = F.size("quarantined") > 0
    if rates is None:
        refused, credits = F.array(F.lit("active cost model")), F.lit(None).cast("bigint")
    else:
        unpriced = [F.when(F.col(k) != 0, F.lit(f"rate of {k}")) for k in sorted(set(kinds) - set(rates))]
        refused = F.array_compact(F.array(*unpriced)) if unpriced else none
        cost = sum((F.col(k) * rates[k] for k in kinds if k in rates), F.lit(0).cast("bigint"))
        credits = F.when(F.size(refused) == 0, cost)
    quality = F.when(F.col("measured") == F.col("events"), "measured").when(F.col("measured") == 0, "estimated").otherwise("mixed")
    return states.select(
        *[c for c in states.columns if c not in ("measured", "quarantined")], "quarantined",
        F.when(hit, "partial").otherwise("complete").alias("coverage"), F.when(hit, F.array(*map(F.lit, kinds))).otherwise(none).alias("missing"),
        quality.alias("quality"), credits.alias("credits"), refused.alias("refused"),
    )


def with_claims(reports: DataFrame, resolved: DataFrame) -> DataFrame:
    """reports plus how many claims of all, resolved(state), found no session and how many found several; zeros without claims."""
    counts = resolved.agg(F.count_if(F.col("state") == "unresolved").alias("unresolved_claims"), F.count_if(F.col("state") == "ambiguous").alias("ambiguous_claims"))
    return reports.join(F.broadcast(counts))  # one row
