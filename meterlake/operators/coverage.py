"""Sampling coverage: what was expected of a collector, what it tried, what it saw, and where it slept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND
from ..functions.exact import share_ppm
from ..sources.staging import staged, whole
from . import meter, timeline

# How much longer than the cadence a gap must be to count as a hole, and how close together resets are one.
HOLE, ONE_RESET = 60 * SECOND, 5 * SECOND


def reset_holes(instants: DataFrame, starts: DataFrame, resets: DataFrame, policies: DataFrame, until: int) -> DataFrame:
    """(account, severe): how many gaps between attempts hold a reset, ends included, and are longer than the cadence in force there by more than HOLE.

    instants(account, ts) lie between an account's start, starts(account, ts),
    and until, which end gaps as they do. One ordered pass over both and the
    resets; a reset at an instant stands on both sides of it.
    """
    once = timeline.thin_instants(resets.where(F.col("ts") <= until), ["account"], "ts", ONE_RESET)
    known = timeline.asof(once, policies, ["account"], "ts", ["cadence"])
    bounds = instants.select("account", "ts").union(starts.select("account", "ts")).union(starts.select("account", F.lit(until).cast("bigint")))
    marks = bounds.select("account", "ts", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("cadence"))
    sides = known.where("cadence is not null").select("account", "ts", F.explode(F.array(F.lit(0), F.lit(2))).alias("side"), F.col("cadence").cast("bigint"))
    # A frame to the end of an account would be read anew from each of its rows: what follows is what precedes in the other order.
    on, back = Window.partitionBy("account").orderBy("ts", "side"), Window.partitionBy("account").orderBy(F.desc("ts"), F.desc("side"))
    held = F.last(F.when(F.col("side") == 1, F.col("ts")), ignorenulls=True)
    both = marks.union(sides).withColumn("a", held.over(on.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", held.over(back.rowsBetween(Window.unboundedPreceding, 0)))
    holes = both.where((F.col("side") != 1) & (F.col("b") - F.col("a") > F.col("cadence") + HOLE)).select("account", "a", "b").distinct()
    return holes.groupBy("account").agg(F.count("*").alias("severe"))


@whole
def report(policies: DataFrame, attempts: DataFrame, held: DataFrame, resets: DataFrame, since: int, until: int) -> DataFrame:
    """One row for each account of policies or attempts over [since, until).

    (account, expected, attempted, unfinished, observed, attempt_ppm,
    measured_ppm, no_attempt, no_observation, severe). policies(account, ts,
    cadence), attempts(account, ts, finished, observed), held(account, start,
    end), resets(account, ts). expected is null without a policy; attempt_ppm
    is attempts over expected, held at a million, and null where nothing was
    owed; measured_ppm is observations over finished attempts. Gaps begin where
    the first policy does, or with the interval if there is none.

    All is by account, so that one task would make it all at once and sort its
    attempts a dozen times side by side: the steps are staged.
    """
    accounts = policies.select("account").union(attempts.select("account")).distinct()
    inside = attempts.where((F.col("ts") >= since) & (F.col("ts") < until))
    counts = inside.groupBy("account").agg(F.count("*").alias("attempted"), F.count_if(~F.col("finished")).alias("unfinished"), F.count_if("observed").alias("observed"))
    base = accounts.join(meter.expected_opportunities(policies, held, since, until), "account", "left").join(counts, "account", "left")
    base = staged(base.select("account", "expected", F.coalesce("covered", F.lit(since)).alias("covered"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("attempted", "unfinished", "observed")]), "base")
    placed = staged(inside.join(base.select("account", "covered"), "account").where(F.col("ts") >= F.col("covered")).select("account", "ts", "observed"), "placed")
    starts = base.select("account", F.col("covered").alias("ts"))

    # Of all instants and of those observed, each with the start.
    every = F.lit("no_attempt")
    marks = placed.select("account", "ts", F.explode(F.when(F.col("observed"), F.array(every, F.lit("no_observation"))).otherwise(F.array(every))).alias("of"))
    marks = marks.union(starts.select("account", "ts", F.explode(F.array(every, F.lit("no_observation")))))
    after = F.coalesce(F.lead("ts").over(Window.partitionBy("account", "of").orderBy("ts")), F.lit(until))
    gaps = marks.withColumn("gap", after - F.col("ts")).groupBy("account").agg(*[F.max(F.when(F.col("of") == c, F.col("gap"))).alias(c) for c in ("no_attempt", "no_observation")])
    holes = staged(reset_holes(placed, starts, resets, policies, until), "holes")
    out = base.join(staged(gaps, "gaps"), "account").join(holes, "account", "left")
    finished = F.col("attempted") - F.col("unfinished")
    return out.select(
        "account", "expected", "attempted", "unfinished", "observed",
        F.when(F.col("expected") > 0, share_ppm(F.least("attempted", "expected"), F.col("expected"))).alias("attempt_ppm"),
        F.when(finished > 0, share_ppm(F.least(F.col("observed"), finished), finished)).alias("measured_ppm"),
        "no_attempt", "no_observation", F.coalesce("severe", F.lit(0)).cast("bigint").alias("severe"),
    )
