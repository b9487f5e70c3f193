"""Quota meters: anomalies between observations, coverage of sampling, failures, freshness, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND
from ..functions.exact import clamp, trunc_div
from .timeline import islands, merge_intervals

# Tolerances of the transition rules.
TOLERANCE = 2 * SECOND
DEDUP_APART = 5 * SECOND


def transitions(rows: DataFrame, by: Sequence[str] = ("account",)) -> DataFrame:
    """rows(account, ts, used_ppm, reset_at) plus what each is against the observation before it: first, none, decrease or unexpected_reset.

    A change of the reset instant is legitimate if it was due (the observation
    comes no more than two seconds before the old reset) and advanced (the new
    reset is two seconds later, or one side has none).
    """
    w = Window.partitionBy(*by).orderBy("ts")
    old_used, old_reset = F.lag("used_ppm").over(w), F.lag("reset_at").over(w)
    rows = rows.withColumn("old_used", old_used).withColumn("old_reset", old_reset).withColumn("nth", F.row_number().over(w))
    one = F.col("old_reset").isNull() != F.col("reset_at").isNull()
    changed = one | F.coalesce(F.abs(F.col("reset_at") - F.col("old_reset")) >= TOLERANCE, F.lit(False))
    due = F.coalesce(F.col("ts") >= F.col("old_reset") - TOLERANCE, F.lit(False))
    advanced = one | F.coalesce(F.col("reset_at") >= F.col("old_reset") + TOLERANCE, F.lit(False))
    legit = changed & due & advanced
    kind = F.when(F.col("nth") == 1, "first").when((F.col("used_ppm") < F.col("old_used")) & ~legit, "decrease").when((F.col("used_ppm") >= F.col("old_used")) & changed & ~legit & F.col("old_reset").isNotNull(), "unexpected_reset").otherwise("none")
    return rows.withColumn("anomaly", kind).drop("old_used", "old_reset", "nth")


def failure_tally(attempts: DataFrame) -> DataFrame:
    """(account, attempts, successes, and a count for each failure class)."""
    of = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return attempts.groupBy("account").agg(F.count("*").alias("attempts"), of("success"), of("auth_required"), of("unreachable"), of("rate_limited"), of("interrupted"))


def auth_streaks(attempts: DataFrame) -> DataFrame:
    """Failed sign-ins with their place in a run of consecutive ones; success, interruption and a changed credential start anew.

    A credential changed if it differs from the last one that was known.
    """
    w = Window.partitionBy("account").orderBy("ts", "attempt")
    known = F.last("context", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = attempts.withColumn("changed", F.coalesce(F.col("context") != known, F.lit(False)))
    reset = F.col("outcome").isin("success", "interrupted") | F.col("changed")
    fails = F.col("outcome") == "auth_required"
    numbered = islands(rows, ["account"], ["ts", "attempt"], reset)
    streak = F.sum(fails.cast("int")).over(Window.partitionBy("account", "island").orderBy("ts", "attempt").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("streak", streak).where(fails).select("account", "attempt", "ts", "streak", "changed")


def auth_hold(streak: Column, cadence: int, longest: int, grace: int = 2) -> Column:
    """How long sampling waits after so many failed sign-ins: the cadence, doubled for each beyond the grace, up to longest."""
    return F.least(F.call_function("shiftleft", F.lit(cadence).cast("bigint"), F.least(F.greatest(streak - grace + 1, F.lit(0)), F.lit(30)).cast("int")), F.lit(longest))


def holds(attempts: DataFrame, cadence: int, cap: int, longest: int) -> DataFrame:
    """(account, start, end): when sampling was put off beyond its cadence, merged. Retry-After is capped; sign-in holds grow with the streak."""
    retry = attempts.where((F.col("outcome") == "rate_limited") & F.col("retry_s").isNotNull()).select("account", F.col("ts").alias("start"), F.least(F.col("retry_s") * SECOND, F.lit(cap)).alias("length"))
    auth = auth_streaks(attempts).select("account", F.col("ts").alias("start"), auth_hold(F.col("streak"), cadence, longest).alias("length"))
    both = retry.unionByName(auth).where(F.col("length") > cadence)
    return merge_intervals(both.select("account", "start", (F.col("start") + F.col("length")).alias("end")), ["account"])


def expected_opportunities(policies: DataFrame, held: DataFrame, since: int, until: int) -> DataFrame:
    """(account, expected, covered): how many samples policies (account, ts, cadence) asked for in [since, until), and from when on one was in force.

    Time is cut at each change of policy; in each slice the time that isn't
    held, divided by its cadence, counts in whole numbers. Time before an
    account's first policy owes nothing; an account without one in the interval
    has no row.
    """
    w = Window.partitionBy("account").orderBy("ts")
    slices = policies.select("account", "cadence", F.greatest("ts", F.lit(since)).alias("ts"), F.least(F.coalesce(F.lead("ts").over(w), F.lit(until)), F.lit(until)).alias("stop")).where(F.col("stop") > F.col("ts"))
    s, h = slices.alias("s"), held.alias("h")
    joined = s.join(h, (F.col("s.account") == F.col("h.account")) & (F.col("h.start") < F.col("s.stop")) & (F.col("h.end") > F.col("s.ts")), "left")
    covered = F.when(F.col("h.start").isNotNull(), F.least("s.stop", "h.end") - F.greatest("s.ts", "h.start"))
    per = joined.groupBy("s.account", "s.ts", "s.stop", "s.cadence").agg(F.coalesce(F.sum(covered), F.lit(0)).cast("bigint").alias("held"))
    return per.groupBy("account").agg(F.sum(trunc_div(F.col("stop") - F.col("ts") - F.col("held"), F.col("cadence"))).cast("bigint").alias("expected"), F.min("ts").alias("covered"))


def newest(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows of each key, with their place."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def trailing_failures(attempts: DataFrame, cap: int = 64) -> DataFrame:
    """(account, failures): failed sign-ins since the newest attempt that was none, among the newest `cap`."""
    rows = newest(attempts, ["account"], ["ts", "attempt"], cap)
    first_other = F.min(F.when(F.col("outcome") != "auth_required", F.col("nth")))
    return rows.groupBy("account").agg((F.coalesce(first_other, F.count("*") + 1) - 1).alias("failures"))


def freshness(latest: DataFrame, now: int, horizon: int, command: int) -> DataFrame:
    """latest(account, outcome, started, failed_context, context, verified, observed) plus state, and reason where stale.

    Top down: no attempt; success; sign-in required; unreachable; no result.
    """
    outcome, started, observed = F.col("outcome"), F.col("started"), F.col("observed")
    stale = lambda r: F.struct(F.lit("stale").alias("state"), F.lit(r).alias("reason"))
    plain = lambda s: F.struct(F.lit(s).alias("state"), F.lit(None).cast("string").alias("reason"))
    seen = F.when(observed.isNull(), stale("no_successful_observation")).when(observed > now, stale("clock_anomaly")).when(now - observed <= horizon, plain("fresh")).otherwise(stale("age_exceeded"))
    same = F.coalesce(F.col("failed_context") == F.col("context"), F.lit(False))
    other = F.coalesce(F.col("failed_context") != F.col("context"), F.lit(False)) & ~F.coalesce(F.col("verified"), F.lit(False))
    verdict = (
        F.when(started.isNull(), F.when(observed.isNull(), stale("no_successful_observation")).otherwise(stale("sampling_gap")))
        .when(outcome == "success", seen)
        .when(outcome == "auth_required", plain("auth_required"))
        .when((outcome == "unreachable") & same, plain("auth_required"))
        .when((outcome == "unreachable") & other, stale("credential_changed_unverified"))
        .when(outcome.isNotNull(), F.struct(F.lit("stale").alias("state"), outcome.alias("reason")))
        .when(started > now, stale("clock_anomaly"))
        .when(now - started > command, stale("collector_interrupted"))
        .when(same, plain("auth_required"))
        .when(other, stale("credential_changed_unverified"))
        .otherwise(seen)
    )
    return latest.withColumn("v", verdict).select(*latest.columns, "v.state", "v.reason")


def burn_rate(used_ppm: Column, start: Column, nominal: Column, now: Column) -> Column:
    """Used part over elapsed part of a window in millionths; null when capped, not started or under 1% elapsed. Exact for any nanoseconds."""
    elapsed, whole = clamp(now - start, 0, nominal).cast("decimal(38,0)"), nominal.cast("decimal(38,0)")
    return F.when((used_ppm < 1_000_000) & (elapsed > 0) & (elapsed * 100 >= whole), F.call_function("div", used_ppm.cast("decimal(19,0)") * nominal.cast("decimal(19,0)"), elapsed)).cast("bigint")


def frozen_rate(rows: DataFrame, cycle_start: int) -> DataFrame:
    """(account, capped_at): the first observation at the cap strictly after a cycle's start."""
    return rows.where((F.col("used_ppm") >= 1_000_000) & (F.col("ts") > cycle_start)).groupBy("account").agg(F.min("ts").alias("capped_at"))


def due(latest: DataFrame, now: int, lead: int) -> DataFrame:
    """latest(account, forced, reset_at, next_reset, started, evidence, last_due, cadence, hold) plus due_at and why."""
    reset_passed = (F.col("reset_at") <= now) & F.coalesce(F.col("started") < F.col("reset_at"), F.lit(True))
    edge = (F.col("next_reset") > now) & (F.col("next_reset") - now <= lead) & F.coalesce(now - F.col("evidence") > lead, F.lit(True))
    regular = F.greatest(F.col("last_due") + F.col("cadence"), F.coalesce(F.col("hold"), F.lit(0)))
    why = F.when(F.col("forced"), "forced").when(reset_passed, "post_reset").when(edge, "reset_edge").when(F.col("started").isNull(), "never_sampled").otherwise("cadence")
    return latest.withColumn("why", why).withColumn("due_at", F.when(F.col("why") == "cadence", regular).otherwise(now))


def selection(windows: DataFrame, now: int) -> DataFrame:
    """windows(account, idx, used_ppm, reset_at, nominal, weight, and burn where it is known) -> (account, verdict, runway, gap).

    Windows without reset and use aren't looked at. Any full one: exhausted_now.
    Else any that can't be measured: unknown. Else any that runs out before its
    reset: projected_exhaustion, with the least time left. Else through_reset.
    gap: the weighted mean of what is left against the time that is left, held
    inside 100. burn: used over elapsed part; where it isn't given it follows from both.
    """
    live = windows.where(F.col("reset_at").isNotNull() | (F.col("used_ppm") > 0))
    left = F.col("reset_at") - now
    measurable = F.coalesce((left > 0) & (left <= F.col("nominal")), F.lit(False))
    time_left = left * 100.0 / F.col("nominal")
    derived = F.col("used_ppm") / 10_000.0 / (100.0 - time_left)
    burn = F.coalesce("burn", derived) if "burn" in windows.columns else derived
    rest = 100.0 - F.col("used_ppm") / 10_000.0
    measured = live.withColumn("ok", measurable & (F.coalesce(time_left, F.lit(100.0)) < 100.0))
    measured = measured.withColumn("gap", F.when(F.col("ok"), (rest - burn * time_left) / time_left)).withColumn("runs", F.when(F.col("ok") & (burn > 0), rest / 100.0 / burn * F.col("nominal"))).withColumn("short", F.when(F.col("ok"), F.coalesce(F.col("runs") < left, F.lit(False))))
    out = measured.groupBy("account").agg(
        F.bool_or(F.col("used_ppm") >= 1_000_000).alias("full"), F.bool_and("ok").alias("all_ok"), F.bool_or("short").alias("short"),
        F.min(F.when(F.col("short"), F.round("runs"))).alias("least"), F.sum(F.when(F.col("ok"), F.col("gap") * F.col("weight"))).alias("g"), F.sum(F.when(F.col("ok"), F.col("weight"))).alias("w"),
    )
    verdict = F.when(F.col("full"), "exhausted_now").when(~F.col("all_ok"), "unknown").when(F.col("short"), "projected_exhaustion").otherwise("through_reset")
    gap = F.when(~F.col("full") & (F.col("w") > 0), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("g") / F.col("w"))))
    return out.select("account", verdict.alias("verdict"), F.when(F.col("full"), F.lit(0)).when(F.col("all_ok") & F.col("short"), F.col("least")).cast("bigint").alias("runway"), gap.alias("gap"))


def confidence(windows: DataFrame, now: int, early: float = 0.2) -> DataFrame:
    """windows as for selection -> (account, confidence): early if less than a fifth of the limiting window's cycle has gone, else established.

    The limiting window is the most used of those that have a reset, the first
    by idx of equals. Accounts without one, or whose window has no length, are
    established: there is nothing to time.
    """
    started = F.col("reset_at").isNotNull()
    limit = F.max_by(F.struct("reset_at", "nominal"), F.when(started, F.struct("used_ppm", -F.col("idx"))))
    gone = 1.0 - (F.col("x.reset_at") - now) / F.col("x.nominal")
    young = (F.col("x.nominal") > 0) & (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("x.nominal") > 0, gone))) < early)
    return windows.groupBy("account").agg(limit.alias("x")).select("account", F.when(F.coalesce(young, F.lit(False)), "early").otherwise("established").alias("confidence"))


def window_changes(observations: DataFrame, windows: DataFrame, subset: bool = False) -> DataFrame:
    """(account, observation, previous, key, scope, name, change): what differs between each observation of an account and the one before.

    observations(account, observation, at, plan, tier) in their order; windows
    (account, observation, key, scope, name, used_ppm, reset, reset_at, nominal,
    precision), reset being known, not_started or scheduled. A window is the same
    by key, scope and name; groups of models are left out. One that is in both
    observations is judged if plan and tier are the same and time doesn't run
    backwards: percentage_decrease_without_reset or
    unexpected_reset_timestamp_change. Whatever the plan, a new window of the
    whole account is new_account_wide_window, and a missing one of a model
    missing_model_specific_window, unless the source only ever shows a `subset`.

    A window is emitted for its own observation's number and for the next one's:
    one aggregate brings both sides together, with what appeared and what went.
    """
    w = Window.partitionBy("account").orderBy("observation")
    facts = ("observation", "at", "plan", "tier")
    seen = observations.select("account", F.row_number().over(w).alias("n"), *facts, *[F.lag(c).over(w).alias(f"old_{c}") for c in facts])
    value = F.struct("used_ppm", "reset", "reset_at", "nominal", "precision")
    placed = windows.where("scope <> 'group'").join(seen.select("account", "observation", "n"), ["account", "observation"]).select("account", "n", "key", "scope", "name", value.alias("v"))
    both = placed.withColumn("now", F.lit(True)).union(placed.withColumn("n", F.col("n") + 1).withColumn("now", F.lit(False)))
    pick = lambda now: F.max(F.when(F.col("now") == now, F.col("v")))
    pairs = both.groupBy("account", "n", "key", "scope", "name").agg(pick(True).alias("new"), pick(False).alias("old")).join(seen.where("n > 1"), ["account", "n"])
    gap = F.col("at") - F.col("old_at")
    same_precision = F.col("new.precision") == F.col("old.precision")
    tolerance = F.when(F.coalesce(same_precision, F.lit(False)), F.greatest(F.lit(TOLERANCE), F.col("new.precision") + gap)).otherwise(TOLERANCE)
    instant = lambda side: F.when(F.col(f"{side}.reset") != "not_started", F.col(f"{side}.reset_at"))
    old_reset, reset = instant("old"), instant("new")
    one = old_reset.isNull() != reset.isNull()
    changed = one | F.coalesce(F.abs(reset - old_reset) >= tolerance, F.lit(False))
    due = F.coalesce(F.col("at") >= old_reset - TOLERANCE, F.lit(False))
    legit = changed & due & (one | F.coalesce(reset >= old_reset + TOLERANCE, F.lit(False)))
    begun = (F.col("old.reset") == "not_started") & (F.col("new.reset") == "known") & (reset <= F.col("at") + F.col("new.nominal") + tolerance)
    scheduled = (F.col("old.reset") == "scheduled") | (F.col("new.reset") == "scheduled")
    fell = F.col("new.used_ppm") < F.col("old.used_ppm")
    judged = F.col("plan").eqNullSafe(F.col("old_plan")) & F.col("tier").eqNullSafe(F.col("old_tier")) & (gap >= 0)
    moved = F.when(fell & ~legit, "percentage_decrease_without_reset").when(~fell & changed & ~legit & ~scheduled & ~F.coalesce(begun, F.lit(False)), "unexpected_reset_timestamp_change")
    change = (
        F.when(F.col("old").isNull(), F.when(F.col("scope") == "account", "new_account_wide_window"))
        .when(F.col("new").isNull(), F.when((F.col("scope") == "model") & F.lit(not subset), "missing_model_specific_window"))
        .when(judged, moved)
    )
    return pairs.select("account", "observation", F.col("old_observation").alias("previous"), "key", "scope", "name", change.alias("change")).where("change is not null")


def reading_age(provider: Column, received: Column, basis: Column, now: int, envelope: int) -> tuple[Column, Column]:
    """(age, anomaly) of a reading; age is null where there is an anomaly.

    provider_ahead: the provider's time is later than the receipt by more than the
    envelope; future: the time that counts lies after now. A provider's time
    before the receipt is honest, however old it is. basis is provider_observed
    (the receipt, if the provider states none), locally_received or
    older_of_the_two.
    """
    ahead = F.coalesce(provider - received > envelope, F.lit(False))
    measured = F.when(basis == "provider_observed", F.coalesce(provider, received)).when(basis == "older_of_the_two", F.least(provider, received)).otherwise(received)
    anomaly = F.when(ahead, "provider_ahead").when(measured > now, "future")
    return F.when(anomaly.isNull(), F.lit(now) - measured), anomaly
