"""Queries over meter series and sampling attempts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.clock import SECOND
from ..operators import coverage, dedup, meter, timeline
from ..sources import tables as t
from .registry import query

HOUR, DAY = 3600 * SECOND, 86_400 * SECOND
#: The interval of coverage and of what is expected in it.
SINCE, UNTIL = 1_704_200_000 * SECOND, 1_706_500_000 * SECOND
M_SQL = f"{t.EV_SQL}, {t.METER_SQL}, mr AS (SELECT *, (ts // {DAY} + 1) * {DAY} AS reset_at FROM meter)"
A_SQL = f"{t.EV_SQL}, {t.ATT_SQL}"


def observations(spark, sf_dir):
    """Meter readings whose windows end at midnight."""
    return t.meter(spark, sf_dir).withColumn("reset_at", F.expr(f"(ts div {DAY} + 1) * {DAY}"))


@query(
    "WN-1_cumulative_delta",
    f"WITH {t.EV_SQL}, c AS (SELECT user_id, ts, event_id, amount, k, lag(amount) OVER w AS pa, lag(k) OVER w AS pk FROM ev WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT *, amount < pa AS fa, k < pk AS fk FROM c) SELECT event_id, CASE WHEN coalesce(fa, false) OR coalesce(fk, false) THEN NULL ELSE amount - coalesce(pa, 0) END AS delta_amount, CASE WHEN coalesce(fa, false) OR coalesce(fk, false) THEN NULL ELSE k - coalesce(pk, 0) END AS delta_k, concat_ws(',', CASE WHEN fa THEN 'amount' END, CASE WHEN fk THEN 'k' END) AS decreased FROM d",
)
def wn1(spark, sf_dir):
    rows = dedup.cumulative_deltas(t.events(spark, sf_dir, "view"), ["user_id"], ["ts", "event_id"], ["amount", "k"])
    return rows.select("event_id", "delta_amount", "delta_k", F.array_join("decreased", ",").alias("decreased"))


@query(
    "WN-2_window_anomalies",
    f"""WITH {M_SQL}, p AS (SELECT *, lag(used_ppm) OVER w AS ou, lag(reset_at) OVER w AS o FROM mr WINDOW w AS (PARTITION BY account ORDER BY ts)),
f AS (SELECT *, abs(reset_at - o) >= 2000000000 AS changed, ts >= o - 2000000000 AS due, reset_at >= o + 2000000000 AS adv FROM p)
SELECT observation, CASE WHEN ou IS NULL THEN 'first' WHEN used_ppm < ou AND NOT (changed AND due AND adv) THEN 'decrease' WHEN used_ppm >= ou AND changed AND NOT (due AND adv) THEN 'unexpected_reset' ELSE 'none' END AS anomaly FROM f""",
)
def wn2(spark, sf_dir):
    return meter.transitions(observations(spark, sf_dir)).select("observation", "anomaly")


@query("WN-3_longest_gap", f"WITH {M_SQL}, i AS (SELECT account, ts FROM meter WHERE ts >= {SINCE} AND ts < {UNTIL} UNION ALL SELECT DISTINCT user_id, {UNTIL} FROM ev), g AS (SELECT account, ts, ts - coalesce(lag(ts) OVER (PARTITION BY account ORDER BY ts), {SINCE}) AS gap FROM i) SELECT account, max(gap) AS gap, arg_max(ts, {{'g': gap, 't': ts}}) AS until FROM g GROUP BY account")
def wn3(spark, sf_dir):
    accounts = t.events(spark, sf_dir).select(F.col("user_id").alias("account"))
    return timeline.longest_gap(timeline.gaps(t.meter(spark, sf_dir), ["account"], "ts", SINCE, UNTIL, accounts), ["account"], "ts")


@query(
    "WN-4_interval_merge",
    f"""WITH {t.EV_SQL}, i AS (SELECT user_id AS account, ts AS s, ts + amount * {60 * SECOND} AS e FROM ev),
o AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY account ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 1) THEN 1 ELSE 0 END AS opens FROM i),
n AS (SELECT *, sum(opens) OVER (PARTITION BY account ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o)
SELECT account, min(s) AS start, max(e) AS "end" FROM n GROUP BY account, island""",
)
def wn4(spark, sf_dir):
    rows = t.events(spark, sf_dir).select(F.col("user_id").alias("account"), F.col("ts").alias("start"), (F.col("ts") + F.col("amount") * (60 * SECOND)).alias("end"))
    return timeline.merge_intervals(rows, ["account"])


@query(
    "WN-5_thin_instants",
    f"""WITH RECURSIVE {t.EV_SQL}, r AS (SELECT user_id AS account, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
f AS (SELECT account, n, ts AS kept, true AS is_kept FROM r WHERE n = 1
      UNION ALL SELECT r.account, r.n, CASE WHEN r.ts - f.kept > {DAY} THEN r.ts ELSE f.kept END, r.ts - f.kept > {DAY} FROM f JOIN r ON r.account = f.account AND r.n = f.n + 1)
SELECT account, kept AS ts FROM f WHERE is_kept""",
)
def wn5(spark, sf_dir):
    return timeline.thin_instants(t.events(spark, sf_dir).withColumnRenamed("user_id", "account"), ["account"], "ts", DAY)


STREAK_SQL = f"""{A_SQL},
c AS (SELECT *, last_value(context IGNORE NULLS) OVER (PARTITION BY account ORDER BY ts, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM att),
d AS (SELECT *, coalesce(context <> known, false) AS changed FROM c),
i AS (SELECT *, sum((outcome IN ('success', 'interrupted') OR changed)::INT) OVER (PARTITION BY account ORDER BY ts, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM d),
streaks AS (SELECT * FROM (SELECT account, attempt, ts, outcome, changed, sum((outcome = 'auth_required')::INT) OVER (PARTITION BY account, island ORDER BY ts, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS streak FROM i) WHERE outcome = 'auth_required')"""


@query("WN-6_auth_streaks", f"WITH {STREAK_SQL} SELECT attempt, streak FROM streaks")
def wn6(spark, sf_dir):
    return meter.auth_streaks(t.attempts(spark, sf_dir)).select("attempt", "streak")


@query("WN-15_credential_change", f"WITH {STREAK_SQL} SELECT attempt, changed FROM streaks")
def wn15(spark, sf_dir):
    return meter.auth_streaks(t.attempts(spark, sf_dir)).select("attempt", "changed")


HOLD_SQL = f"""{STREAK_SQL},
h AS (SELECT account, ts AS s, least(retry_s * 1000000000, {4 * HOUR}) AS length FROM att WHERE outcome = 'rate_limited' AND retry_s IS NOT NULL
      UNION ALL SELECT account, ts, least(({SECOND * 300} * power(2, least(greatest(streak - 1, 0), 30)))::BIGINT, {24 * HOUR}) FROM streaks),
hi AS (SELECT account, s, s + length AS e FROM h WHERE length > {SECOND * 300}),
ho AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY account ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s - 1) THEN 1 ELSE 0 END AS opens FROM hi),
hn AS (SELECT *, sum(opens) OVER (PARTITION BY account ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ho),
held AS (SELECT account, min(s) AS s, max(e) AS e FROM hn GROUP BY account, island)"""


@query("WN-7_postponements", f'WITH {HOLD_SQL} SELECT account, s AS start, e AS "end" FROM held')
def wn7(spark, sf_dir):
    return meter.holds(t.attempts(spark, sf_dir), 300 * SECOND, 4 * HOUR, 24 * HOUR)


POLICY_SQL = f"pol AS (SELECT user_id AS account, ts, (300 + k * 10) * 1000000000 AS cadence FROM ev WHERE event_type = 'signup')"
EXPECT_SQL = f"""sl AS (SELECT account, cadence, greatest(ts, {SINCE}) AS ts, least(coalesce(lead(ts) OVER (PARTITION BY account ORDER BY ts), {UNTIL}), {UNTIL}) AS stop FROM pol),
x AS (SELECT sl.account, sl.ts, stop, cadence, coalesce(sum(CASE WHEN held.s IS NOT NULL THEN least(stop, held.e) - greatest(sl.ts, held.s) END), 0)::BIGINT AS off FROM sl LEFT JOIN held ON held.account = sl.account AND held.s < stop AND held.e > sl.ts WHERE stop > sl.ts GROUP BY ALL),
expect AS (SELECT account, sum((stop - ts - off) // cadence)::BIGINT AS expected, min(ts) AS covered FROM x GROUP BY account)"""
COVERAGE_SQL = f"""WITH {HOLD_SQL}, {POLICY_SQL}, {EXPECT_SQL}, accounts AS (SELECT DISTINCT account FROM (SELECT account FROM pol UNION ALL SELECT account FROM att)),
tries AS (SELECT account, count(*) AS attempted, count(*) FILTER (WHERE outcome = 'interrupted') AS unfinished, count(*) FILTER (WHERE outcome = 'success') AS observed FROM att WHERE ts >= {SINCE} AND ts < {UNTIL} GROUP BY account),
base AS (SELECT a.account, expected, coalesce(covered, {SINCE}) AS covered, coalesce(attempted, 0) AS attempted, coalesce(unfinished, 0) AS unfinished, coalesce(observed, 0) AS observed FROM accounts a LEFT JOIN expect USING (account) LEFT JOIN tries USING (account)),
inst AS (SELECT att.account, ts, outcome = 'success' AS seen FROM att JOIN base USING (account) WHERE ts >= covered AND ts < {UNTIL}),
ends AS (SELECT account, ts FROM inst UNION ALL SELECT account, {UNTIL} FROM base),
seen AS (SELECT account, ts FROM inst WHERE seen UNION ALL SELECT account, {UNTIL} FROM base),
g AS (SELECT account, coalesce(lag(ts) OVER (PARTITION BY account ORDER BY ts), covered) AS s, ts AS e FROM ends JOIN base USING (account)),
o AS (SELECT account, coalesce(lag(ts) OVER (PARTITION BY account ORDER BY ts), covered) AS s, ts AS e FROM seen JOIN base USING (account)),
res AS (SELECT DISTINCT user_id AS account, (ts // {DAY} + 1) * {DAY} AS ts FROM ev WHERE event_type = 'view'),
cad AS (SELECT res.account, res.ts, pol.cadence FROM res ASOF JOIN pol ON res.account = pol.account AND res.ts >= pol.ts),
severe AS (SELECT account, count(*) AS severe FROM g WHERE EXISTS (SELECT 1 FROM cad WHERE cad.account = g.account AND cad.ts BETWEEN g.s AND g.e AND g.e - g.s > cad.cadence + {60 * SECOND}) GROUP BY account)
SELECT b.account, expected, attempted, unfinished, observed, CASE WHEN expected > 0 THEN ((2 * least(attempted, expected) * 1000000 + expected) // (2 * expected))::BIGINT END AS attempt_ppm,
       CASE WHEN attempted > unfinished THEN ((2 * least(observed, attempted - unfinished) * 1000000 + (attempted - unfinished)) // (2 * (attempted - unfinished)))::BIGINT END AS measured_ppm,
       (SELECT max(e - s) FROM g WHERE g.account = b.account) AS no_attempt, (SELECT max(e - s) FROM o WHERE o.account = b.account) AS no_observation, coalesce(severe, 0) AS severe
FROM base b LEFT JOIN severe USING (account)"""


def policies(spark, sf_dir):
    return t.events(spark, sf_dir, "signup").select(F.col("user_id").alias("account"), "ts", ((300 + F.col("k") * 10) * SECOND).alias("cadence"))


def held(spark, sf_dir):
    return meter.holds(t.attempts(spark, sf_dir), 300 * SECOND, 4 * HOUR, 24 * HOUR)


@query(
    "WN-8_expected_opportunities",
    f"WITH {HOLD_SQL}, {POLICY_SQL}, {EXPECT_SQL} SELECT account, expected FROM expect",
)
def wn8(spark, sf_dir):
    return meter.expected_opportunities(policies(spark, sf_dir), held(spark, sf_dir), SINCE, UNTIL).select("account", "expected")


@query("CV-2_coverage_report", COVERAGE_SQL)
def cv2(spark, sf_dir):
    """Sampling of each account over an interval; windows reset at midnight after a reading."""
    resets = observations(spark, sf_dir).select("account", F.col("reset_at").alias("ts")).distinct()
    tries = t.attempts(spark, sf_dir).select("account", "ts", (F.col("outcome") != "interrupted").alias("finished"), (F.col("outcome") == "success").alias("observed"))
    return coverage.report(policies(spark, sf_dir), tries, held(spark, sf_dir), resets, SINCE, UNTIL)


@query("WN-13_frozen_rate", f"WITH {M_SQL} SELECT account, min(ts) AS capped_at FROM meter WHERE least(used_ppm * 100, 1000000) >= 1000000 AND ts > 1704200000000000000 GROUP BY account")
def wn13(spark, sf_dir):
    rows = t.meter(spark, sf_dir).withColumn("used_ppm", F.least(F.col("used_ppm") * 100, F.lit(1_000_000)))
    return meter.frozen_rate(rows, 1_704_200_000 * SECOND)


@query("WN-16_newest", f"WITH {M_SQL} SELECT account, observation, nth FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, observation DESC) AS nth FROM meter) WHERE nth <= 3")
def wn16(spark, sf_dir):
    return meter.newest(t.meter(spark, sf_dir), ["account"], ["ts", "observation"], 3).select("account", "observation", "nth")


@query("WN-17_trailing_failures", f"WITH {A_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, attempt DESC) AS nth FROM att) SELECT account, coalesce(min(nth) FILTER (WHERE outcome <> 'auth_required'), count(*) + 1) - 1 AS failures FROM n WHERE nth <= 64 GROUP BY account")
def wn17(spark, sf_dir):
    return meter.trailing_failures(t.attempts(spark, sf_dir))


@query("WN-19_identity_change", f"WITH {A_SQL}, o AS (SELECT *, last_value(context IGNORE NULLS) OVER (PARTITION BY account ORDER BY ts, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM att) SELECT attempt, CASE WHEN known IS NULL THEN 'established' ELSE 'changed' END AS kind FROM o WHERE context IS NOT NULL AND context IS DISTINCT FROM known")
def wn19(spark, sf_dir):
    w = Window.partitionBy("account").orderBy("ts", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.attempts(spark, sf_dir).withColumn("known", F.last("context", ignorenulls=True).over(w))
    return rows.where("context is not null and not (context <=> known)").select("attempt", F.when(F.col("known").isNull(), "established").otherwise("changed").alias("kind"))


@query("AG-9_error_classes", f"WITH {A_SQL} SELECT account, outcome, count(*) AS n FROM att WHERE outcome <> 'success' GROUP BY ALL")
def ag9(spark, sf_dir):
    return t.attempts(spark, sf_dir).where("outcome <> 'success'").groupBy("account", "outcome").agg(F.count("*").alias("n"))


@query("AG-10_failure_tally", f"WITH {A_SQL} SELECT account, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'auth_required') AS auth_required, count(*) FILTER (WHERE outcome = 'unreachable') AS unreachable, count(*) FILTER (WHERE outcome = 'rate_limited') AS rate_limited, count(*) FILTER (WHERE outcome = 'interrupted') AS interrupted FROM att GROUP BY account")
def ag10(spark, sf_dir):
    return meter.failure_tally(t.attempts(spark, sf_dir))


@query("SL-4_class_counts", f"WITH {A_SQL} SELECT outcome, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, outcome)::INTEGER AS place FROM att GROUP BY outcome")
def sl4(spark, sf_dir):
    return t.attempts(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "outcome")))


@query("SL-2_newest_row", f"WITH {A_SQL} SELECT account, max(attempt) AS attempt, arg_max(outcome, attempt) AS outcome FROM att GROUP BY account")
def sl2(spark, sf_dir):
    return t.attempts(spark, sf_dir).groupBy("account").agg(F.max("attempt").alias("attempt"), F.max_by("outcome", "attempt").alias("outcome"))


@query("JN-3_attempt_results", f"WITH {A_SQL} SELECT a.attempt, r.outcome FROM att a LEFT JOIN (SELECT attempt, outcome FROM att WHERE outcome <> 'interrupted') r USING (attempt) WHERE a.account NOT IN (SELECT user_id FROM ev WHERE event_type = 'signup' AND k = 7)")
def jn3(spark, sf_dir):
    rows = t.attempts(spark, sf_dir)
    legacy = t.events(spark, sf_dir, "signup").where("k = 7").select(F.col("user_id").alias("account"))
    results = rows.where("outcome <> 'interrupted'").select("attempt", "outcome")
    return rows.join(legacy, "account", "left_anti").select("attempt").join(results, "attempt", "left")


@query("JN-5_unresolved_attempts", f"WITH {A_SQL} SELECT account, count(*) AS unresolved FROM att WHERE outcome = 'interrupted' AND NOT EXISTS (SELECT 1 FROM att b WHERE b.account = att.account AND b.outcome = 'success' AND b.ts > att.ts AND b.ts <= att.ts + {HOUR}) GROUP BY account")
def jn5(spark, sf_dir):
    rows = t.attempts(spark, sf_dir)
    w = Window.partitionBy("account").orderBy("ts").rangeBetween(1, HOUR)
    seen = rows.withColumn("later", F.count_if(F.col("outcome") == "success").over(w))
    return seen.where("outcome = 'interrupted' and later = 0").groupBy("account").agg(F.count("*").alias("unresolved"))


NOW = 1_706_000_000 * SECOND
LATEST_SQL = f"""{A_SQL}, {t.METER_SQL},
la AS (SELECT account, arg_max({{'o': outcome, 's': ts, 'c': context}}, {{'t': ts, 'a': attempt}}) AS r FROM att GROUP BY account),
fc AS (SELECT account, arg_max({{'c': context}}, {{'t': ts, 'a': attempt}}).c AS failed FROM att WHERE outcome = 'auth_required' GROUP BY account),
ob AS (SELECT account, max(ts) AS observed FROM meter GROUP BY account)"""


def latest(spark, sf_dir):
    rows = t.attempts(spark, sf_dir)
    last = rows.groupBy("account").agg(F.max_by(F.struct(F.when(F.col("outcome") != "interrupted", F.col("outcome")).alias("outcome"), F.col("ts").alias("started"), "context"), F.struct("ts", "attempt")).alias("r")).select("account", "r.*")
    failed = rows.where("outcome = 'auth_required'").groupBy("account").agg(F.max_by("context", F.struct("ts", "attempt")).alias("failed_context"))
    seen = t.meter(spark, sf_dir).groupBy("account").agg(F.max("ts").alias("observed"))
    return last.join(failed, "account", "left").join(seen, "account", "left").withColumn("verified", F.lit(False))


@query(
    "SF-6_freshness",
    f"""WITH {LATEST_SQL}, x AS (SELECT la.account, CASE WHEN r.o <> 'interrupted' THEN r.o END AS o, r.s AS s, coalesce(failed = r.c, false) AS same, coalesce(failed <> r.c, false) AS other, observed FROM la LEFT JOIN fc USING (account) LEFT JOIN ob USING (account)),
y AS (SELECT *, CASE WHEN observed IS NULL THEN 'stale:no_successful_observation' WHEN observed > {NOW} THEN 'stale:clock_anomaly' WHEN {NOW} - observed <= {2 * DAY} THEN 'fresh' ELSE 'stale:age_exceeded' END AS seen FROM x)
SELECT account, CASE WHEN o = 'success' THEN seen WHEN o = 'auth_required' THEN 'auth_required' WHEN o = 'unreachable' AND same THEN 'auth_required' WHEN o = 'unreachable' AND other THEN 'stale:credential_changed_unverified'
     WHEN o IS NOT NULL THEN 'stale:' || o WHEN s > {NOW} THEN 'stale:clock_anomaly' WHEN {NOW} - s > {60 * SECOND} THEN 'stale:collector_interrupted' WHEN same THEN 'auth_required' WHEN other THEN 'stale:credential_changed_unverified' ELSE seen END AS freshness FROM y""",
)
def sf6(spark, sf_dir):
    return meter.freshness(latest(spark, sf_dir), NOW, 2 * DAY, 60 * SECOND).select("account", F.concat_ws(":", "state", "reason").alias("freshness"))


@query("SF-7_burn_rate", f"WITH {M_SQL}, b AS (SELECT observation, used_ppm, greatest(0, least(ts + 3600000000000 - (reset_at - {DAY}), {DAY})) AS elapsed FROM mr) SELECT observation, CASE WHEN used_ppm < 1000000 AND elapsed > 0 AND elapsed::HUGEINT * 100 >= {DAY} THEN (used_ppm::HUGEINT * {DAY} // elapsed)::BIGINT END AS rate FROM b")
def sf7(spark, sf_dir):
    # Each window of a day is looked at an hour after the reading.
    return observations(spark, sf_dir).select("observation", meter.burn_rate(F.col("used_ppm"), F.col("reset_at") - DAY, F.lit(DAY), F.col("ts") + HOUR).alias("rate"))


@query("SF-14_due_decision", f"WITH {LATEST_SQL}, x AS (SELECT la.account, r.s AS s, observed, la.account % 11 = 0 AS forced, {NOW} - (la.account % 5) * {HOUR} AS reset_at, {NOW} + (la.account % 7) * {300 * SECOND} AS nxt FROM la LEFT JOIN ob USING (account)), y AS (SELECT *, CASE WHEN forced THEN 'forced' WHEN reset_at <= {NOW} AND coalesce(s < reset_at, true) THEN 'post_reset' WHEN nxt > {NOW} AND nxt - {NOW} <= {600 * SECOND} AND coalesce({NOW} - observed > {600 * SECOND}, true) THEN 'reset_edge' WHEN s IS NULL THEN 'never_sampled' ELSE 'cadence' END AS why FROM x) SELECT account, why, CASE why WHEN 'cadence' THEN greatest(s + {300 * SECOND}, 0) ELSE {NOW} END AS due_at FROM y")
def sf14(spark, sf_dir):
    rows = latest(spark, sf_dir).select(
        "account", "started", F.col("observed").alias("evidence"), (F.col("account") % 11 == 0).alias("forced"), (F.lit(NOW) - (F.col("account") % 5) * HOUR).alias("reset_at"),
        (F.lit(NOW) + (F.col("account") % 7) * 300 * SECOND).alias("next_reset"), F.col("started").alias("last_due"), F.lit(300 * SECOND).alias("cadence"), F.lit(None).cast("bigint").alias("hold"),
    )
    return meter.due(rows, NOW, 600 * SECOND).select("account", "why", "due_at")


@query("SF-5_reading_age", f"WITH {M_SQL} SELECT observation, CASE WHEN ts <= {NOW} THEN {NOW} - ts ELSE -1 END AS age, ts > {NOW} AS anomaly FROM meter")
def sf5(spark, sf_dir):
    return t.meter(spark, sf_dir).select("observation", F.when(F.col("ts") <= NOW, F.lit(NOW) - F.col("ts")).otherwise(-1).alias("age"), (F.col("ts") > NOW).alias("anomaly"))


@query("SC-13_reset_grid", f"WITH {M_SQL} SELECT observation, ts - ((ts - 1704000000000000000) % {5 * HOUR}) + {5 * HOUR} AS next_reset FROM meter")
def sc13(spark, sf_dir):
    return t.meter(spark, sf_dir).select("observation", clock.next_grid(F.col("ts"), 1_704_000_000 * SECOND, 5 * HOUR).alias("next_reset"))


@query("SC-14_moved_windows", f"WITH {M_SQL} SELECT observation FROM (SELECT observation, used_ppm // 1000 AS u, lag(used_ppm // 1000) OVER (PARTITION BY account ORDER BY ts, observation) AS o FROM meter) WHERE u IS DISTINCT FROM o")
def sc14(spark, sf_dir):
    w = Window.partitionBy("account").orderBy("ts", "observation")
    rows = t.meter(spark, sf_dir).withColumn("u", F.expr("used_ppm div 1000"))
    return rows.withColumn("o", F.lag("u").over(w)).where("not (u <=> o)").select("observation")


@query("AG-24_limiting_window", f"WITH {M_SQL} SELECT account, arg_min({{'o': observation, 'r': 1000000 - used_ppm}}, {{'r': 1000000 - used_ppm, 't': ts}}).o AS observation, min(1000000 - used_ppm) AS remaining_ppm FROM meter GROUP BY account")
def ag24(spark, sf_dir):
    rows = t.meter(spark, sf_dir).withColumn("remaining_ppm", 1_000_000 - F.col("used_ppm"))
    return rows.groupBy("account").agg(F.min_by(F.struct("observation", "remaining_ppm"), F.struct("remaining_ppm", "ts")).alias("m")).select("account", "m.*")


@query("AG-27_most_used_window", f"WITH {M_SQL} SELECT account, arg_max(observation, {{'u': used_ppm, 't': ts}}) AS observation FROM mr WHERE used_ppm > 0 GROUP BY account")
def ag27(spark, sf_dir):
    return t.meter(spark, sf_dir).where("used_ppm > 0").groupBy("account").agg(F.max_by("observation", F.struct("used_ppm", "ts")).alias("observation"))


@query(
    "AG-25_confidence",
    f"""WITH {M_SQL}, w AS (SELECT account, observation, used_ppm, CASE WHEN observation % 3 <> 0 THEN (used_ppm // 10 % 100) * {DAY // 100} END AS rest FROM meter),
l AS (SELECT account, arg_max(rest, {{'u': used_ppm, 'o': -observation}}) AS rest FROM w WHERE rest IS NOT NULL GROUP BY 1)
SELECT account, CASE WHEN 1.0::DOUBLE - rest::DOUBLE / {DAY}::DOUBLE < 0.2::DOUBLE THEN 'early' ELSE 'established' END AS confidence FROM (SELECT DISTINCT account FROM meter) LEFT JOIN l USING (account)""",
)
def ag25_confidence(spark, sf_dir):
    """Each reading stands for a window; how much of its cycle is left comes from the reading, a third have no reset."""
    rest = F.pmod(F.call_function("div", F.col("used_ppm"), F.lit(10)), F.lit(100)) * (DAY // 100)
    rows = t.meter(spark, sf_dir).select("account", F.col("observation").alias("idx"), "used_ppm", F.when(F.col("observation") % 3 != 0, NOW + rest).alias("reset_at"), F.lit(DAY).alias("nominal"))
    return meter.confidence(rows, NOW)


@query("AG-25_selection_verdict", f"""WITH {M_SQL}, w AS (SELECT account, arg_max({{'u': least(used_ppm * 60, 1000000), 'r': CASE WHEN observation % 3 <> 0 THEN reset_at END}}, {{'t': ts, 'o': observation}}) AS x FROM mr GROUP BY account),
v AS (SELECT account, x.u AS u, x.r AS r, 100.0::DOUBLE - x.u / 10000.0::DOUBLE AS rest, x.u / 10000.0::DOUBLE / 75.0::DOUBLE AS burn FROM w WHERE x.r IS NOT NULL OR x.u > 0),
d AS (SELECT *, CASE WHEN u >= 1000000 THEN 'exhausted_now' WHEN r IS NULL THEN 'unknown' WHEN burn > 0 AND rest / 100.0::DOUBLE / burn * {DAY} < {DAY // 4} THEN 'projected_exhaustion' ELSE 'through_reset' END AS verdict FROM v)
SELECT account, verdict, CASE verdict WHEN 'exhausted_now' THEN 0 WHEN 'projected_exhaustion' THEN round(rest / 100.0::DOUBLE / burn * {DAY} / 1000000000)::BIGINT END AS runway_s, CASE WHEN verdict <> 'exhausted_now' AND r IS NOT NULL THEN round(greatest(-100.0, least(100.0, (rest - burn * 25.0::DOUBLE) / 25.0::DOUBLE)), 6) END AS gap FROM d""")
def ag25(spark, sf_dir):
    # Every window is looked at a quarter of a day before its reset.
    rows = observations(spark, sf_dir).select("account", "ts", "observation", F.least(F.col("used_ppm") * 60, F.lit(1_000_000)).alias("used_ppm"), F.when(F.col("observation") % 3 != 0, F.lit(NOW + DAY // 4)).alias("reset_at"))
    last = rows.groupBy("account").agg(F.max_by(F.struct("used_ppm", "reset_at"), F.struct("ts", "observation")).alias("x")).select("account", "x.*", F.lit(0).alias("idx"), F.lit(DAY).alias("nominal"), F.lit(1.0).alias("weight"))
    return meter.selection(last, NOW).select("account", "verdict", F.round(F.col("runway") / SECOND).cast("bigint").alias("runway_s"), F.round("gap", 6).alias("gap"))
