"""Health checks and what remains: scans, stamps, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import globs, layout
from ..operators import calibration, canrun, doctor, meter, reconcile
from ..sources import tables as t
from .ledger import FULL_SQL, ledger
from .meters import A_SQL, M_SQL, NOW
from .registry import query


@query(
    "DR-1_doctor",
    f"""WITH {A_SQL}, {t.METER_SQL}, c AS (
SELECT 'auth_failures' AS name, count(*) FILTER (WHERE outcome = 'auth_required') AS measured, 100 AS warn, 500 AS fail FROM att
UNION ALL SELECT 'failed_attempts', count(*) FILTER (WHERE outcome <> 'success'), 1000, 100000 FROM att
UNION ALL SELECT 'unresolved_attempts', count(*) FILTER (WHERE outcome = 'interrupted'), 1, NULL FROM att
UNION ALL SELECT 'sampling_age_s', (({NOW} - max(ts)) // 1000000000), 3600, 86400 FROM meter
UNION ALL SELECT 'clock_skew', count(*) FILTER (WHERE ts > {NOW}), 1, NULL FROM meter
UNION ALL SELECT 'unmapped_accounts', count(DISTINCT account) FILTER (WHERE account % 50 = 0), 1, NULL FROM meter)
SELECT name, measured::BIGINT AS measured, CASE WHEN measured IS NULL THEN 'unknown' WHEN measured >= fail THEN 'failing' WHEN measured >= warn THEN 'warning' ELSE 'ok' END AS status FROM c""",
)
def dr1(spark, sf_dir):
    att, met = t.attempts(spark, sf_dir), t.meter(spark, sf_dir)
    return doctor.doctor([
        doctor.check("auth_failures", att, F.count_if(F.col("outcome") == "auth_required"), 100, 500),
        doctor.check("failed_attempts", att, F.count_if(F.col("outcome") != "success"), 1000, 100_000),
        doctor.check("unresolved_attempts", att, F.count_if(F.col("outcome") == "interrupted"), 1),
        doctor.check("sampling_age_s", met, F.call_function("div", NOW - F.max("ts"), F.lit(1_000_000_000)), 3600, 86_400),
        doctor.check("clock_skew", met, F.count_if(F.col("ts") > NOW), 1),
        doctor.check("unmapped_accounts", met, F.count_distinct(F.when(F.col("account") % 50 == 0, F.col("account"))), 1),
    ])


@query("SC-2_glob_match", "SELECT p_partkey, p_name LIKE 'p%_1%' AS hit FROM part")
def sc2(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", globs.matches(F.col("p_name"), "p*?1*").alias("hit"))


@query("SC-17_canonical_scan", f"WITH {FULL_SQL} SELECT native_id, session, model, input + output + cache_read + cache_write AS tokens FROM ledger WHERE day >= '1997-01-01' AND day < '1998-01-01' AND model LIKE '%brand#1%' OR day >= '1997-01-01' AND day < '1998-01-01' AND model LIKE '%Brand#1%'")
def sc17(spark, sf_dir):
    rows = ledger(spark, sf_dir).where((F.col("day") >= "1997-01-01") & (F.col("day") < "1998-01-01") & F.lower("model").like("%brand#1%"))
    return rows.select("native_id", "session", "model", (F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write")).alias("tokens"))


@query("SC-9_change_classes", "WITH o AS (SELECT o_orderkey AS path, o_custkey AS identity, round(o_totalprice)::BIGINT AS size FROM orders), s AS (SELECT path, CASE WHEN path % 7 = 0 THEN identity + 1 ELSE identity END AS identity, CASE path % 5 WHEN 0 THEN size - 1 WHEN 1 THEN size + 1 ELSE size END AS size, CASE WHEN path % 11 = 0 THEN 1 ELSE 2 END AS version FROM o WHERE path % 3 <> 0) SELECT o.path, CASE WHEN s.path IS NULL THEN 'new' WHEN s.identity <> o.identity OR o.size < s.size THEN 'rebuild_required' WHEN version <> 2 THEN 'parser_version_changed' WHEN s.size = o.size THEN 'unchanged' WHEN o.size > s.size THEN 'appended' ELSE 'rebuild_required' END AS change FROM o LEFT JOIN s ON s.path = o.path")
def sc9(spark, sf_dir):
    from ..streaming.ingest import changes

    now = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("identity"), F.round("o_totalprice").cast("bigint").alias("size"), F.lit(1).alias("mtime"))
    p = F.col("path")
    stored = now.where(p % 3 != 0).select("path", F.when(p % 7 == 0, F.col("identity") + 1).otherwise(F.col("identity")).alias("identity"), F.when(p % 5 == 0, F.col("size") - 1).when(p % 5 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime", F.when(p % 11 == 0, 1).otherwise(2).alias("parser_version"))
    return changes(stored, now, 2).select("path", "change")


@query("AG-22_field_paths", "SELECT 'props.' || k AS path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def ag22(spark, sf_dir):
    keys = t.table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("k"))
    return keys.groupBy(F.concat(F.lit("props."), F.col("k")).alias("path")).agg(F.count("*").alias("n"))


@query("JN-4_three_way", f"WITH {M_SQL} SELECT m.observation, a.outcome, e.k FROM meter m JOIN (SELECT event_id AS observation, k FROM ev) e USING (observation) JOIN (SELECT event_id AS observation, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS outcome FROM ev) a USING (observation)")
def jn4(spark, sf_dir):
    ev = t.events(spark, sf_dir)
    windows = ev.select(F.col("event_id").alias("observation"), "k")
    evidence = ev.select(F.col("event_id").alias("observation"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("outcome"))
    return t.meter(spark, sf_dir).join(windows, "observation").join(evidence, "observation").select("observation", "outcome", "k")


@query("JN-16_identity_pairing", f"WITH {M_SQL}, w AS (SELECT account, observation AS ord, ts // 86400000000000 AS day, max(used_ppm) AS used FROM meter GROUP BY ALL), o AS (SELECT account, day, max(used) AS used, dense_rank() OVER (PARTITION BY account ORDER BY day) AS n FROM w GROUP BY account, day) SELECT coalesce(a.account, b.account) AS account, coalesce(b.n, a.n + 1) AS n, CASE WHEN a.n IS NULL THEN 'appeared' WHEN b.n IS NULL THEN 'disappeared' WHEN b.used < a.used THEN 'fell' ELSE 'rose' END AS change FROM o a FULL JOIN o b ON a.account = b.account AND b.n = a.n + 1")
def jn16(spark, sf_dir):
    w = Window.partitionBy("account").orderBy("day")
    o = t.meter(spark, sf_dir).withColumn("day", F.expr("ts div 86400000000000")).groupBy("account", "day").agg(F.max("used_ppm").alias("used")).withColumn("n", F.dense_rank().over(w).cast("bigint"))
    a, b = o.select("account", (F.col("n") + 1).alias("n"), F.col("used").alias("old")), o.select("account", "n", "used")
    change = F.when(F.col("old").isNull(), "appeared").when(F.col("used").isNull(), "disappeared").when(F.col("used") < F.col("old"), "fell").otherwise("rose")
    return a.join(b, ["account", "n"], "full").select("account", "n", change.alias("change"))


@query("JN-20_open_findings", f"WITH {A_SQL} SELECT attempt FROM att a WHERE outcome = 'unreachable' AND NOT EXISTS (SELECT 1 FROM att b WHERE b.account = a.account AND b.context = a.context AND b.outcome = 'success' AND b.ts > a.ts) AND context IS NOT NULL")
def jn20(spark, sf_dir):
    rows = t.attempts(spark, sf_dir).where("context is not null")
    fixed = rows.where("outcome = 'success'").groupBy("account", "context").agg(F.max("ts").alias("fixed"))
    return rows.where("outcome = 'unreachable'").join(fixed, ["account", "context"], "left").where("fixed is null or fixed <= ts").select("attempt")


@query("JN-21_activation_chain", f"WITH {A_SQL}, c AS (SELECT account, attempt, context, lag(attempt) OVER (PARTITION BY account ORDER BY ts, attempt) AS predecessor, lead(attempt) OVER (PARTITION BY account ORDER BY ts, attempt) IS NOT NULL AS superseded FROM att WHERE outcome = 'success') SELECT attempt, coalesce(predecessor, -1) AS predecessor, superseded FROM c")
def jn21(spark, sf_dir):
    w = Window.partitionBy("account").orderBy("ts", "attempt")
    rows = t.attempts(spark, sf_dir).where("outcome = 'success'")
    return rows.select("attempt", F.coalesce(F.lag("attempt").over(w), F.lit(-1)).alias("predecessor"), F.lead("attempt").over(w).isNotNull().alias("superseded"))


@query("SK-11_retention_prune", "SELECT event_type, count(*) AS kept FROM events WHERE event_type NOT IN ('view', 'click') OR ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def sk11(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events")
    return rows.where(~F.col("event_type").isin("view", "click") | (F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("SK-12_generation", "SELECT (event_id // 1000) AS generation, count(*) AS events, max(event_id) AS last FROM events GROUP BY 1")
def sk12(spark, sf_dir):
    return t.table(spark, sf_dir, "events").groupBy(F.expr("event_id div 1000").alias("generation")).agg(F.count("*").alias("events"), F.max("event_id").alias("last"))


@query("SK-13_subagent_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey)::INTEGER AS place FROM orders")
def sk13(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderstatus") != "F", "o_orderkey")
    return t.table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("PF-4_constraining_windows", f"WITH {M_SQL} SELECT observation FROM meter WHERE observation % 3 = 0 OR (observation % 3 = 1 AND account % 4 = 2)")
def pf4(spark, sf_dir):
    rows = t.meter(spark, sf_dir)
    scope = F.when(F.col("observation") % 3 == 0, "account").when(F.col("observation") % 3 == 1, "model").otherwise("group")
    named = F.when(scope == "model", F.concat(F.lit("m"), (F.col("account") % 4).cast("string")))
    return rows.where(canrun.constrains(scope, named, F.lit("m2"))).select("observation")


@query(
    "PF-8_project_resolution",
    """WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CASE c_custkey % 5 WHEN 0 THEN '/r/repo-' || c_nationkey || '//src/' WHEN 1 THEN '/r/.worktrees/repo-' || c_nationkey || '/task' WHEN 2 THEN '/r/.hidden/x' WHEN 3 THEN '/elsewhere/' || c_nationkey ELSE '/r/scratch' END END AS dir FROM customer),
r AS (SELECT *, CASE WHEN dir = '/elsewhere/3' THEN 'aliased' WHEN dir LIKE '/r/repo-%' OR dir LIKE '/r/.worktrees/repo-%' THEN regexp_extract(dir, '(repo-[0-9]+)', 1) ELSE 'unknown-repository' END AS repository FROM d)
SELECT c_custkey, coalesce(repository, 'unknown-repository') AS repository, CASE WHEN dir = '/elsewhere/4' THEN 'first' WHEN dir IS NULL OR repository = 'unknown-repository' THEN 'unknown-project' ELSE repository END AS project FROM r""",
)
def pf8(spark, sf_dir):
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    at = [F.concat(F.lit("/r/repo-"), nation, F.lit("//src/")), F.concat(F.lit("/r/.worktrees/repo-"), nation, F.lit("/task")), F.lit("/r/.hidden/x"), F.concat(F.lit("/elsewhere/"), nation), F.lit("/r/scratch")]
    path = F.when(k % 17 != 0, F.element_at(F.array(*at), (k % 5 + 1).cast("int")))
    rules = {"aliases": {"/elsewhere/3": "aliased"}, "worktrees": "/r/.worktrees", "repositories": "/r", "ignore": ["scratch"]}
    return t.table(spark, sf_dir, "customer").select("c_custkey", layout.repository(path, **rules).alias("repository"), layout.project(path, {"/elsewhere/4": "first"}, **rules).alias("project"))


@query("SL-3_bounded_sample", f"WITH {M_SQL} SELECT account, observation FROM (SELECT account, observation, row_number() OVER (PARTITION BY account ORDER BY used_ppm DESC, observation) AS nth FROM meter) WHERE nth <= 5")
def sl3(spark, sf_dir):
    w = Window.partitionBy("account").orderBy(F.col("used_ppm").desc(), "observation")
    return t.meter(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("account", "observation")


HOUR = 3_600_000_000_000
#: Readings lie days apart in the sample tables, so plateaus may be wide there.
PLATEAU = {"units": 12, "within": 480 * HOUR}
#: The longest time between two events of an account that counts as sampled.
HOLE = 120 * HOUR
PASSIVE_SQL = f"""{M_SQL},
o AS (SELECT *, CASE WHEN observation % 6 = 0 THEN ts - {HOUR} END AS resets_at, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts) AS gap FROM meter),
f AS (SELECT *, count(*) OVER w AS n, ts - min(ts) OVER w AS span, max(used_ppm) OVER w - min(used_ppm) OVER w AS spread, min(gap) OVER (PARTITION BY account ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS least FROM o WINDOW w AS (PARTITION BY account ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, n = 3 AND least >= 300000000000 AND span >= 600000000000 AND span <= {480 * HOUR} AND spread // 2500 <= 12 AS ok FROM f),
h AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY account) >= 2 AS settled FROM g),
e AS (SELECT account, settled, observation AS first, ts AS a, used_ppm AS u, lead(observation) OVER w AS last, lead(ts) OVER w AS b, lead(used_ppm) OVER w AS v FROM h WHERE ok OR NOT settled WINDOW w AS (PARTITION BY account ORDER BY ts, observation)),
i AS (SELECT * FROM e WHERE b IS NOT NULL),
rs AS (SELECT i.account, i.first, bool_or(o.resets_at > a AND o.resets_at < b) AS named FROM i JOIN o ON o.account = i.account AND o.ts BETWEEN a AND b GROUP BY ALL),
us AS (SELECT i.account, i.first, sum(amount) AS credits, count(*) FILTER (WHERE k % 17 = 0) AS est, count(*) FILTER (WHERE k % 19 = 0) AS unk FROM i JOIN ev ON user_id = account AND event_type = 'click' AND ts BETWEEN a AND b GROUP BY ALL),
mk AS (SELECT i.account, i.first, count(*) AS inferred FROM i JOIN ev ON user_id = account AND event_type = 'signup' AND k % 5 >= 3 AND ts BETWEEN a AND b GROUP BY ALL),
ss AS (SELECT i.account, i.first, count(*) AS running FROM i JOIN ev ON user_id = account AND event_type = 'purchase' AND ts <= b AND (k % 23 = 0 OR ts + {12 * HOUR} >= a) GROUP BY ALL),
tr AS (SELECT i.account, i.first, count(*) AS tiers FROM i JOIN ev ON user_id = account AND event_type = 'purchase' AND k % 29 = 0 AND ts > a AND ts <= b GROUP BY ALL),
gp AS (SELECT i.account, i.first, count(*) AS holes FROM i JOIN (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prior FROM ev) d ON user_id = account AND ts - prior > {HOLE} AND prior < b AND ts > a GROUP BY ALL),
an AS (SELECT i.account, i.first, count(*) FILTER (WHERE k % 4 = 0 AND ts < b AND ts + {6 * HOUR} > a) AS anomalies, count(*) FILTER (WHERE k % 11 = 0 AND ts BETWEEN a AND b) AS mismatches FROM i JOIN ev ON user_id = account AND event_type = 'error' GROUP BY ALL),
x AS (SELECT i.*, coalesce(credits, 0)::BIGINT AS credits, coalesce(named, false) OR v < u - 2500 AS reset_inside,
        concat_ws(',', CASE WHEN inferred > 0 THEN 'high_confidence_account_attribution' END, CASE WHEN named OR v < u - 2500 THEN 'no_reset_inside' END, CASE WHEN tiers > 0 THEN 'unchanged_plan_tier' END, CASE WHEN est > 0 THEN 'exact_contributing_usage' END,
          CASE WHEN unk > 0 THEN 'no_unknown_token_components' END, CASE WHEN holes > 0 THEN 'sufficient_meter_coverage' END, CASE WHEN running > 1 THEN 'no_second_local_session_or_consumer' END, CASE WHEN i.account % 5 = 0 THEN 'exclusivity_policy_permits_passive' END,
          CASE WHEN NOT settled THEN 'server_side_settlement_satisfied' END, CASE WHEN anomalies > 0 THEN 'meter_window_anomaly' END, CASE WHEN mismatches > 0 THEN 'external_validation_mismatch' END) AS reasons
      FROM i LEFT JOIN rs USING (account, first) LEFT JOIN us USING (account, first) LEFT JOIN mk USING (account, first) LEFT JOIN ss USING (account, first) LEFT JOIN an USING (account, first) LEFT JOIN tr USING (account, first) LEFT JOIN gp USING (account, first))"""


def passive(spark, sf_dir):
    k, ts, by = F.col("k"), F.col("ts"), F.col("user_id").alias("account")
    of = lambda kind: t.events(spark, sf_dir, kind)
    readings = t.meter(spark, sf_dir).withColumns({"resolution": F.lit(2500), "resets_at": F.when(F.col("observation") % 6 == 0, ts - HOUR)})
    usage = of("click").select(by, "ts", F.col("amount").alias("credits"), (k % 17 == 0).alias("estimated"), (k % 19 == 0).alias("unknown"))
    sessions = of("purchase").select(by, ts.alias("a"), F.when(k % 23 != 0, ts + 12 * HOUR).alias("b"))
    markers = of("signup").select(by, "ts", (1 + k % 5).alias("rank"))
    anomalies = of("error").where(k % 4 == 0).select(by, ts.alias("a"), (ts + 6 * HOUR).alias("b"))
    mismatches = of("error").where(k % 11 == 0).select(by, "ts")
    permits = readings.select("account").distinct().withColumn("permitted", F.col("account") % 5 != 0)
    tiers = of("purchase").where(k % 29 == 0).select(by, "ts")
    seen = t.events(spark, sf_dir).select(by, F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")).alias("a"), ts.alias("b"))
    intervals = calibration.passive_intervals(readings, ["account"], **PLATEAU)
    return calibration.passive_reasons(calibration.passive_evidence(intervals, ["account"], usage, sessions, markers, anomalies, mismatches, permits, tiers, seen.where(F.col("b") - F.col("a") > HOLE)))


@query("ML-8_passive_candidates", f"WITH {PASSIVE_SQL} SELECT account, first, last, settled, reset_inside, credits, reasons FROM x")
def ml8(spark, sf_dir):
    return passive(spark, sf_dir).select("account", F.col("start.observation").alias("first"), F.col("end.observation").alias("last"), "settled", "reset_inside", "credits", F.array_join("reasons", ",").alias("reasons"))


@query(
    "ML-8_passive_fit",
    f"""WITH {PASSIVE_SQL}, q AS (SELECT *, sum(credits) OVER w AS x, row_number() OVER w AS nth FROM x WHERE reasons = '' WINDOW w AS (PARTITION BY account ORDER BY a, first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT account, x::DOUBLE AS x, v::DOUBLE AS y FROM q UNION ALL SELECT account, 0.0, u::DOUBLE FROM q WHERE nth = 1), n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY x, y) AS i FROM p),
s AS (SELECT a.account, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM n a JOIN n b ON a.account = b.account AND a.i < b.i AND abs(b.x - a.x) > 1e-6 GROUP BY 1)
SELECT n.account, round(slope, 6) AS slope, round(quantile_cont(y - slope * x, 0.5), 3) AS intercept, count(*) AS n, CASE WHEN slope IS NULL THEN 'underidentified' WHEN slope <= 0 THEN 'non_positive_slope' END AS rejection FROM n LEFT JOIN s USING (account) GROUP BY n.account, slope""",
)
def ml8_fit(spark, sf_dir):
    points = calibration.passive_points(passive(spark, sf_dir), ["account"])
    return calibration.theil_sen(points, ["account"]).select("account", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n", "rejection")


@query("CV-1_sampling_coverage", f"WITH {A_SQL}, a AS (SELECT account, count(*) FILTER (WHERE outcome = 'success') AS good, count(*) FILTER (WHERE outcome <> 'interrupted') AS n FROM att GROUP BY account) SELECT account, good, n, CASE WHEN n <> 0 THEN ((2 * good * 1000000 + n) // (2 * n))::BIGINT END AS coverage_ppm FROM a")
def cv1(spark, sf_dir):
    from ..functions.exact import share_ppm

    rows = meter.failure_tally(t.attempts(spark, sf_dir)).select("account", F.col("success").alias("good"), (F.col("attempts") - F.col("interrupted")).alias("n"))
    return rows.withColumn("coverage_ppm", share_ppm(F.col("good"), F.col("n")))


@query(
    "AG-26_figure_digest",
    f"WITH {M_SQL}, i AS (SELECT DISTINCT account, observation::VARCHAR AS id FROM meter), s AS (SELECT account, left(sha256(id), 4) AS shard, count(*) AS n, sha256(string_agg(id, chr(0) ORDER BY id)) AS digest FROM i GROUP BY 1, 2), c AS (SELECT account, count(DISTINCT observation % 3) AS sources FROM meter GROUP BY 1) SELECT account, sum(n)::BIGINT AS members, any_value(sources) AS sources, sha256(string_agg(digest, chr(0) ORDER BY shard)) AS digest FROM s JOIN c USING (account) GROUP BY account",
)
def ag26_meter(spark, sf_dir):
    rows = t.meter(spark, sf_dir).withColumn("id", F.col("observation").cast("string")).withColumn("source", F.col("observation") % 3)
    return reconcile.provenance(rows, ["account"], "id", "source")
