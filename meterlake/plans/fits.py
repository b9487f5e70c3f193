"""Queries over calibration, advice, reconciliation and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND
from ..operators import advice, calibration, reconcile
from ..sources import tables as t
from .meters import M_SQL
from .registry import query

RES = 2500
S_SQL = f"{M_SQL}, ser AS (SELECT account, ts, observation, used_ppm, {RES} AS resolution FROM meter)"


def series(spark, sf_dir):
    return t.meter(spark, sf_dir).withColumn("resolution", F.lit(RES))


@query(
    "WN-9_settled_plateau",
    f"""WITH {S_SQL}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts) AS gap FROM ser),
f AS (SELECT *, count(*) OVER w AS n, min(ts) OVER w AS t0, max(used_ppm) OVER w - min(used_ppm) OVER w AS spread, min(gap) OVER (PARTITION BY account ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS least FROM g WINDOW w AS (PARTITION BY account ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT account, min(ts) AS settled_at FROM f WHERE n = 3 AND least >= {300 * SECOND} AND ts - t0 >= {600 * SECOND} AND spread // resolution <= 2 GROUP BY account""",
)
def wn9(spark, sf_dir):
    return calibration.settled(series(spark, sf_dir), ["account"], units=2)


@query(
    "WN-9_settlement",
    f"""WITH {S_SQL}, r AS (SELECT *, ts - lag(ts) OVER (PARTITION BY account ORDER BY ts) AS gap FROM ser),
b AS (SELECT account, min(ts) AS started, min(ts) + {240 * 3600 * SECOND} AS deadline, max(ts) AS until, max(gap) < {168 * 3600 * SECOND} AS covered FROM r GROUP BY 1),
t AS (SELECT r.*, deadline, row_number() OVER (PARTITION BY account ORDER BY ts) AS i FROM r JOIN b USING (account) WHERE ts <= deadline),
p AS (SELECT c.account, c.ts, c.used_ppm FROM t a JOIN t b ON a.account = b.account AND b.i = a.i + 1 JOIN t c ON c.account = a.account AND c.i = a.i + 2 WHERE b.ts - a.ts >= {300 * SECOND} AND c.ts - b.ts >= {300 * SECOND} AND c.ts - a.ts >= {600 * SECOND} AND (greatest(a.used_ppm, b.used_ppm, c.used_ppm) - least(a.used_ppm, b.used_ppm, c.used_ppm)) // 2500 <= 4),
f AS (SELECT account, min(ts) AS settled_at, arg_min(used_ppm, ts) AS used_ppm FROM p GROUP BY 1)
SELECT account, covered IS TRUE AND f.account IS NOT NULL AS settled, CASE WHEN covered THEN settled_at END AS settled_at, CASE WHEN covered THEN used_ppm END AS used_ppm,
       CASE WHEN covered IS NOT TRUE THEN 'insufficient_meter_coverage' WHEN f.account IS NULL THEN 'no_plateau_within_window' END AS reason, deadline, until AS observed_until FROM b LEFT JOIN f USING (account)""",
)
def wn9_outcomes(spark, sf_dir):
    """Readings lie hours apart in the sample tables: ten days to settle, and a series is covered if no two of its readings lie a week apart."""
    rows = series(spark, sf_dir)
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("account").orderBy("ts"))
    begun = rows.withColumn("gap", gap).groupBy("account").agg(F.min("ts").alias("started_at"), (F.max("gap") < 168 * 3600 * SECOND).alias("covered"), F.lit(RES).alias("resolution"))
    return calibration.settlement(rows, begun, ["account"], units=4, within=240 * 3600 * SECOND)


@query(
    "SF-19_reconciliation",
    f"""WITH {S_SQL}, p AS (SELECT account, ts AS b, used_ppm AS ub, lag(ts) OVER w AS a, lag(used_ppm) OVER w AS ua FROM ser WINDOW w AS (PARTITION BY account ORDER BY ts)),
i AS (SELECT *, (a // {96 * 3600 * SECOND} + 1) * {96 * 3600 * SECOND} AS ra, (b // {96 * 3600 * SECOND} + 1) * {96 * 3600 * SECOND} AS rb FROM p WHERE a IS NOT NULL),
c AS (SELECT i.*,
  EXISTS (SELECT 1 FROM ev WHERE user_id = account AND event_type = 'error' AND k >= 90 AND ts > a AND ts <= b) AS reset,
  EXISTS (SELECT 1 FROM ev WHERE user_id = account AND event_type = 'signup' AND ts < b AND ts + {3600 * SECOND} > a) AS gap,
  EXISTS (SELECT 1 FROM ev WHERE user_id = account AND event_type = 'click' AND k % 10 = 0 AND ts > a AND ts <= b) AS inexact FROM i)
SELECT account, a AS start_ts, b AS end_ts, concat_ws(',',
  CASE WHEN reset OR NOT (ra > b AND ra = rb) OR ub < ua THEN 'no_reset_inside' END,
  CASE WHEN b - a > {48 * 3600 * SECOND} OR gap THEN 'acceptable_meter_coverage' END,
  CASE WHEN account % 4 = 0 OR account % 4 = 1 THEN 'applicable_current_calibration' END,
  CASE WHEN b - a < {600 * SECOND} THEN 'sufficient_settlement_and_lag_handling' END,
  CASE WHEN inexact THEN 'exact_local_usage_where_required' END) AS failing FROM c""",
)
def sf19_reconciliation(spark, sf_dir):
    """Intervals between neighbouring readings; every window resets on a grid of four days, a quarter of the accounts has a stale calibration and a quarter none."""
    four = 96 * 3600 * SECOND
    end = F.struct("ts", "used_ppm", "account", F.lit("w").alias("window"), ((F.expr(f"ts div {four}") + 1) * four).alias("resets_at"))
    rows = series(spark, sf_dir).select("account", F.lit("w").alias("window"), end.alias("end"))
    pairs = rows.withColumn("start", F.lag("end").over(Window.partitionBy("account", "window").orderBy("end.ts"))).where("start is not null")
    long = F.col("end.ts") - F.col("start.ts")
    pairs = pairs.withColumns({"acceptable": long <= 48 * 3600 * SECOND, "settled": long >= 600 * SECOND, "lag_handled": F.lit(True)})
    ev = t.events(spark, sf_dir).withColumns({"account": F.col("user_id"), "window": F.lit("w")})
    key = ["account", "window"]
    usage = ev.where("event_type = 'click'").select(*key, "ts", (F.col("k") % 10 == 0).alias("inexact"))
    gaps = ev.where("event_type = 'signup'").select(*key, F.col("ts").alias("a"), (F.col("ts") + 3600 * SECOND).alias("b"))
    health = rows.where("account % 4 > 0").select(*key, F.when(F.col("account") % 4 == 1, "stale").otherwise("current").alias("health")).distinct()
    judged = reconcile.eligibility(pairs, key, usage, ev.where("event_type = 'error' and k >= 90").select(*key, "ts"), gaps, health)
    return judged.select("account", F.col("start.ts").alias("start_ts"), F.col("end.ts").alias("end_ts"), F.array_join("failing", ",").alias("failing"))


@query(
    "WN-10_reset_partition",
    f"""WITH {S_SQL}, q AS (SELECT *, ts // 3600000000000 AS hour FROM ser),
d AS (SELECT *, coalesce(lag(hour) OVER (PARTITION BY account ORDER BY hour, observation) = hour, false) AS again FROM q),
x AS (SELECT *, NOT again AND coalesce(lag(used_ppm) OVER (PARTITION BY account, again ORDER BY hour, observation) - used_ppm > resolution, false) AS fell FROM d),
y AS (SELECT *, max(fell::INT) OVER (PARTITION BY account ORDER BY hour, observation ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS past FROM x)
SELECT observation, CASE WHEN past THEN 'after_reset' WHEN again THEN 'duplicate' ELSE 'accepted' END AS fate FROM y""",
)
def wn10(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("ts", F.expr("ts div 3600000000000"))
    return calibration.reset_partition(rows, ["account"]).select("observation", "fate")


RUN_SQL = f"""{S_SQL}, use AS (SELECT user_id AS account, ts, amount AS credits FROM ev WHERE event_type = 'click'),
run AS (SELECT observation, account, ts, used_ppm, sum(c) OVER (PARTITION BY account ORDER BY ts, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS credits, side FROM (SELECT observation, account, ts, used_ppm, 0 AS c, 1 AS side FROM ser UNION ALL SELECT NULL, account, ts, NULL, credits, 0 FROM use)),
cr AS (SELECT * FROM run WHERE side = 1)"""


def with_credits(spark, sf_dir):
    usage = t.events(spark, sf_dir, "click").select(F.col("user_id").alias("account"), "ts", F.col("amount").alias("credits"))
    return calibration.running_credits(series(spark, sf_dir), usage, ["account"])


@query("WN-12_running_credits", f"WITH {RUN_SQL} SELECT observation, credits FROM cr")
def wn12(spark, sf_dir):
    return with_credits(spark, sf_dir).select("observation", "credits")


@query("JN-15_usage_in_interval", f"WITH {RUN_SQL} SELECT observation, credits - coalesce(lag(credits) OVER (PARTITION BY account ORDER BY ts), 0) AS credits FROM cr")
def jn15(spark, sf_dir):
    w = Window.partitionBy("account").orderBy("ts")
    return with_credits(spark, sf_dir).select("observation", (F.col("credits") - F.coalesce(F.lag("credits").over(w), F.lit(0))).alias("credits"))


BLOCK_SQL = f"""{RUN_SQL}, m AS (SELECT *, credits - coalesce(lag(credits) OVER w, 0) AS spent, lag(used_ppm) OVER w AS before, last_value(used_ppm) OVER (PARTITION BY account ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM cr WINDOW w AS (PARTITION BY account ORDER BY ts)),
blk AS (SELECT account, ts AS start, spent AS credits, coalesce(lead(before) OVER (PARTITION BY account ORDER BY ts), final) - before AS delta FROM m WHERE spent > 0 AND before IS NOT NULL)"""


def blocks(spark, sf_dir):
    return calibration.blocks(with_credits(spark, sf_dir), ["account"])


@query("WN-11_settled_blocks", f"WITH {BLOCK_SQL} SELECT account, start, credits, delta FROM blk")
def wn11(spark, sf_dir):
    return blocks(spark, sf_dir)


REJECTION_SQL = "CASE WHEN slope IS NULL THEN 'underidentified' WHEN slope <= 0 THEN 'non_positive_slope' END AS rejection"


@query(
    "ML-1_theil_sen",
    f"""WITH {BLOCK_SQL}, p AS (SELECT account, credits::DOUBLE AS x, delta::DOUBLE AS y, row_number() OVER (PARTITION BY account ORDER BY credits, delta) AS i FROM blk),
s AS (SELECT a.account, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.account = b.account AND a.i < b.i AND abs(b.x - a.x) > 1e-6 GROUP BY 1)
SELECT p.account, round(slope, 6) AS slope, round(quantile_cont(y - slope * x, 0.5), 3) AS intercept, count(*) AS n, {REJECTION_SQL} FROM p LEFT JOIN s USING (account) GROUP BY p.account, slope""",
)
def ml1(spark, sf_dir):
    points = blocks(spark, sf_dir).select("account", F.col("credits").cast("double").alias("x"), F.col("delta").cast("double").alias("y"))
    return calibration.theil_sen(points, ["account"]).select("account", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), "n", "rejection")


@query(
    "ML-3_slope_spread",
    f"""WITH {BLOCK_SQL}, p AS (SELECT account, credits::DOUBLE AS x, delta::DOUBLE AS y, row_number() OVER (PARTITION BY account ORDER BY credits, delta) AS i FROM blk),
s AS (SELECT a.account, list_sort(list((b.y - a.y) / (b.x - a.x))) AS s FROM p a JOIN p b ON a.account = b.account AND a.i < b.i AND abs(b.x - a.x) > 1e-6 GROUP BY 1)
SELECT account, round(s[((len(s) - 1) * 16 // 100) + 1], 6) AS lo, round(s[least(((len(s) - 1) * 84 + 99) // 100, len(s) - 1) + 1], 6) AS hi FROM s""",
)
def ml3(spark, sf_dir):
    points = blocks(spark, sf_dir).select("account", F.col("credits").cast("double").alias("x"), F.col("delta").cast("double").alias("y"))
    return calibration.slope_spread(points, ["account"]).select("account", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(
    "ML-6_scalar_fit",
    f"""WITH {RUN_SQL}, p AS (SELECT account, (credits - min(credits) OVER (PARTITION BY account)) / 1e6 AS x, used_ppm::DOUBLE AS y, row_number() OVER (PARTITION BY account ORDER BY credits, used_ppm) AS i FROM cr),
s AS (SELECT a.account, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.account = b.account AND a.i < b.i AND abs(b.x - a.x) > 1e-6 GROUP BY 1),
l AS (SELECT p.account, slope, quantile_cont(y - slope * x, 0.5) AS intercept FROM p LEFT JOIN s USING (account) GROUP BY p.account, slope)
SELECT account, round(slope, 3) AS slope, round(avg(abs(intercept + slope * x - y)), 3) AS residual, {REJECTION_SQL} FROM p JOIN l USING (account) GROUP BY account, slope""",
)
def ml6(spark, sf_dir):
    least = F.min("credits").over(Window.partitionBy("account"))
    points = with_credits(spark, sf_dir).select("account", ((F.col("credits") - least) / 1e6).alias("x"), F.col("used_ppm").cast("double").alias("y"))
    return calibration.scalar_fit(points, ["account"]).select("account", F.round("slope", 3).alias("slope"), F.round("residual", 3).alias("residual"), "rejection")


@query(
    "ML-2_huber",
    f"""WITH RECURSIVE {BLOCK_SQL}, p AS MATERIALIZED (SELECT account, credits::DOUBLE AS x, (delta - {RES // 2})::DOUBLE AS lo, (delta + {RES // 2})::DOUBLE AS hi, row_number() OVER (PARTITION BY account ORDER BY credits, delta) AS i FROM blk),
s AS (SELECT a.account, quantile_cont((b.lo + b.hi - a.lo - a.hi) / 2 / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.account = b.account AND a.i < b.i AND abs(b.x - a.x) > 1e-6 GROUP BY 1),
l AS MATERIALIZED (SELECT account, slope, quantile_cont((lo + hi) / 2 - slope * x, 0.5) AS intercept, {REJECTION_SQL} FROM p LEFT JOIN s USING (account) GROUP BY account, slope),
r AS MATERIALIZED (SELECT account, least(greatest({RES}::DOUBLE / 2, 100), 5000) AS delta, least(greatest(1 / (1 + avg(x * x)), 1e-5), 0.5) / count(*) AS rate, list({{'x': x, 'lo': lo, 'hi': hi}} ORDER BY i) AS ps FROM p GROUP BY account),
g AS (
  SELECT account, slope, intercept, 0 AS step, false AS still FROM l WHERE rejection IS NULL
  UNION ALL
  SELECT account, slope - tilt, intercept - up, step + 1, abs(up) < 1e-6 AND abs(tilt) < 1e-7 FROM (
    SELECT *, rate * list_sum(list_transform(pulls, lambda q: q.v)) AS up, rate * list_sum(list_transform(pulls, lambda q: q.v * q.x)) AS tilt FROM (
      SELECT g.*, rate, list_transform(ps, lambda q: {{'x': q.x, 'v': least(greatest(intercept + slope * q.x - least(greatest(intercept + slope * q.x, q.lo), q.hi), -delta), delta)}}) AS pulls FROM g JOIN r USING (account) WHERE step < 100 AND NOT still))),
e AS (SELECT account, max(step) AS steps, arg_max(slope, step) AS slope, arg_max(intercept, step) AS intercept FROM g GROUP BY account),
o AS (SELECT account, unnest(list_transform(ps, lambda q: abs(intercept + slope * q.x - least(greatest(intercept + slope * q.x, q.lo), q.hi)))) AS off, delta FROM e JOIN r USING (account))
SELECT account, round(l.slope, 3) AS slope, NULL::DOUBLE AS intercept, NULL::DOUBLE AS loss, NULL::INTEGER AS steps, rejection FROM l WHERE rejection IS NOT NULL
UNION ALL SELECT account, round(any_value(slope), 3), round(any_value(intercept), 1), round(sum(CASE WHEN off <= delta THEN off * off / 2 ELSE delta * (off - delta / 2) END), -5), any_value(steps)::INTEGER, NULL FROM o JOIN e USING (account) GROUP BY account""",
)
def ml2(spark, sf_dir):
    half = RES // 2
    points = blocks(spark, sf_dir).select("account", F.col("credits").cast("double").alias("x"), (F.col("delta") - half).cast("double").alias("lo"), (F.col("delta") + half).cast("double").alias("hi"), F.lit(float(RES)).alias("resolution"))
    return calibration.huber(points, ["account"]).select("account", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("loss", -5).alias("loss"), "steps", "rejection")


def arms(spark, sf_dir):
    """Regression rows: extended price on quantity, discount and tax, all in whole numbers, for each supplier."""
    return t.table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("q"), F.round(F.col("l_discount") * 100).alias("d"), F.round(F.col("l_tax") * 100).alias("x"), F.round("l_extendedprice").alias("y"))


@query("ML-4_gram_sums", "SELECT l_suppkey, count(*) AS n, sum(round(l_extendedprice) * l_quantity)::BIGINT AS xy_0, sum(l_quantity * l_quantity)::BIGINT AS xx_0_0, sum(l_quantity * round(l_discount * 100))::BIGINT AS xx_0_1, sum(round(l_tax * 100) * round(l_tax * 100))::BIGINT AS xx_2_2 FROM lineitem GROUP BY 1")
def ml4_gram(spark, sf_dir):
    g = calibration.gram(arms(spark, sf_dir), ["l_suppkey"], ["q", "d", "x"], "y")
    return g.select("l_suppkey", "n", *[F.col(c).cast("bigint").alias(c) for c in ("xy_0", "xx_0_0", "xx_0_1", "xx_2_2")])


@query("ML-4_least_squares")
def ml4(spark, sf_dir):
    return calibration.least_squares(arms(spark, sf_dir), ["l_suppkey"], ["q", "d", "x"], "y")


@query("ML-4_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def ml4_corr(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("ML-5_held_out_residual", f"WITH {BLOCK_SQL} SELECT account, count(*) AS n, round(avg(CASE WHEN 40 * credits < delta - 1250 THEN delta - 1250 - 40 * credits WHEN 40 * credits > delta + 1250 THEN 40 * credits - delta - 1250 ELSE 0 END), 3) AS residual FROM blk GROUP BY account")
def ml5(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("account", (40 * F.col("credits")).alias("predicted"), (F.col("delta") - 1250).alias("lo"), (F.col("delta") + 1250).alias("hi"))
    return calibration.held_out_residual(rows, ["account"]).select("account", "n", F.round("residual", 3).alias("residual"))


@query(
    "SF-15_admissible_interval",
    f"WITH {S_SQL}, k AS (SELECT observation, used_ppm AS u, CASE observation % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'floor' WHEN 2 THEN 'nearest' ELSE 'unknown' END AS kind FROM ser) SELECT observation, greatest(CASE kind WHEN 'exact' THEN u WHEN 'floor' THEN u WHEN 'nearest' THEN u - 1250 ELSE u - {RES} END, 0) AS lo, least(CASE kind WHEN 'exact' THEN u WHEN 'nearest' THEN u + {RES} - 1250 ELSE u + {RES} END, 1000000) AS hi FROM k",
)
def sf15(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("exact", "floor", "nearest", "unknown")]), (F.col("observation") % 4 + 1).cast("int"))
    return series(spark, sf_dir).withColumn("a", calibration.admissible(F.col("used_ppm"), F.col("resolution"), kind)).select("observation", "a.lo", "a.hi")


@query("SF-20_contamination", f"WITH {RUN_SQL}, m AS (SELECT *, credits - coalesce(lag(credits) OVER w, 0) AS spent, used_ppm - lag(used_ppm) OVER w AS delta FROM cr WINDOW w AS (PARTITION BY account ORDER BY ts)) SELECT account, coalesce(max(used_ppm) FILTER (WHERE spent = 0) - min(used_ppm) FILTER (WHERE spent = 0), -1) AS drift, count(DISTINCT observation % 5) AS sessions, count(*) FILTER (WHERE observation % 7 = 0) AS foreign_rows, count(*) FILTER (WHERE spent = 0 AND delta > {RES}) AS unexplained FROM m GROUP BY account")
def sf20(spark, sf_dir):
    w = Window.partitionBy("account").orderBy("ts")
    rows = with_credits(spark, sf_dir).withColumn("delta", F.col("used_ppm") - F.lag("used_ppm").over(w)).withColumn("credits", F.col("credits") - F.coalesce(F.lag("credits").over(w), F.lit(0)))
    rows = rows.withColumn("session", F.col("observation") % 5).withColumn("own", F.col("observation") % 7 != 0)
    return calibration.contamination(rows, ["account"]).withColumn("drift", F.coalesce("drift", F.lit(-1))).withColumnRenamed("foreign", "foreign_rows")


@query("SF-21_calibration_health", f"WITH {S_SQL} SELECT observation, CASE WHEN account % 7 = 0 THEN 'inapplicable' WHEN observation % 5 = 0 THEN 'superseded' WHEN observation % 3 = 0 THEN 'provisional' WHEN used_ppm > 60000 THEN 'suspect' WHEN used_ppm > 30000 THEN 'review_due' ELSE 'current' END AS health FROM ser")
def sf21(spark, sf_dir):
    h = calibration.health(F.col("account") % 7 != 0, F.col("observation") % 5 == 0, F.col("observation") % 3 == 0, F.col("used_ppm") > 60_000, F.col("used_ppm") > 30_000)
    return series(spark, sf_dir).select("observation", h.alias("health"))


@query("SF-22_activation_gate", f"WITH {S_SQL} SELECT observation, coalesce(CASE WHEN observation % 11 = 0 THEN 'training_in_validation' WHEN account % 13 < 4 THEN 'too_few_samples' WHEN used_ppm > 50000 THEN 'residual_too_large' WHEN observation % 2 = 0 THEN 'unhealthy' END, 'activated') AS verdict FROM ser")
def sf22(spark, sf_dir):
    r = calibration.activation_refusal((F.col("observation") % 11 == 0).cast("int"), F.col("used_ppm"), 50_000, F.col("account") % 13, 4, F.col("observation") % 2 != 0)
    return series(spark, sf_dir).select("observation", F.coalesce(r, F.lit("activated")).alias("verdict"))


@query("SF-19_all_reasons", f"WITH {S_SQL} SELECT observation, concat_ws(',', CASE WHEN NOT (observation % 2 = 0) THEN 'unsettled' END, CASE WHEN NOT (used_ppm > 20000) THEN 'too_small' END, CASE WHEN NOT (account % 3 > 0) THEN 'foreign' END) AS reasons FROM ser")
def sf19(spark, sf_dir):
    r = calibration.all_reasons((F.col("observation") % 2 == 0, "unsettled"), (F.col("used_ppm") > 20_000, "too_small"), (F.col("account") % 3 > 0, "foreign"))
    return series(spark, sf_dir).select("observation", F.array_join(r, ",").alias("reasons"))


@query(
    "AG-13_history_distribution",
    """WITH s AS (SELECT o_orderpriority AS grp, round(o_totalprice)::BIGINT AS v, CASE WHEN o_orderstatus = 'P' THEN 'partial' WHEN o_custkey % 10 = 3 THEN 'ambiguous' END AS why FROM orders),
r AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY grp, why IS NULL ORDER BY v) END AS rank, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY grp) AS n FROM s)
SELECT grp, max(n) AS included, count(*) FILTER (WHERE why = 'partial') AS excluded_partial, count(*) FILTER (WHERE why = 'ambiguous') AS excluded_ambiguous, ((2 * sum(v) FILTER (WHERE why IS NULL) * 1000000 + sum(v)) // (2 * sum(v)))::BIGINT AS coverage_ppm,
       max(v) FILTER (WHERE rank = greatest(1, (50 * n + 99) // 100)) AS p50, max(v) FILTER (WHERE rank = greatest(1, (25 * n + 99) // 100)) AS central_low, max(v) FILTER (WHERE rank = greatest(1, (75 * n + 99) // 100)) AS central_high, max(v) FILTER (WHERE rank = greatest(1, (90 * n + 99) // 100)) AS upper, 'sufficient' AS state FROM r GROUP BY grp""",
)
def ag13(spark, sf_dir):
    s = t.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.round("o_totalprice").cast("bigint").alias("v"), "o_orderstatus", "o_custkey")
    return advice.history_distribution(s, ["grp"], "v", {"partial": F.col("o_orderstatus") == "P", "ambiguous": F.col("o_custkey") % 10 == 3})


@query(
    "AG-14_fallback_ladder",
    "WITH c AS (SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT c.p_type, c.p_brand, c.p_size, CASE WHEN c.n >= 4 THEN 0 WHEN b.n >= 4 THEN 1 ELSE 2 END AS level, CASE WHEN c.n >= 4 THEN c.n WHEN b.n >= 4 THEN b.n ELSE (SELECT count(*) FROM part) END AS n FROM c JOIN b USING (p_type, p_brand)",
)
def ag14(spark, sf_dir):
    rows = t.table(spark, sf_dir, "part").select("p_type", "p_brand", "p_size")
    return advice.fallback_ladder(rows, [["p_type", "p_brand", "p_size"], ["p_type", "p_brand"], []], least=4)


@query("SF-17_verdict", f"WITH {S_SQL} SELECT observation, CASE WHEN used_ppm >= 2 * 30000 THEN 'AMPLE' WHEN 20000 > used_ppm + 1000 THEN 'INSUFFICIENT' ELSE 'MARGINAL' END AS verdict FROM ser")
def sf17(spark, sf_dir):
    v = advice.verdict(F.col("used_ppm"), F.col("used_ppm") + 1000, F.lit(20_000), F.lit(30_000))
    return series(spark, sf_dir).select("observation", v.alias("verdict"))


@query("SL-5_limiting_window", f"WITH {S_SQL} SELECT account, arg_min(observation, {{'a': used_ppm // 1000, 'b': used_ppm // 100, 'i': observation}}) AS observation FROM ser GROUP BY account")
def sl5(spark, sf_dir):
    return series(spark, sf_dir).groupBy("account").agg(F.min_by("observation", F.struct(F.expr("used_ppm div 1000"), F.expr("used_ppm div 100"), "observation")).alias("observation"))


@query("SF-28_readiness", f"WITH {S_SQL}, a AS (SELECT account, count(*) AS n, max(used_ppm) AS u FROM ser GROUP BY account) SELECT account, concat_ws(',', CASE WHEN n < 12 THEN 'history' END, CASE WHEN u >= 90000 THEN 'meter' END, CASE WHEN account % 4 = 0 THEN 'calibration' END) AS missing FROM a")
def sf28(spark, sf_dir):
    rows = series(spark, sf_dir).groupBy("account").agg(F.count("*").alias("n"), F.max("used_ppm").alias("u"))
    return rows.select("account", F.array_join(advice.readiness({"history": F.col("n") >= 12, "meter": F.col("u") < 90_000, "calibration": F.col("account") % 4 != 0}), ",").alias("missing"))


@query("ML-7_residuals", f"WITH {BLOCK_SQL} SELECT account, start, delta - 45 * credits AS residual_lo, delta - 35 * credits AS residual_hi FROM blk")
def ml7(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("account", "start", F.col("delta").alias("observed"), (35 * F.col("credits")).alias("explained_lo"), (45 * F.col("credits")).alias("explained_hi"))
    return reconcile.residuals(rows).select("account", "start", "residual_lo", "residual_hi")


@query(
    "AG-23_rolling_residual",
    f"WITH {BLOCK_SQL}, r AS (SELECT account, count(*) AS n, sum(abs(delta))::BIGINT AS observed, sum(40 * credits)::BIGINT AS explained FROM blk GROUP BY account), p AS (SELECT *, observed - explained AS residual, CASE WHEN observed <> 0 THEN ((2 * abs(observed - explained) * 1000000 + observed) // (2 * observed))::BIGINT END AS residual_ppm FROM r) SELECT *, CASE WHEN n < 5 THEN 'suppressed' WHEN residual_ppm IS NULL THEN 'no_movement' WHEN residual_ppm >= 200000 THEN 'unexplained' ELSE 'explained' END AS verdict FROM p",
)
def ag23(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("account", F.abs("delta").alias("observed"), (40 * F.col("credits")).alias("explained"))
    return reconcile.rolling_residual(rows, ["account"], 5, 200_000)


@query(
    "WN-14_residual_patterns",
    f"""WITH {BLOCK_SQL}, r AS (SELECT account, start, delta - 40 * credits AS residual FROM blk),
s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY account) AS n, sign(residual) <> 0 AND coalesce(sign(residual) <> sign(lag(residual) OVER w), true) AS turns FROM r WINDOW w AS (PARTITION BY account ORDER BY start)),
f AS (SELECT account, n, bool_and(residual > 0) AS up, bool_and(residual < 0) AS down, bool_and(turns) AS turns, coalesce(sum(residual) FILTER (WHERE i <= n // 2), 0)::BIGINT AS a, sum(residual) FILTER (WHERE i > n // 2)::BIGINT AS b, sum(residual)::BIGINT AS net, sum(abs(residual))::BIGINT AS size FROM s GROUP BY account, n),
st AS (SELECT *, abs(sign(b) * (abs(b) // (n - n // 2)) - sign(a) * (abs(a) // greatest(n // 2, 1))) AS step FROM f)
SELECT account, n, concat_ws(',', CASE WHEN n >= 3 AND up THEN 'persistently_positive' END, CASE WHEN n >= 3 AND down THEN 'persistently_negative' END,
  CASE WHEN n >= 4 AND size > 0 AND turns AND abs(net) * 5 <= size THEN 'alternating_net_zero' END, CASE WHEN n >= 4 AND size > 0 AND NOT turns AND step > 0 AND step * n >= size THEN 'step_change' END) AS patterns FROM st""",
)
def wn14(spark, sf_dir):
    rows = blocks(spark, sf_dir).select("account", "start", (F.col("delta") - 40 * F.col("credits")).alias("residual"))
    return reconcile.residual_patterns(rows, ["account"], "start").withColumn("patterns", F.array_join("patterns", ","))


@query("SF-18_residual_uncertainty", f"WITH {BLOCK_SQL} SELECT account, start, least(credits * 35, credits * 45, (credits + 10) * 35, (credits + 10) * 45) AS lo, greatest(credits * 35, credits * 45, (credits + 10) * 35, (credits + 10) * 45) AS hi FROM blk")
def sf18(spark, sf_dir):
    from ..functions import exact

    product = exact.interval_mul(exact.interval(F.col("credits"), F.col("credits") + 10), exact.interval(F.lit(35), F.lit(45)))
    return blocks(spark, sf_dir).withColumn("u", product).select("account", "start", "u.lo", "u.hi")


@query(
    "AG-17_retention",
    """WITH b AS (SELECT event_id AS backup, ts, event_type = 'view' AS verified FROM events), u AS (SELECT unnest(['day', 'week', 'month', 'year']) AS unit, unnest([7, 4, 6, 2]) AS keep),
n AS (SELECT unit, keep, backup, date_trunc(unit, ts) AS bucket, row_number() OVER (PARTITION BY unit, date_trunc(unit, ts) ORDER BY ts DESC, backup DESC) AS nth FROM b, u),
k AS (SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY bucket DESC) AS place FROM n WHERE nth = 1),
w AS (SELECT backup, unit AS why FROM k WHERE place <= keep UNION SELECT arg_max(backup, {'t': ts, 'b': backup}), 'verified' FROM b WHERE verified)
SELECT backup, array_to_string(list_sort(list(DISTINCT why)), ',') AS why FROM w GROUP BY backup""",
)
def ag17(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("backup"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("verified"))
    return reconcile.retention(rows, {"day": 7, "week": 4, "month": 6, "year": 2}).select("backup", F.array_join("why", ",").alias("why"))
