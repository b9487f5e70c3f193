"""Queries that attribute usage: accounts, tasks, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import format_rfc3339
from ..operators import attribution as a
from ..operators import canrun
from ..operators import tasks as reports
from ..sources import databases
from ..sources import tables as t
from .registry import query

ACCOUNT_SQL = f"""
{t.EV_SQL}, {t.MARK_SQL}, {t.USE_SQL},
best AS (SELECT *, min(rank) OVER (PARTITION BY session) AS b FROM mark),
mk AS (SELECT session, ts, arg_max(account, {{'o': coalesce(okey, -1), 'm': marker}}) AS account, min(rank) AS rank FROM best WHERE rank = b GROUP BY session, ts),
acc AS (SELECT use.event_id, use.session, use.ts, use.tokens, coalesce(mk.account, 'unknown-account') AS account, mk.rank AS rank FROM use ASOF LEFT JOIN mk ON use.session = mk.session AND use.ts >= mk.ts)"""
TASK_SQL = f"""
{t.EV_SQL}, {t.CLAIM_SQL}, {t.USE_SQL},
marks AS (SELECT session, ts, list_sort(list(DISTINCT task) FILTER (WHERE kind = 'claim')) AS claimed FROM claim GROUP BY session, ts),
firsts AS (SELECT session, min(ts) AS first_ts FROM marks GROUP BY session),
cl AS (SELECT session, ts AS claim_ts, claimed FROM marks WHERE len(claimed) > 0),
at_claim AS (SELECT use.*, cl.claim_ts, cl.claimed FROM use ASOF LEFT JOIN cl ON use.session = cl.session AND use.ts >= cl.claim_ts),
rel AS (SELECT session, task, ts AS release_ts FROM claim WHERE kind = 'release'),
at_rel AS (SELECT at_claim.*, rel.release_ts FROM at_claim ASOF LEFT JOIN rel ON at_claim.session = rel.session AND at_claim.claimed[1] = rel.task AND at_claim.ts >= rel.release_ts),
tasked AS (
  SELECT at_rel.event_id, at_rel.session, at_rel.ts, tokens,
         CASE WHEN first_ts IS NULL THEN 'unclaimed_session' WHEN at_rel.ts < first_ts THEN 'before_first_claim' WHEN claim_ts IS NULL THEN 'after_release_with_no_next_claim'
              WHEN len(claimed) >= 2 THEN 'contended' WHEN release_ts > claim_ts THEN 'after_release_with_no_next_claim' ELSE claimed[1] END AS bucket
  FROM at_rel LEFT JOIN firsts USING (session))"""


def accounts(spark, sf_dir):
    return a.attribute_accounts(t.usage(spark, sf_dir), t.markers(spark, sf_dir))


def tasks(spark, sf_dir):
    return a.attribute_tasks(t.usage(spark, sf_dir), t.claims(spark, sf_dir))


@query("JN-6_account_asof", f"WITH {ACCOUNT_SQL} SELECT event_id, account FROM acc")
def jn6(spark, sf_dir):
    return accounts(spark, sf_dir).select("event_id", "account")


@query("JN-7_task_intervals", f"WITH {TASK_SQL} SELECT event_id, bucket FROM tasked")
def jn7(spark, sf_dir):
    return tasks(spark, sf_dir).select("event_id", "bucket")


@query(
    "JN-7_ambiguous_windows",
    f"WITH {t.EV_SQL}, {t.CLAIM_SQL}, {t.USE_SQL}, w AS (SELECT event_id, session, ts AS start, ts + 86400000000000 AS stop FROM use) SELECT event_id, coalesce(w.stop > (SELECT min(c.ts) FROM claim c WHERE c.session = w.session AND c.ts > w.start), false) AS ambiguous FROM w",
)
def jn7_windows(spark, sf_dir):
    w = t.usage(spark, sf_dir).select("event_id", "session", F.col("ts").alias("start"), (F.col("ts") + 86_400_000_000_000).alias("end"))
    return a.straddles(w, t.claims(spark, sf_dir)).select("event_id", "ambiguous")


#: A third of the claims name no session: they are the timeline that sessions fall back on.
OVERLAY_SQL = TASK_SQL.replace(t.CLAIM_SQL, t.CLAIM_SQL.replace("claim AS (SELECT user_id AS session", "claim AS (SELECT CASE WHEN event_id % 3 <> 0 THEN user_id END AS session"))
OVERLAY_SQL = f"""{OVERLAY_SQL},
smark AS (SELECT ts, list_sort(list(DISTINCT task) FILTER (WHERE kind = 'claim')) AS claimed FROM claim WHERE session IS NULL GROUP BY ts),
scl AS (SELECT ts AS claim_ts, claimed FROM smark WHERE len(claimed) > 0),
s1 AS (SELECT use.event_id, use.ts, scl.claim_ts, scl.claimed FROM use ASOF LEFT JOIN scl ON use.ts >= scl.claim_ts),
srel AS (SELECT task, ts AS release_ts FROM claim WHERE session IS NULL AND kind = 'release'),
s2 AS (SELECT s1.*, srel.release_ts FROM s1 ASOF LEFT JOIN srel ON s1.claimed[1] = srel.task AND s1.ts >= srel.release_ts),
sh AS (SELECT event_id, CASE WHEN ts < first_ts THEN 'before_first_claim' WHEN claim_ts IS NULL THEN 'after_release_with_no_next_claim' WHEN len(claimed) >= 2 THEN 'contended'
         WHEN release_ts > claim_ts THEN 'after_release_with_no_next_claim' ELSE claimed[1] END AS bucket, first_ts FROM s2, (SELECT min(ts) AS first_ts FROM smark))"""


@query(
    "JN-8_claim_overlay",
    f"WITH {OVERLAY_SQL} SELECT tasked.event_id, CASE WHEN first_ts IS NOT NULL AND tasked.bucket IN ('before_first_claim', 'after_release_with_no_next_claim', 'unclaimed_session') THEN sh.bucket ELSE tasked.bucket END AS bucket FROM tasked JOIN sh USING (event_id)",
)
def jn8(spark, sf_dir):
    claims = t.claims(spark, sf_dir).withColumn("session", F.when(F.col("claim") % 3 != 0, F.col("session")))
    return a.attribute_overlaid(t.usage(spark, sf_dir), claims).select("event_id", "bucket")


#: Four kinds of tokens out of an event's two numbers, and when its session started.
KINDS = ("input", "output", "cache_read", "cache_write")
KIND_SQL = f"""{ACCOUNT_SQL},
st AS (SELECT user_id AS session, min(ts) FILTER (WHERE event_type = 'signup') AS started FROM ev GROUP BY 1),
q AS (SELECT acc.session, coalesce(acc.rank, 5) AS rank, st.started, tokens AS input, tokens // 3 AS output, ev.k * 10 AS cache_read, ev.k % 7 AS cache_write FROM acc JOIN ev USING (event_id) LEFT JOIN st ON st.session = acc.session),
l AS (SELECT session, rank, started, unnest([{", ".join(f"'{k}'" for k in KINDS)}]) AS kind, unnest([{", ".join(KINDS)}]) AS tokens FROM q),
sc AS (SELECT 'all_history' AS scope, * FROM l UNION ALL SELECT 'recent', * FROM l WHERE started >= 1704412800000000000),
grid AS (SELECT scope, kind FROM (VALUES ('all_history'), ('recent')) s(scope), (SELECT DISTINCT kind FROM l))"""


def evidence(spark, sf_dir):
    ev = t.events(spark, sf_dir)
    started = ev.groupBy(F.col("user_id").alias("session")).agg(F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("started"))
    rows = accounts(spark, sf_dir).join(ev.select("event_id", "k"), "event_id").join(started, "session", "left")
    return rows.select("session", "rank", "started", F.col("tokens").alias("input"), F.expr("tokens div 3").alias("output"), (F.col("k") * 10).alias("cache_read"), (F.col("k") % 7).alias("cache_write"))


@query(
    "AG-11_attribution_quality",
    f"""WITH {KIND_SQL}, w AS (SELECT scope, kind, {", ".join(f"coalesce(sum(tokens) FILTER (WHERE rank = {c}), 0)::BIGINT AS class_{c}" for c in range(1, 6))} FROM grid LEFT JOIN sc USING (scope, kind) GROUP BY ALL),
x AS (SELECT *, class_1 + class_2 + class_3 + class_4 AS attributed, class_1 + class_2 + class_3 + class_4 + class_5 AS tokens FROM w)
SELECT *, CASE WHEN tokens <> 0 THEN ((2 * attributed * 1000000 + tokens) // (2 * tokens))::BIGINT END AS attributed_ppm, CASE WHEN scope = 'recent' THEN (SELECT count(*) FROM q WHERE started IS NULL) ELSE 0 END AS undated FROM x""",
)
def ag11(spark, sf_dir):
    return a.attribution_quality(evidence(spark, sf_dir), KINDS, "rank", 1_704_412_800_000_000_000)


@query(
    "AG-11_breaches",
    f"WITH {KIND_SQL}, s AS (SELECT session, scope, kind, sum(tokens)::BIGINT AS tokens, sum(CASE WHEN rank < 5 THEN tokens ELSE 0 END)::BIGINT AS attributed FROM sc GROUP BY ALL) SELECT session, scope, kind, tokens, attributed FROM s WHERE tokens > 0 AND attributed * 1000000 < 500000 * tokens",
)
def ag11_breaches(spark, sf_dir):
    per = a.attribution_quality(evidence(spark, sf_dir), KINDS, "rank", 1_704_412_800_000_000_000, ["session"])
    return a.breaches(per, 500_000).select("session", "scope", "kind", "tokens", "attributed")


@query("AG-12_evidence_rank", f"WITH {t.EV_SQL}, {t.MARK_SQL} SELECT account, min(rank) AS best, max(rank) AS worst FROM mark GROUP BY account")
def ag12(spark, sf_dir):
    return t.markers(spark, sf_dir).groupBy("account").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))


@query("AG-19_task_report", f"WITH {TASK_SQL} SELECT bucket, bucket LIKE 'task-%' AS is_task, sum(tokens)::BIGINT AS tokens, count(*) AS events, count(DISTINCT session) AS sessions, ((2 * sum(tokens) * 1000000 + sum(sum(tokens)) OVER ()) // (2 * sum(sum(tokens)) OVER ()))::BIGINT AS share_ppm FROM tasked GROUP BY bucket")
def ag19(spark, sf_dir):
    return a.task_report(tasks(spark, sf_dir))


@query("AG-19_task_sessions", f"WITH {TASK_SQL}, s AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 4 <> 0 THEN 'run-' || c_custkey // 10 END AS run FROM customer) SELECT bucket, session, any_value(run) AS run, sum(tokens)::BIGINT AS tokens, count(*) AS events FROM tasked LEFT JOIN s USING (session) WHERE bucket LIKE 'task-%' GROUP BY bucket, session")
def ag19_sessions(spark, sf_dir):
    runs = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("run-"), F.expr("c_custkey div 10").cast("string"))).alias("run"))
    return a.task_sessions(tasks(spark, sf_dir), runs)


#: Usage of tasks in four kinds; what could not be read are a session's errors, and every eleventh count is an estimate.
QUALIFIED_SQL = f"""{TASK_SQL},
u AS (SELECT bucket || '-' || tasked.session % 7 AS task, tasked.session, CASE WHEN k % 11 <> 0 THEN 'reported' WHEN k % 2 = 0 THEN 'char-ratio' END AS evidence, tasked.tokens AS input, tasked.tokens // 3 AS output, k * 10 AS cache_read, CASE WHEN k % 29 = 3 THEN 1 + k % 7 END AS cache_write
  FROM tasked JOIN ev USING (event_id) WHERE bucket LIKE 'task-%'),
bad AS (SELECT DISTINCT user_id AS session, 'class-' || k % 3 AS class FROM ev WHERE event_type = 'error' AND k % 50 = 7),
ses AS (SELECT task, session, count(*) AS events, {", ".join(f"coalesce(sum({k}), 0)::BIGINT AS {k}" for k in KINDS)}, count(*) FILTER (WHERE evidence = 'reported') AS measured,
  coalesce(list(DISTINCT coalesce(evidence, 'unknown')) FILTER (WHERE evidence IS DISTINCT FROM 'reported'), []) AS methods, (SELECT coalesce(list(class), []) FROM bad WHERE bad.session = u.session) AS quarantined FROM u GROUP BY task, session)"""
STATE_SQL = f"""CASE WHEN len(quarantined) > 0 THEN 'partial' ELSE 'complete' END AS coverage, CASE WHEN len(quarantined) > 0 THEN '{",".join(KINDS)}' ELSE '' END AS missing, CASE WHEN measured = events THEN 'measured' WHEN measured = 0 THEN 'estimated' ELSE 'mixed' END AS quality,
  array_to_string(list_sort(list_distinct(methods)), ',') AS methods, array_to_string(list_sort(list_distinct(quarantined)), ',') AS quarantined, CASE WHEN cache_write = 0 THEN 3 * input + 15 * output + cache_read END AS credits, CASE WHEN cache_write <> 0 THEN 'rate of cache_write' ELSE '' END AS refused"""


def session_states(spark, sf_dir):
    ev, k = t.events(spark, sf_dir), F.col("k")
    rows = tasks(spark, sf_dir).where(F.col("bucket").startswith("task-")).join(ev.select("event_id", "k"), "event_id")
    evidence = F.when(k % 11 != 0, "reported").when(k % 2 == 0, "char-ratio")
    used = rows.select(F.concat("bucket", F.lit("-"), (F.col("session") % 7).cast("string")).alias("task"), "session", evidence.alias("evidence"), F.col("tokens").alias("input"), F.expr("tokens div 3").alias("output"), (k * 10).alias("cache_read"), F.when(k % 29 == 3, 1 + k % 7).alias("cache_write"))
    bad = ev.where((F.col("event_type") == "error") & (k % 50 == 7)).select(F.col("user_id").alias("session"), F.concat(F.lit("class-"), (k % 3).cast("string")).alias("class"))
    return reports.session_usage(used, KINDS, bad, ["session"])


def told(states):
    rated = {"input": 3, "output": 15, "cache_read": 1}
    out = reports.qualify(states, KINDS, rated)
    return out.withColumns({c: F.array_join(c, ",") for c in ("methods", "missing", "quarantined", "refused")})


@query("AG-19_qualified_sessions", f"WITH {QUALIFIED_SQL} SELECT task, session, events, {', '.join(KINDS)}, {STATE_SQL} FROM ses")
def ag19_qualified_sessions(spark, sf_dir):
    return told(session_states(spark, sf_dir))


@query(
    "AG-19_qualified_tasks",
    f"""WITH {QUALIFIED_SQL},
tk AS (SELECT task, count(*) AS sessions, sum(events)::BIGINT AS events, {", ".join(f"sum({k})::BIGINT AS {k}" for k in KINDS)}, sum(measured) AS measured, flatten(list(methods)) AS methods, flatten(list(quarantined)) AS quarantined FROM ses GROUP BY task),
nat AS (SELECT md5(c_custkey::VARCHAR) AS native_id FROM customer), f AS (SELECT lower(substr(native_id, 1, 3)) AS fragment, count(*) AS n FROM nat GROUP BY 1),
ac AS (SELECT n FROM (SELECT substr(md5(s_suppkey::VARCHAR), 1, 3) AS fragment FROM supplier) LEFT JOIN f USING (fragment))
SELECT task, sessions, events, {", ".join(KINDS)}, {STATE_SQL}, (SELECT count(*) FROM ac WHERE n IS NULL) AS unresolved_claims, (SELECT count(*) FROM ac WHERE n > 1) AS ambiguous_claims FROM tk""",
)
def ag19_qualified_tasks(spark, sf_dir):
    return reports.with_claims(told(reports.task_usage(session_states(spark, sf_dir), KINDS)), jn12(spark, sf_dir))


@query(
    "JN-12_actor_prefix",
    """WITH s AS (SELECT md5(c_custkey::VARCHAR) AS native_id FROM customer), f AS (SELECT lower(substr(native_id, 1, 3)) AS fragment, count(*) AS n, min(native_id) AS session FROM s GROUP BY 1),
ac AS (SELECT 'agent-' || substr(md5(s_suppkey::VARCHAR), 1, 3) AS actor FROM supplier)
SELECT actor, CASE WHEN n = 1 THEN session END AS session, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM ac LEFT JOIN f ON fragment = substr(actor, -3)""",
)
def jn12(spark, sf_dir):
    sessions = t.table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("native_id"))
    actors = t.table(spark, sf_dir, "supplier").select(F.concat(F.lit("agent-"), F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 3)).alias("actor"))
    return a.sessions_of_actors(actors, sessions, 3)


LINEAGE_SQL = "s AS (SELECT c_custkey AS session, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 2 END AS parent FROM customer), m AS (SELECT c_custkey AS session FROM customer WHERE c_nationkey < 4)"


@query(
    "JN-13_governing_ancestor",
    f"""WITH RECURSIVE {LINEAGE_SQL}, up AS (
  SELECT s.session, s.session AS node, 0 AS depth, m.session IS NOT NULL AS found FROM s LEFT JOIN m USING (session)
  UNION ALL
  SELECT u.session, s.parent, u.depth + 1, m.session IS NOT NULL FROM up u JOIN s ON s.session = u.node LEFT JOIN m ON m.session = s.parent WHERE NOT u.found AND s.parent IS NOT NULL)
SELECT session, arg_min(node, depth) FILTER (WHERE found) AS ancestor, min(depth) FILTER (WHERE found)::INTEGER AS depth FROM up GROUP BY session""",
)
def jn13(spark, sf_dir):
    c = t.table(spark, sf_dir, "customer")
    s = c.select(F.col("c_custkey").alias("session"), F.when(F.col("c_custkey") % 7 != 0, F.expr("c_custkey div 2")).alias("parent"))
    return a.governing_ancestor(s, c.where("c_nationkey < 4").select(F.col("c_custkey").alias("session")))


@query(
    "JN-14_overlapping_sessions",
    f"WITH {t.EV_SQL}, s AS (SELECT user_id AS session, min(ts) AS a, max(ts) AS b FROM ev WHERE event_type = 'click' GROUP BY 1) SELECT x.session, count(y.session) AS overlapping FROM s x LEFT JOIN s y ON x.session <> y.session AND y.a <= x.a + 3600000000000 AND y.b >= x.a GROUP BY x.session",
)
def jn14(spark, sf_dir):
    s = t.events(spark, sf_dir, "click").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return a.overlapping_sessions(s, 3_600_000_000_000, 86_400_000_000_000)


@query("WN-18_explicit_claim", f"WITH {t.EV_SQL}, {t.MARK_SQL}, {t.USE_SQL}, g AS (SELECT session, ts, count(DISTINCT account) AS n, min(account) AS account, okey FROM mark GROUP BY session, ts, okey), l AS (SELECT session, ts, arg_max({{'n': n, 'a': account}}, coalesce(okey, -1)) AS g FROM g GROUP BY session, ts) SELECT use.event_id, CASE WHEN l.g IS NULL THEN 'none' WHEN l.g.n > 1 THEN 'conflict' ELSE 'claimed' END AS state, CASE WHEN l.g.n = 1 THEN l.g.a END AS account FROM use ASOF LEFT JOIN l ON use.session = l.session AND use.ts >= l.ts")
def wn18(spark, sf_dir):
    return a.explicit_claim(t.usage(spark, sf_dir), t.markers(spark, sf_dir)).select("event_id", "state", "account")


@query("SF-25_axis_resolution", f"WITH {t.EV_SQL}, v AS (SELECT user_id AS task, event_type AS value, k % 4 AS rank, event_id AS provenance FROM ev), b AS (SELECT *, min(rank) OVER (PARTITION BY task) AS best FROM v) SELECT task, min(best) AS rank, arg_min(value, provenance) AS value, count(DISTINCT value) > 1 AS conflict FROM b WHERE rank = best GROUP BY task")
def sf25(spark, sf_dir):
    votes = t.events(spark, sf_dir).select(F.col("user_id").alias("task"), F.col("event_type").alias("value"), (F.col("k") % 4).alias("rank"), F.col("event_id").alias("provenance"))
    return a.resolve_axis(votes, ["task"])


#: Tasks of their own for each session, so that histories have many.
RATES = {"input": 3, "output": 15, "cache_read": 1, "cache_write": 4}
PERIOD = (1_704_412_800_000_000_000, 1_706_140_800_000_000_000)
SAMPLE_SQL = ACCOUNT_SQL + ", " + (t.CLAIM_SQL + TASK_SQL[TASK_SQL.index(",\nmarks AS") :]).replace("(k % 20) AS task", "(k % 20) || '-' || user_id AS task")
SAMPLE_SQL = f"""{SAMPLE_SQL},
amb AS (SELECT DISTINCT session FROM use w WHERE w.ts + 3600000000000 > (SELECT min(c.ts) FROM claim c WHERE c.session = w.session AND c.ts > w.ts)),
cells AS (SELECT DISTINCT task, CASE WHEN session % 5 IN (0, 1) THEN 'small_medium' ELSE 'large' END AS breadth, CASE WHEN session % 3 = 0 AND session % 4 <> 0 THEN 'review' ELSE 'gate' END AS verify, CASE WHEN session % 3 = 0 AND session % 4 <> 0 THEN 'fixed' ELSE 'open' END AS spec, session % 7 = 0 AS critical FROM claim WHERE session % 11 <> 0),
done AS (SELECT DISTINCT task FROM claim WHERE kind = 'release' AND ts >= {PERIOD[0]} AND ts < {PERIOD[1]}),
q AS (SELECT bucket AS task, tasked.session, acc.rank, tasked.tokens AS input, tasked.tokens // 3 AS output, k * 10 AS cache_read, CASE WHEN k % 19 <> 0 THEN k % 7 END AS cache_write, k % 17 = 0 AS estimated FROM tasked JOIN acc USING (event_id) JOIN ev USING (event_id)),
per AS (SELECT task, CASE WHEN bool_and(cache_write IS NOT NULL) THEN sum(3 * input + 15 * output + cache_read + 4 * cache_write)::BIGINT END AS credits, NOT bool_or(estimated) AS measured, max(coalesce(rank, 5)) AS evidence, NOT bool_or(session IN (SELECT session FROM amb)) AS complete FROM q JOIN done USING (task) GROUP BY task),
smp AS (SELECT task, coalesce(breadth, 'large') AS breadth, coalesce(verify, 'gate') AS verify, coalesce(spec, 'open') AS spec, coalesce(critical, false) AS critical, credits, measured, evidence, complete FROM per LEFT JOIN cells USING (task))"""


def task_samples(spark, sf_dir):
    ev, session = t.events(spark, sf_dir), F.col("session")
    claims = t.claims(spark, sf_dir).withColumn("task", F.concat("task", F.lit("-"), session.cast("string")))
    used = t.usage(spark, sf_dir)
    unsure = a.straddles(used.select("event_id", "session", F.col("ts").alias("start"), (F.col("ts") + 3_600_000_000_000).alias("end")), claims).select("event_id", "ambiguous")
    rows = a.attribute_tasks(used, claims).join(accounts(spark, sf_dir).select("event_id", "rank"), "event_id").join(unsure, "event_id").join(ev.select("event_id", "k"), "event_id")
    k = F.col("k")
    rows = rows.select("bucket", "session", "rank", "ambiguous", (k % 17 == 0).alias("estimated"), F.col("tokens").alias("input"), F.expr("tokens div 3").alias("output"), (k * 10).alias("cache_read"), F.when(k % 19 != 0, k % 7).alias("cache_write"))
    size = F.element_at(F.array(*[F.lit(x) for x in ("S", "M", "L", "XL", None)]), (session % 5 + 1).cast("int"))
    names = claims.where(session % 11 != 0).select("task", size.alias("size"), F.when(session % 3 == 0, "review").alias("verify"), F.when(session % 4 != 0, "fixed").alias("spec"), (session % 7 == 0).alias("critical")).distinct()
    return canrun.task_samples(rows, claims, names, RATES, *PERIOD)


@query("JN-18_task_history", f"WITH {SAMPLE_SQL} SELECT * FROM smp")
def jn18(spark, sf_dir):
    return task_samples(spark, sf_dir)


HISTORY_SQL = f"""{SAMPLE_SQL},
why AS (SELECT *, CASE WHEN credits IS NULL THEN 'unknown_token_components' WHEN evidence = 5 THEN 'unknown_account_attribution' WHEN NOT complete THEN 'incomplete_segmentation' WHEN NOT measured THEN 'estimated_tokens' END AS why,
  CASE WHEN critical THEN 'critical=true' ELSE breadth || '/' || verify || '/' || spec || ' critical=false' END AS g0, breadth || ' critical=' || critical::VARCHAR AS g1 FROM smp),
lv AS (SELECT *, unnest([0, 1, 2]) AS level, unnest([g0, g1, 'all tasks']) AS grp FROM why),
rk AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY level, grp, why IS NULL ORDER BY credits) END AS r, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY level, grp) AS n FROM lv),
hs AS (SELECT level, grp, max(n) AS included, {", ".join(f"count(*) FILTER (WHERE why = '{r}') AS excluded_{r}" for r in canrun.INELIGIBLE)},
  CASE WHEN sum(credits) <> 0 THEN ((2 * coalesce(sum(credits) FILTER (WHERE why IS NULL), 0) * 1000000 + sum(credits)) // (2 * sum(credits)))::BIGINT END AS coverage_ppm,
  {", ".join(f"CASE WHEN max(n) >= 5 THEN max(credits) FILTER (WHERE r = greatest(1, ({p} * n + 99) // 100)) END AS {c}" for c, p in (("p50", 50), ("central_low", 25), ("central_high", 75), ("upper", 90)))},
  CASE WHEN max(n) >= 5 THEN 'sufficient' ELSE 'insufficient' END AS state FROM rk GROUP BY level, grp)"""


@query("AG-13_group_history", f"WITH {HISTORY_SQL} SELECT * FROM hs")
def ag13_groups(spark, sf_dir):
    return canrun.group_history(task_samples(spark, sf_dir), 5)


@query(
    "AG-14_selected_history",
    f"WITH {HISTORY_SQL}, c AS (SELECT DISTINCT breadth, verify, spec, critical, g0, g1 FROM why) SELECT c.breadth, c.verify, c.spec, c.critical, arg_min(hs.grp, level) AS grp, min(level)::INTEGER AS level, arg_min(included, level) AS included FROM c JOIN hs ON grp = CASE level WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE 'all tasks' END WHERE state = 'sufficient' OR level = 2 GROUP BY ALL",
)
def ag14_selected(spark, sf_dir):
    samples = task_samples(spark, sf_dir)
    found = canrun.select_history(samples.select(*canrun.CELL).distinct(), canrun.group_history(samples, 5))
    return found.select(*canrun.CELL, "grp", "level", "included")


CAN_RUN_SQL = f"""{HISTORY_SQL}, {t.METER_SQL},
rq AS (SELECT DISTINCT account, 'm' || (account % 4) AS model, CASE account % 9 WHEN 0 THEN 'auth_required' WHEN 1 THEN 'stale' ELSE 'fresh' END AS state_, CASE WHEN account % 2 = 0 THEN 'large' ELSE 'small_medium' END AS breadth, account % 7 = 0 AS critical FROM meter),
hq AS (SELECT rq.*, CASE WHEN critical THEN 'critical=true' ELSE breadth || '/gate/open critical=false' END AS g0, breadth || ' critical=' || critical::VARCHAR AS g1 FROM rq),
hd AS (SELECT hq.account, arg_min({{'state': hs.state, 'cov': coverage_ppm, 'p50': p50, 'upper': upper}}, level) AS h FROM hq JOIN hs ON grp = CASE level WHEN 0 THEN g0 WHEN 1 THEN g1 ELSE 'all tasks' END WHERE state = 'sufficient' OR level = 2 GROUP BY 1),
wd AS (SELECT account, observation % 3 AS slot, max(observation) AS id, arg_max(used_ppm, observation) AS used FROM meter GROUP BY 1, 2),
wn AS (SELECT wd.*, 'w' || slot AS win, CASE id % 7 WHEN 0 THEN 'suspect' WHEN 1 THEN NULL ELSE 'current' END AS health, CASE WHEN id % 2 = 0 THEN 400000 END AS est FROM wd),
wk AS (SELECT wn.account, win, CASE WHEN health IS NULL THEN (1000000 - used) * est // 1000000 WHEN health = 'current' THEN (1000000 - used) * 300000 // 1000000 END AS lo, CASE WHEN health IS NULL THEN (1000000 - used) * est // 1000000 WHEN health = 'current' THEN (1000000 - used) * 500000 // 1000000 END AS hi
  FROM wn JOIN rq USING (account) WHERE state_ = 'fresh' AND (slot = 0 OR (slot = 1 AND wn.account % 4 <> 3))),
wa AS (SELECT account, count(*) AS n, coalesce(list_sort(list(win) FILTER (WHERE lo IS NULL)), []) AS refused, arg_min({{'win': win, 'lo': lo, 'hi': hi}}, {{'lo': lo, 'hi': hi, 'win': win}}) FILTER (WHERE lo IS NOT NULL) AS l FROM wk GROUP BY 1),
fx AS (SELECT rq.account, l, h, list_concat(CASE WHEN state_ <> 'fresh' THEN ['meter'] ELSE [] END, CASE WHEN state_ = 'fresh' AND n IS NULL THEN ['constraining_windows'] ELSE [] END, coalesce(refused, []), CASE WHEN rq.account % 8 = 0 THEN ['cost_model'] ELSE [] END,
    CASE WHEN rq.account % 10 = 0 THEN ['plan_tier'] ELSE [] END, CASE WHEN h.state <> 'sufficient' THEN ['historical_task_evidence'] ELSE [] END, CASE WHEN h.cov < 400000 THEN ['attribution_quality'] ELSE [] END) AS missing FROM rq JOIN hd USING (account) LEFT JOIN wa USING (account))"""


@query(
    "SF-28_can_run",
    f"WITH {CAN_RUN_SQL} SELECT account AS request, CASE WHEN len(missing) = 0 THEN CASE WHEN l.lo >= h.upper * 2 THEN 'AMPLE' WHEN h.p50 > l.hi THEN 'INSUFFICIENT' ELSE 'MARGINAL' END WHEN missing = ['historical_task_evidence'] THEN 'INSUFFICIENT_EVIDENCE' ELSE 'UNKNOWN' END AS verdict, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN l.win END AS limiting FROM fx",
)
def sf28_can_run(spark, sf_dir):
    meters = t.meter(spark, sf_dir)
    account, slot, one = F.col("account"), F.col("slot"), F.col("id")
    requests = meters.select("account").distinct().select(
        account.alias("request"), "account", F.concat(F.lit("m"), (account % 4).cast("string")).alias("model"),
        F.when(account % 9 == 0, "auth_required").when(account % 9 == 1, "stale").otherwise("fresh").alias("meter"),
        F.when(account % 8 == 0, F.array(F.lit("reasoning"))).otherwise(F.array().cast("array<string>")).alias("unpriced"),
        F.lit("pro").alias("account_tier"), F.when(account % 10 == 0, "max").otherwise("pro").alias("calibration_tier"),
        F.when(account % 2 == 0, "large").otherwise("small_medium").alias("breadth"), F.lit("gate").alias("verify"), F.lit("open").alias("spec"), (account % 7 == 0).alias("critical"),
    )
    newest = meters.groupBy("account", (F.col("observation") % 3).alias("slot")).agg(F.max("observation").alias("id"), F.max_by("used_ppm", "observation").alias("used"))
    estimate = F.when(one % 2 == 0, 400_000)
    windows = newest.select(
        "account", F.concat(F.lit("w"), slot.cast("string")).alias("window"),
        F.when(slot == 0, "account").when(slot == 1, "model").otherwise("group").alias("scope"), F.when(account % 4 != 3, F.concat(F.lit("m"), (account % 4).cast("string"))).otherwise("m0").alias("named"),
        (1_000_000 - F.col("used")).alias("remaining_ppm"), F.when(one % 7 == 0, "suspect").when(one % 7 != 1, "current").alias("health"),
        F.lit(300_000).alias("lo"), F.lit(500_000).alias("hi"), estimate.alias("estimate_lo"), estimate.alias("estimate_hi"),
    )
    history = canrun.group_history(task_samples(spark, sf_dir), 5)
    found = canrun.select_history(requests.select(*canrun.CELL).distinct(), history)
    asked = requests.join(found, list(canrun.CELL), "left").select(*[c for c in requests.columns if c not in canrun.CELL], "included", "coverage_ppm", "p50", "upper", "state")
    return canrun.can_run(asked, windows, 400_000).withColumn("missing", F.array_join("missing", ","))


@query("JN-19_prefix_lookup", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000001%'")
def jn19(spark, sf_dir):
    return t.table(spark, sf_dir, "customer").where(F.lower("c_name").startswith("customer#00000001")).select("c_custkey", "c_name")


@query("ST-5_disjoint_sessions", f"WITH {TASK_SQL} SELECT bucket AS task, bool_or(session IN (SELECT session FROM tasked WHERE bucket = 'contended' OR bucket = 'before_first_claim')) AS touches FROM tasked WHERE bucket LIKE 'task-%' GROUP BY bucket")
def st5(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    unsure = rows.where(F.col("bucket").isin("contended", "before_first_claim")).select("session").distinct().withColumn("unsure", F.lit(True))
    return rows.where(F.col("bucket").startswith("task-")).join(unsure, "session", "left").groupBy(F.col("bucket").alias("task")).agg(F.coalesce(F.bool_or("unsure"), F.lit(False)).alias("touches"))


@query("LV-1_liveness", f"WITH {t.EV_SQL} SELECT user_id AS session, max(ts) AS last_seen, max(ts) >= (SELECT max(ts) FROM ev) - 86400000000000 AS live FROM ev WHERE event_type = 'view' GROUP BY 1")
def liveness(spark, sf_dir):
    now = t.events(spark, sf_dir).agg(F.max("ts").alias("now"))
    rows = t.events(spark, sf_dir, "view").groupBy(F.col("user_id").alias("session")).agg(F.max("ts").alias("last_seen"))
    return rows.join(F.broadcast(now)).select("session", "last_seen", (F.col("last_seen") >= F.col("now") - 86_400_000_000_000).alias("live"))


@query(
    "SC-15_tracker_events",
    f"""WITH {t.EV_SQL}, r AS (SELECT event_id AS upstream_id, ts, CASE WHEN event_type <> 'click' THEN CASE k % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'release' END END AS moved, event_type, k FROM ev WHERE k % 7 <> 0 AND event_type <> 'signup')
SELECT upstream_id, 'task-' || (k % 20) AS task, ts, coalesce(moved, 'unknown:' || CASE WHEN event_type = 'click' THEN 'comment' ELSE 'status_changed' END) AS kind, CASE WHEN k % 2 = 0 THEN 'agent-' || (k % 5) END AS actor FROM r""",
)
def sc15(spark, sf_dir):
    k, busy = F.col("k"), F.lit("in_progress")
    rows = t.events(spark, sf_dir).withColumn("upstream_id", F.col("event_id"))
    records = rows.select(
        "upstream_id",
        F.concat(F.lit("task-"), (k % 20).cast("string")).alias("task"),
        F.when(F.col("event_type") == "click", "comment").otherwise("status_changed").alias("event_type"),
        F.when(k % 3 == 1, busy).otherwise("open").alias("old_value"),
        F.when(k % 3 == 0, busy).otherwise("closed").alias("new_value"),
        F.when(k % 2 == 0, F.concat(F.lit("agent-"), (k % 5).cast("string"))).otherwise("").alias("actor"),
        F.when(k % 7 == 0, "yesterday").otherwise(format_rfc3339(F.col("ts"))).alias("occurred_at"),
    )
    events, _ = databases.task_events(records, "tracker")
    stored = rows.where("event_type = 'signup'").select(F.lit("tracker").alias("tracker"), "upstream_id")
    return databases.unseen(events, stored).drop("tracker")
