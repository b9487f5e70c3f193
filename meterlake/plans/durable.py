"""Queries over what is stored and leaves or enters the store: activations, retention, exports, documents, archives, and the checks over all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND, format_rfc3339
from ..operators import activation, calibration, canrun, doctor, exports, imports, meter, retention
from ..sources import published
from ..sources import tables as t
from ..sources.staging import new_folder
from .meters import A_SQL, NOW, observations
from .registry import query
from .timelines import ACCOUNT_SQL, CAN_RUN_SQL, accounts, sf28_can_run

HOUR, DAY = 3600 * SECOND, 86_400 * SECOND

CHAIN_SQL = """
e AS MATERIALIZED (SELECT user_id AS scope, event_id AS event, ts // 3600000000000 AS hr, 'm' || (k % 4) AS model, CASE WHEN k % 9 <> 0 THEN 'm' || (event_id % 4) END AS supersedes FROM ev WHERE event_type IN ('view', 'click')),
nx AS MATERIALIZED (SELECT a.event, arg_min(b.event, {'t': b.hr, 'e': b.event}) AS nxt, min(b.hr) AS until FROM e a JOIN e b ON a.scope = b.scope AND b.supersedes = a.model AND b.model <> b.supersedes AND b.hr > a.hr GROUP BY 1),
run AS (SELECT scope, arg_min(event, {'t': hr, 'e': event}) AS event FROM e WHERE supersedes IS NULL GROUP BY 1 UNION ALL SELECT run.scope, nxt FROM run JOIN nx USING (event)),
held AS MATERIALIZED (SELECT e.scope, e.event, e.hr, e.model, until FROM run JOIN e USING (event) LEFT JOIN nx USING (event)),
chain AS (SELECT e.event, h.model AS active, EXISTS (SELECT 1 FROM held WHERE held.event = e.event) AS accepted, e.model, e.supersedes, e.scope, e.hr FROM e ASOF LEFT JOIN held h ON e.scope = h.scope AND e.hr > h.hr)"""


def chained(spark, sf_dir) -> DataFrame:
    """Activations of four models in each user's scope, in whole hours, so that some share an instant."""
    e, k = t.events(spark, sf_dir).where("event_type in ('view', 'click')"), F.col("k") % 4
    name = lambda c: F.concat(F.lit("m"), c.cast("string"))
    return e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("event"), F.expr(f"ts div {HOUR}").alias("at"), name(k).alias("model"), F.when(F.col("k") % 9 != 0, name(F.col("event_id") % 4)).alias("supersedes"))


@query(
    "JN-21_activations",
    f"""WITH RECURSIVE {t.EV_SQL}, {CHAIN_SQL}
SELECT c.event, c.active, c.accepted, CASE WHEN c.accepted THEN NULL WHEN c.active IS NULL AND c.supersedes IS NOT NULL THEN 'nothing_to_supersede' WHEN c.active IS NOT NULL AND c.supersedes IS NULL THEN 'must_supersede_the_active' WHEN c.active <> c.supersedes THEN 'another_is_active' WHEN c.model = c.active THEN 'supersedes_itself' ELSE 'same_instant' END AS reason, held.until FROM chain c LEFT JOIN held ON held.event = c.event""",
)
def jn21_activations(spark, sf_dir):
    return activation.activations(chained(spark, sf_dir), ["scope"]).select("event", "active", "accepted", "reason", "until")


RULES = {
    "view": retention.Rule("rebuildable", group="transcripts"),
    "click": retention.Rule("disposable", most=50),
    "error": retention.Rule("disposable", lease=5 * DAY),
    "purchase": retention.Rule("irreplaceable"),
}


@query(
    "SK-11_retained",
    f"WITH {t.EV_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM ev) SELECT event_type, CASE event_type WHEN 'view' THEN 'rebuildable' WHEN 'click' THEN 'disposable' WHEN 'error' THEN 'disposable' WHEN 'purchase' THEN 'irreplaceable' ELSE 'untracked' END AS category, count(*) AS rows, count(*) FILTER (WHERE CASE event_type WHEN 'view' THEN false WHEN 'click' THEN nth <= 50 WHEN 'error' THEN ts + {5 * DAY} > {NOW} ELSE true END) AS kept FROM r GROUP BY 1",
)
def sk11_retained(spark, sf_dir):
    """A store of five classes, published, pruned, and published anew: what the next generation holds of each."""
    path = new_folder(spark, "store")
    published.publish(t.events(spark, sf_dir), path, 1)
    before, _ = published.read(spark, path)
    published.publish(retention.retained(before, "event_type", "ts", "event_id", RULES, ["transcripts"], NOW), path, 2)
    after, _ = published.read(spark, path)
    return retention.report(before, after, "event_type", RULES)


SESSION_SQL = f"""{t.OCC_SQL},
ses AS (SELECT 'h' || (o_orderkey % 3) AS source, (CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey // 20 * 20 ELSE o_orderkey END)::VARCHAR AS native, CASE WHEN o_custkey % 4 <> 0 THEN 'run-' || o_custkey END AS run, 'p' || (o_custkey % 7) AS project, 'r' || (o_orderkey % 5) AS repository,
  epoch_us(o_orderdate) * 1000 AS "start", CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) * 1000 + {DAY} END AS "end" FROM orders),
own AS (SELECT native, count(*) AS owners FROM ses GROUP BY 1),
use AS (SELECT l_orderkey::VARCHAR AS native, unnest(['input', 'output']) AS kind, unnest([input, CASE WHEN l_returnflag <> 'R' THEN output END]) AS tokens FROM occ),
per AS (SELECT native, kind, sum(tokens) AS tokens, coalesce(any_value(owners), 0) AS owners FROM use LEFT JOIN own USING (native) WHERE tokens IS NOT NULL GROUP BY 1, 2)"""


def stored_sessions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An order is a session, of a run of its customer; the native ids of every tenth order are shared by two. Line items are usage."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    start = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("start")
    sessions = t.table(spark, sf_dir, "orders").select(
        name("h", key % 3).alias("source"), F.when(key % 10 == 0, F.expr("o_orderkey div 20 * 20")).otherwise(key).cast("string").alias("native"),
        F.when(customer % 4 != 0, name("run-", customer)).alias("run"), name("p", customer % 7).alias("project"), name("r", key % 5).alias("repository"), start, F.when(F.col("o_orderstatus") != "O", start + DAY).alias("end"),
    )
    usage = t.occurrences(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("session"), "input", F.when(F.col("l_returnflag") != "R", F.col("output")).alias("output"))
    return sessions, usage


def _export_sql(key: str, ids: bool) -> str:
    k, where = ("source || ':' || native", "true") if key == "session" else ("run", "run IS NOT NULL")
    lists = [f"list_sort(list(DISTINCT {c}))" if ids else "[]::VARCHAR[]" for c in exports.LOGICAL_IDS]
    by = "source, native" if key == "session" else "run"
    q = "json_object('value', {}, 'unit', '{}')"
    return f"""WITH {SESSION_SQL},
h AS (SELECT {k} AS key, count(*) AS n, min("start") AS a, max("end") AS z, {lists[0]} AS project, {lists[1]} AS repository FROM ses WHERE {where} GROUP BY {k}, {by}),
u AS (SELECT key, '{{' || string_agg('"' || kind || '":' || {q.format("tokens::BIGINT", "tokens")}, ',' ORDER BY kind) || '}}' AS usage FROM (SELECT {k} AS key, kind, sum(tokens) AS tokens FROM ses JOIN per USING (native) WHERE {where} AND per.owners = 1 GROUP BY 1, 2) GROUP BY 1)
SELECT 0::INTEGER AS place, '' AS key, '{{"schema":1,"key":"{key}-id","ledger_generation":7,"ingestion_generation":3,"included_identifiers":{'["project","repository"]' if ids else "[]"},"unresolved_events":' || {q.format("count(*) FILTER (WHERE owners <> 1)", "events")} || ',"generated_at":{NOW}}}' AS line FROM per
UNION ALL SELECT 1, key, '{{"key":"' || key || '","sessions":' || {q.format("n", "sessions")} || ',"first_start":' || a || ',"last_end":' || coalesce(z::VARCHAR, 'null') || ',"usage":' || coalesce(usage, '{{}}') || ',"project":' || to_json(project) || ',"repository":' || to_json(repository) || '}}' FROM h LEFT JOIN u USING (key)"""


def _export(spark, sf_dir, key: str, ids: bool) -> DataFrame:
    rows, unresolved = exports.usage_export(*stored_sessions(spark, sf_dir), ["input", "output"], key, ids)
    return exports.export_lines(rows, unresolved, key, 7, 3, NOW, ids)


@query("SK-5_export_sessions", _export_sql("session", False))
def sk5_sessions(spark, sf_dir):
    return _export(spark, sf_dir, "session", False)


@query("SK-5_export_runs", _export_sql("run", True))
def sk5_runs(spark, sf_dir):
    return _export(spark, sf_dir, "run", True)


def _document_sql(report: str, generation: str, body: str) -> str:
    return f"""'{{"schema":5,"report":"{report}","run":"r1","generated_at":{NOW},"ledger_generation":' || ({generation}) || ',{body}}}'"""


@query(
    "SK-6_envelopes",
    f"""WITH {CAN_RUN_SQL}, {t.ATT_SQL},
st AS (SELECT account, arg_max(used_ppm, {{'t': ts, 'o': observation}}) AS used, count(*) AS n FROM meter GROUP BY 1),
sp AS (SELECT session, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM use GROUP BY 1),
cv AS (SELECT account, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS ok FROM att GROUP BY 1)
SELECT 'status' AS report, account AS id, {_document_sql("status", "n", '"account":' + "' || account || '" + ',"used":{"value":' + "' || coalesce(used::VARCHAR, 'null') || '" + ',"unit":"ppm"}')} AS document FROM st
UNION ALL SELECT 'spend', session, {_document_sql("spend", "n", '"session":' + "' || session || '" + ',"tokens":{"value":' + "' || coalesce(tokens::VARCHAR, 'null') || '" + ',"unit":"tokens"}')} FROM sp
UNION ALL SELECT 'coverage', account, {_document_sql("coverage", "n", '"account":' + "' || account || '" + ',"attempts":{"value":' + "' || n || '" + ',"unit":"attempts"},"successes":{"value":' + "' || ok || '" + ',"unit":"attempts"}')} FROM cv
UNION ALL SELECT 'can-run', account, {_document_sql("can-run", "0", '"account":' + "' || account || '" + ',"ready":' + "' || (len(missing) = 0) || '" + ',"missing":{"value":' + "' || len(missing) || '" + ',"unit":"facts"},"limiting":' + "' || CASE WHEN len(missing) = 0 AND l.win IS NOT NULL THEN to_json(l.win)::VARCHAR ELSE 'null' END || '")} FROM fx""",
)
def sk6_envelopes(spark, sf_dir):
    """Four reports, a document for each account or session."""
    document = lambda report, generation, *body: exports.envelope(report, "r1", NOW, generation, body).alias("document")
    q, n = lambda c, unit: exports.quantity(F.col(c), unit).alias(c), F.col("n")
    status = t.meter(spark, sf_dir).groupBy("account").agg(F.max_by("used_ppm", F.struct("ts", "observation")).alias("used"), F.count("*").alias("n"))
    spend = t.usage(spark, sf_dir).groupBy("session").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    cover = t.attempts(spark, sf_dir).groupBy("account").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "success").alias("successes"))
    run = sf28_can_run(spark, sf_dir).withColumnRenamed("request", "account").withColumn("ready", F.col("missing") == "").withColumn("missing", F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ","))))
    parts = [
        status.select(F.lit("status").alias("report"), F.col("account").alias("id"), document("status", n, F.col("account"), q("used", "ppm"))),
        spend.select(F.lit("spend"), "session", document("spend", n, F.col("session"), q("tokens", "tokens"))),
        cover.select(F.lit("coverage"), "account", document("coverage", F.col("attempts"), F.col("account"), q("attempts", "attempts"), q("successes", "attempts"))),
        run.select(F.lit("can-run"), "account", document("can-run", F.lit(0), F.col("account"), F.col("ready"), q("missing", "facts"), F.col("limiting"))),
    ]
    return reduce(DataFrame.union, parts)


@query(
    "SC-16_seed_import",
    f"""WITH {t.EV_SQL}, l AS (SELECT *, CASE k % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'other' END AS vendor, ts // {HOUR} * {HOUR} AS hr FROM ev),
r AS (SELECT event_id AS line, CASE WHEN k % 17 = 0 THEN NULL ELSE vendor END AS vendor, hr, CASE WHEN event_type <> 'error' THEN k * 10000 END AS used, CASE WHEN k % 17 = 0 THEN 'invalid_json' WHEN event_type = 'error' AND vendor IS NULL THEN 'invalid_account' WHEN event_type <> 'error' AND vendor IS NULL THEN 'missing_provider_name' END AS reason FROM l),
m AS (SELECT r.line, CASE WHEN reason IS NULL THEN vendor END AS vendor, hr, used, reason, CASE WHEN reason IS NULL THEN CASE vendor WHEN 'claude' THEN 'a-claude' WHEN 'codex' THEN 'a-codex' END END AS account FROM r),
d AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN account IS NULL THEN 'discarded_unmapped_vendor' WHEN account = 'a-claude' AND hr >= {NOW} THEN 'superseded_by_native' END AS refused FROM m),
g AS (SELECT *, row_number() OVER w AS nth, last_value(used IGNORE NULLS) OVER (PARTITION BY account, hr ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM d WHERE refused IS NULL WINDOW w AS (PARTITION BY account, hr ORDER BY line)),
x AS (SELECT line, vendor, account, hr, reason, CASE WHEN nth = 1 AND hr % {7 * HOUR} <> 0 THEN 'imported' WHEN used IS NOT NULL AND used <> coalesce(held, CASE WHEN hr % {7 * HOUR} = 0 THEN 990000 END) THEN 'reinterpreted' ELSE 'unchanged' END AS disposition FROM g UNION ALL SELECT line, vendor, account, hr, reason, refused FROM d WHERE refused IS NOT NULL)
SELECT line, vendor, account, disposition, reason, coalesce(vendor = 'codex' AND hr >= {NOW - 10 * DAY} AND disposition IN ('imported', 'reinterpreted'), false) AS asserted FROM x""",
)
def sc16_seed(spark, sf_dir):
    """Readings and failures of three vendors, one of them mapped to no account; some instants were imported before, and one account has attempts of its own from a moment on."""
    e, k = t.events(spark, sf_dir), F.col("k")
    vendor = F.when(k % 4 == 0, "Anthropic").when(k % 4 == 1, "codex").when(k % 4 == 2, "other")
    at = F.expr(f"ts div {HOUR} * {HOUR}")
    window = F.struct(F.lit("five_hour").alias("id"), k.alias("percentUsed"))
    reading = F.struct(F.array(F.struct(vendor.alias("provider"), F.array(window).alias("windows"))).alias("providers"))
    failed = F.col("event_type") == "error"
    record = F.to_json(F.struct(format_rfc3339(at).alias("received_at"), F.when(vendor == "Anthropic", "claude").otherwise(vendor).alias("account"), F.when(~failed, reading).alias("reading"), F.when(failed, F.lit("empty_output")).alias("failure")))
    lines = e.select(F.lit("seed").alias("file"), F.col("event_id").alias("line"), F.when(k % 17 == 0, F.lit("{cut")).otherwise(record).alias("text"))
    names = spark.createDataFrame([("claude", "a-claude"), ("codex", "a-codex")], "vendor string, account string")
    native = spark.createDataFrame([("a-claude", NOW)], "account string, since bigint")
    before = F.array(F.struct(F.lit("five_hour").alias("window"), F.lit(990_000).cast("bigint").alias("used_ppm"), F.lit(None).cast("bigint").alias("reset_at")))
    stored = e.select(at.alias("ts")).where(F.col("ts") % (7 * HOUR) == 0).distinct().select(F.explode(F.array(F.lit("a-claude"), F.lit("a-codex"))).alias("account"), "ts", before.alias("windows"))
    out = imports.seed_import(imports.seed_records(lines), names, native, stored, {"codex": NOW - 10 * DAY})
    return out.select("line", "vendor", "account", "disposition", "reason", "asserted")


@query(
    "SC-16_legacy_calibrations",
    """WITH p AS (SELECT p_partkey, p_size, p_brand, p_partkey % 8 AS shape FROM part),
s AS (SELECT p_partkey AS file, shape, p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || p_partkey END AS id, CASE shape WHEN 0 THEN 'quarantined' WHEN 1 THEN 'refused' WHEN 2 THEN 'empty' WHEN 3 THEN 'quarantined' WHEN 4 THEN 'refused' ELSE 'imported' END AS state, p_size * 1000 AS micros,
  CASE WHEN shape = 7 AND p_partkey % 3 <> 0 THEN 'unchanged' END AS known FROM p),
d AS (SELECT *, CASE shape WHEN 0 THEN 'cut' WHEN 2 THEN '' WHEN 3 THEN id || '/0' ELSE id || '/' || least(shape, 5) || '/' || micros END AS digest FROM s),
r AS (SELECT *, CASE WHEN state <> 'refused' AND (known IS NOT NULL OR row_number() OVER (PARTITION BY digest ORDER BY file) > 1) THEN 'unchanged' ELSE state END AS disposition FROM d)
SELECT file, disposition, CASE WHEN disposition = 'imported' THEN id END AS calibration_id, CASE WHEN disposition = 'imported' THEN micros END AS micros_per_point, disposition = 'imported' AND row_number() OVER (PARTITION BY disposition, id ORDER BY file) = 1 AS history FROM r""",
)
def sc16_calibrations(spark, sf_dir):
    """A document for each part: cut ones, empty ones, ones without evidence, ones whose coefficient isn't positive, ones known already."""
    n, shape = F.col("p_partkey"), F.col("p_partkey") % 8
    name = F.concat("p_brand", F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), n.cast("string"))))
    form = "legacy-calibration-v1"
    evidence = F.array(F.when(shape == 4, F.lit(" ")).otherwise(F.lit("e1")))
    experiment = F.when(shape != 1, F.struct(F.lit("x").alias("experiment_id"), evidence.alias("evidence_ids")))
    fit = F.to_json(F.struct(
        F.lit(form).alias("format"), name.alias("calibration_id"), F.lit("prov").alias("provider"), F.lit("pro").alias("plan_tier"), F.lit("five_hour").alias("window"), F.when(shape == 3, 0).otherwise(F.col("p_size") * 1000).alias("fitted_micros_per_point"),
        F.lit("2024-01-01T00:00:00Z").alias("fit_timestamp"), F.struct(F.lit("fit").alias("origin")).alias("provenance"), experiment.alias("experiment"),
    ))
    documents = t.table(spark, sf_dir, "part").select(n.alias("file"), F.when(shape == 0, F.lit("{cut")).when(shape == 2, F.lit(" ")).otherwise(fit).alias("text"))
    known = documents.where((F.col("file") % 8 == 7) & (F.col("file") % 3 != 0)).select(F.sha2("text", 256).alias("digest"))
    return imports.legacy_calibrations(documents, known, form).select("file", "disposition", "calibration_id", "micros_per_point", "history")


WINDOW_SQL = f"""wd AS (SELECT account, observation % 3 AS slot, max(observation) AS id, arg_max(used_ppm, observation) AS used FROM meter GROUP BY 1, 2),
wn AS (SELECT account, 'w' || slot AS win, CASE id % 7 WHEN 0 THEN 'suspect' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'current' END AS health, CASE id % 14 WHEN 1 THEN 'current' WHEN 2 THEN 'review_due' END AS kinds, CASE WHEN id % 2 = 0 THEN 400000 END AS est, id % 5 = 0 AS gap FROM wd),
wb AS (SELECT *, CASE WHEN health = 'current' THEN 'calibration' WHEN health IS NULL AND kinds IS NULL AND est IS NOT NULL AND NOT gap THEN 'estimate' END AS basis,
  CASE WHEN health IS NOT NULL THEN 'calibration_' || health WHEN kinds = 'current' THEN 'calibration_per_kind' WHEN kinds IS NOT NULL THEN 'calibration_' || kinds WHEN gap THEN 'no_rate_input,no_rate_output' ELSE 'no_calibration' END AS why FROM wn)"""


def judged_windows(spark, sf_dir) -> DataFrame:
    one = F.col("id")
    newest = t.meter(spark, sf_dir).groupBy("account", (F.col("observation") % 3).alias("slot")).agg(F.max("observation").alias("id"), F.max_by("used_ppm", "observation").alias("used"))
    estimate = F.when(one % 2 == 0, 400_000)
    windows = newest.select(
        "account", F.concat(F.lit("w"), F.col("slot").cast("string")).alias("window"), F.when(one % 7 == 0, "suspect").when(~(one % 7).isin(1, 2), "current").alias("health"), F.when(one % 14 == 1, "current").when(one % 14 == 2, "review_due").alias("kinds_health"),
        F.when(one % 5 == 0, F.array(F.lit("no_rate_output"), F.lit("no_rate_input"))).alias("gaps"), F.lit(300_000).alias("lo"), F.lit(500_000).alias("hi"), estimate.alias("estimate_lo"), estimate.alias("estimate_hi"),
    )
    return canrun.window_basis(windows)


@query("SF-28_window_basis", f"WITH {t.EV_SQL}, {t.METER_SQL}, {WINDOW_SQL} SELECT account, win AS \"window\", basis, CASE WHEN basis IS NULL THEN why ELSE '' END AS reasons, CASE basis WHEN 'calibration' THEN 300000 WHEN 'estimate' THEN est END AS lo, CASE basis WHEN 'calibration' THEN 500000 WHEN 'estimate' THEN est END AS hi FROM wb")
def sf28_basis(spark, sf_dir):
    return judged_windows(spark, sf_dir).select("account", "window", "basis", F.array_join("reasons", ",").alias("reasons"), "lo", "hi")


CHECKS_SQL = f"""WITH RECURSIVE {A_SQL}, {t.METER_SQL}, {CHAIN_SQL}, {WINDOW_SQL}, {ACCOUNT_SQL.split(t.EV_SQL + ", ")[1]},
mr AS (SELECT *, (ts // {DAY} + 1) * {DAY} AS reset_at FROM meter),
p AS (SELECT *, lag(used_ppm) OVER w AS ou, lag(reset_at) OVER w AS o FROM mr WINDOW w AS (PARTITION BY account ORDER BY ts)),
an AS (SELECT account, ts, CASE WHEN ou IS NULL THEN false WHEN used_ppm < ou AND NOT (abs(reset_at - o) >= 2000000000 AND ts >= o - 2000000000 AND reset_at >= o + 2000000000) THEN true ELSE used_ppm >= ou AND abs(reset_at - o) >= 2000000000 AND NOT (ts >= o - 2000000000 AND reset_at >= o + 2000000000) END AS bad FROM p),
tf AS (SELECT account, max(ts) AS last, coalesce(min(nth) FILTER (WHERE outcome <> 'auth_required'), count(*) + 1) - 1 AS failures FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, attempt DESC) AS nth FROM att) WHERE nth <= 64 GROUP BY 1),
ids AS (SELECT account, arg_max(context IS DISTINCT FROM known AND known IS NOT NULL, {{'t': ts, 'a': attempt}}) AS changed FROM (SELECT *, last_value(context IGNORE NULLS) OVER (PARTITION BY account ORDER BY ts, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM att) WHERE context IS NOT NULL GROUP BY 1),
sc AS (SELECT scope, bool_or(accepted) AS active FROM chain GROUP BY 1),
f AS (
SELECT 'meter_error_classifications' AS name, 'fail' AS severity, outcome <> 'success' AS bad, outcome AS label FROM att WHERE ts > {NOW - DAY} AND ts <= {NOW}
UNION ALL SELECT 'interrupted_attempts', 'note', outcome = 'interrupted', account::VARCHAR FROM att
UNION ALL SELECT 'sampling_failure_counts', 'fail', outcome = 'unreachable', account::VARCHAR FROM att WHERE ts > {NOW - DAY} AND ts <= {NOW}
UNION ALL SELECT 'sampling_cadence', 'fail', last < {NOW - 6 * HOUR}, account::VARCHAR FROM tf
UNION ALL SELECT 'account_in_auth_backoff', 'warn', failures >= 2, account::VARCHAR FROM tf
UNION ALL SELECT 'subscription_identity_change', 'fail', changed, account::VARCHAR FROM ids
UNION ALL SELECT 'meter_anomalies', 'fail', ts > {NOW - DAY} AND ts <= {NOW}, account::VARCHAR FROM an WHERE bad
UNION ALL SELECT 'clock_skew', 'fail', ts > {NOW + 300 * SECOND}, account::VARCHAR FROM an WHERE ts > {NOW - DAY}
UNION ALL SELECT 'missing_active_calibrations', 'fail', health <> 'current', account || '/' || win FROM wb WHERE health IS NOT NULL
UNION ALL SELECT 'window_estimate_in_use', 'warn', basis = 'estimate', account || '/' || win FROM wb
UNION ALL SELECT 'cost_model_active', 'warn', NOT active, scope::VARCHAR FROM sc
UNION ALL SELECT 'stale_rate_cards', 'fail', DATE '2024-01-01' + (p_partkey * 37 % 900)::INTEGER < DATE '2024-03-01', p_brand FROM part
UNION ALL SELECT 'parser_failures', 'fail', NOT json_valid(props), event_id::VARCHAR FROM events
UNION ALL SELECT 'unmapped_accounts', 'fail', account = 'unknown-account', session::VARCHAR FROM acc),
g AS (SELECT name, severity, count(*) FILTER (WHERE bad) AS found, count(*) AS about, list(DISTINCT label) FILTER (WHERE bad) AS labels FROM f GROUP BY 1, 2)
SELECT name, CASE WHEN found = 0 THEN 'pass' ELSE severity END AS status, found, about, coalesce(array_to_string(list_sort(labels)[1:5], ','), '') AS sample FROM g"""


@query("DR-1_checks", CHECKS_SQL)
def dr1_checks(spark, sf_dir):
    """Fourteen checks over eight relations, one pass over each; recent is the last day."""
    c, check = F.col, doctor.Finding
    att = t.attempts(spark, sf_dir)
    recent, who = c("ts").between(NOW - DAY + 1, NOW), c("account")
    per = meter.trailing_failures(att).join(att.groupBy("account").agg(F.max("ts").alias("last")), "account")
    before = Window.partitionBy("account").orderBy("ts", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    identity = att.withColumn("known", F.last("context", True).over(before)).where("context is not null").groupBy("account").agg(F.max_by(c("known").isNotNull() & (c("known") != c("context")), F.struct("ts", "attempt")).alias("changed"))
    readings = meter.transitions(observations(spark, sf_dir))
    scopes = activation.activations(chained(spark, sf_dir), ["scope"]).groupBy("scope").agg(F.bool_or("accepted").alias("active"))
    window = F.concat_ws("/", c("account").cast("string"), "window")
    review = F.date_add(F.lit("2024-01-01").cast("date"), (c("p_partkey") * 37 % 900).cast("int"))
    panels = [
        (att, {"meter_error_classifications": check(c("outcome") != "success", c("outcome"), recent), "interrupted_attempts": check(c("outcome") == "interrupted", who, severity="note"), "sampling_failure_counts": check(c("outcome") == "unreachable", who, recent)}),
        (per, {"sampling_cadence": check(c("last") < NOW - 6 * HOUR, who), "account_in_auth_backoff": check(c("failures") >= 2, who, severity="warn")}),
        (identity, {"subscription_identity_change": check(c("changed"), who)}),
        (readings, {"meter_anomalies": check(recent, who, c("anomaly").isin("decrease", "unexpected_reset")), "clock_skew": check(c("ts") > NOW + 300 * SECOND, who, c("ts") > NOW - DAY)}),
        (judged_windows(spark, sf_dir), {"missing_active_calibrations": check(c("health") != "current", window, c("health").isNotNull()), "window_estimate_in_use": check(c("basis") == "estimate", window, severity="warn")}),
        (scopes, {"cost_model_active": check(~c("active"), c("scope"), severity="warn")}),
        (t.table(spark, sf_dir, "part"), {"stale_rate_cards": check(review < F.lit("2024-03-01").cast("date"), c("p_brand"))}),
        (t.table(spark, sf_dir, "events"), {"parser_failures": check(F.try_parse_json("props").isNull(), c("event_id"))}),
        (accounts(spark, sf_dir), {"unmapped_accounts": check(c("account") == "unknown-account", c("session"))}),
    ]
    out = reduce(DataFrame.unionByName, [doctor.panel(rows, checks) for rows, checks in panels])
    return out.withColumn("sample", F.array_join("sample", ","))


@query(
    "SF-5_skewed_age",
    f"""WITH {t.EV_SQL}, r AS (SELECT event_id, ts AS received, CASE WHEN k % 5 <> 0 THEN ts + (k - 60) * {10 * SECOND} END AS provider, CASE k % 3 WHEN 0 THEN 'provider_observed' WHEN 1 THEN 'locally_received' ELSE 'older_of_the_two' END AS basis FROM ev),
m AS (SELECT *, CASE basis WHEN 'provider_observed' THEN coalesce(provider, received) WHEN 'older_of_the_two' THEN least(provider, received) ELSE received END AS measured FROM r),
a AS (SELECT *, CASE WHEN provider - received > {120 * SECOND} THEN 'provider_ahead' WHEN measured > {NOW} THEN 'future' END AS anomaly FROM m)
SELECT event_id, CASE WHEN anomaly IS NULL THEN {NOW} - measured END AS age, anomaly FROM a""",
)
def sf5_skewed(spark, sf_dir):
    k, ts = F.col("k"), F.col("ts")
    provider = F.when(k % 5 != 0, ts + (k - 60) * (10 * SECOND))
    basis = F.when(k % 3 == 0, "provider_observed").when(k % 3 == 1, "locally_received").otherwise("older_of_the_two")
    age, anomaly = meter.reading_age(provider, ts, basis, NOW, 120 * SECOND)
    return t.events(spark, sf_dir).select("event_id", age.alias("age"), anomaly.alias("anomaly"))


@query(
    "SF-20_experiments",
    f"""WITH {t.EV_SQL}, {t.METER_SQL},
x AS (SELECT event_id AS experiment, user_id AS account, k % 10 AS own, ts - {2 * DAY} AS plateau, ts AS started, ts + {6 * DAY} AS evaluated, CASE WHEN k % 5 <> 0 THEN ts + {DAY} END AS ended, k * 1000 AS a, amount * 10 AS z, amount % 3 AS credits FROM ev WHERE event_type = 'purchase' AND k < 30),
e AS (SELECT *, coalesce(ended, evaluated) AS work_end FROM x),
p AS (SELECT experiment, CASE WHEN count(*) >= 2 THEN max(used_ppm) - min(used_ppm) END AS pre_ppm FROM e JOIN meter m ON m.account = e.account AND m.ts BETWEEN plateau AND started GROUP BY 1),
q AS (SELECT experiment, CASE WHEN count(*) >= 2 THEN max(used_ppm) - min(used_ppm) END AS post_ppm FROM e JOIN meter m ON m.account = e.account AND m.ts > work_end + {HOUR} AND m.ts <= evaluated GROUP BY 1),
s AS (SELECT experiment, count(DISTINCT k % 10) AS sessions FROM e JOIN ev ON user_id = e.account AND event_type = 'signup' AND ev.ts BETWEEN started AND work_end AND k % 10 <> own GROUP BY 1),
f AS (SELECT experiment, pre_ppm, post_ppm, abs(z - a) AS meter_ppm, coalesce(sessions, 0) AS sessions, credits FROM e LEFT JOIN p USING (experiment) LEFT JOIN q USING (experiment) LEFT JOIN s USING (experiment))
SELECT experiment, concat_ws(',', CASE WHEN pre_ppm > 20000 THEN 'pre_burn_idle_movement' END, CASE WHEN post_ppm > 20000 THEN 'extended_settlement_drift' END, CASE WHEN meter_ppm >= 20000 AND credits <= 0 THEN 'flat_credits_with_meter_movement' END, CASE WHEN sessions > 0 THEN 'overlapping_session' END) AS signals, pre_ppm, post_ppm, meter_ppm, sessions FROM f""",
)
def sf20_experiments(spark, sf_dir):
    """A purchase starts an experiment on its user's account after two idle days; its own session is a remainder of k."""
    e, k = t.events(spark, sf_dir), F.col("k")
    experiments = e.where("event_type = 'purchase' and k < 30").select(
        F.col("event_id").alias("experiment"), F.col("user_id").alias("account"), (k % 10).alias("session"), (F.col("ts") - 2 * DAY).alias("plateau"), F.col("ts").alias("started"), F.when(k % 5 != 0, F.col("ts") + DAY).alias("ended"), (F.col("ts") + 6 * DAY).alias("evaluated"),
        (k * 1000).alias("meter_start"), (F.col("amount") * 10).alias("meter_end"), (F.col("amount") % 3).alias("credits"), F.lit(20_000).alias("pre_most"), F.lit(20_000).alias("post_most"), F.lit(HOUR).alias("grace"), F.lit(20_000).alias("meter_least"), F.lit(0).alias("credits_most"),
    )
    markers = e.where("event_type = 'signup'").select((k % 10).alias("session"), F.col("user_id").alias("account"), "ts")
    out = calibration.experiment_contamination(experiments, t.meter(spark, sf_dir).select("account", "ts", "used_ppm"), markers, DAY)
    return out.withColumn("signals", F.array_join("signals", ","))
