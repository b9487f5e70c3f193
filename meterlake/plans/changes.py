"""Queries over what comes in and changes: resumed reads, batches, increments, publications, sets of windows, overlapping sessions, prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution, batches, meter, records
from ..sources import published, ranges, transcripts
from ..sources import tables as t
from ..sources.staging import new_folder
from ..streaming import ledger
from .records import written_lines
from .registry import query

DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
E_SQL = f"WITH RECURSIVE {t.EV_SQL}"
M_SQL = f"WITH {t.EV_SQL}, {t.METER_SQL}"
FILES = "path string, identity string, size bigint, mtime bigint"


@query(
    "SC-10_resume",
    f"""{E_SQL}, n AS (SELECT 'part=' || (user_id % 5) AS folder, event_id, length('line ' || event_id) + 1 AS bytes FROM ev),
p AS (SELECT *, sum(bytes) OVER w AS until, sum(bytes) OVER w - bytes AS begins, sum(bytes) OVER (PARTITION BY folder) AS size, row_number() OVER w AS line, count(*) OVER (PARTITION BY folder) AS lines FROM n WINDOW w AS (PARTITION BY folder ORDER BY event_id))
SELECT folder, CASE WHEN until <= size // 2 THEN 1 ELSE 2 END::INTEGER AS pass, begins::BIGINT AS begins, 'line ' || event_id AS text FROM p WHERE line < lines""",
)
def sc10_resume(spark, sf_dir):
    """Files read while half of their bytes are there, then from where that stopped; ranges of 4,096 bytes."""
    now = transcripts.discover(spark, written_lines(spark, sf_dir, "resume"), "*.txt")
    now = now.select(F.col("file").alias("path"), F.col("file").alias("identity"), "size", F.unix_micros("modified").alias("mtime"))
    half = now.withColumn("size", F.expr("size div 2")).withColumn("mtime", F.col("mtime") - 1)
    marks = spark.createDataFrame([], f"{FILES}, parser_version int, offset bigint")
    out = None
    for number, files in enumerate((half, now), 1):
        wanted = ranges.ranges(files, marks, 1, width=4096)
        lines = ranges.read_ranges(wanted)
        marks = ranges.advanced(files, marks, wanted, lines, 1)
        part = lines.select(F.regexp_extract("file", r"(part=\d)", 1).alias("folder"), F.lit(number).alias("pass"), F.col("at").alias("begins"), "text")
        out = part if out is None else out.union(part)
    return out


@query(
    "SK-3_greedy_batches",
    f"""{E_SQL}, n AS (SELECT user_id AS file, count(*) AS events FROM ev GROUP BY 1),
f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY file) AS k, sum(events) OVER (ORDER BY file) - events AS a, sum(events) OVER (ORDER BY file) AS b FROM n),
s AS (SELECT 0::HUGEINT AS p, 0 AS batch UNION ALL
  SELECT least(p + 100, coalesce((SELECT g.a FROM f g WHERE g.k = f.k + 4), (SELECT max(b) FROM f))), batch + 1 FROM s JOIN f ON p >= f.a AND p < f.b
  WHERE least(p + 100, coalesce((SELECT g.a FROM f g WHERE g.k = f.k + 4), (SELECT max(b) FROM f))) < (SELECT max(b) FROM f)),
e AS (SELECT batch, p, coalesce(lead(p) OVER (ORDER BY batch), (SELECT max(b) FROM f)) AS q FROM s)
SELECT batch::BIGINT AS batch, p::BIGINT AS start, (q - p)::BIGINT AS events, (y.k - x.k + 1)::BIGINT AS files, x.file AS first_file, y.file AS last_file FROM e JOIN f x ON p >= x.a AND p < x.b JOIN f y ON q - 1 >= y.a AND q - 1 < y.b""",
)
def sk3_greedy(spark, sf_dir):
    """A user's events are a file; no batch has more than 100 events or four files."""
    files = t.events(spark, sf_dir).groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("events"))
    return batches.greedy_batches(files, "file", 100, 4, block=512)


@query("SK-4_projection", f"{M_SQL} SELECT account, max(ts) AS ts, arg_max(used_ppm, {{'t': ts, 'o': observation}}) AS used_ppm FROM meter GROUP BY account")
def sk4(spark, sf_dir):
    """The latest reading of each account, published in three steps, each made of the published state and the readings since, and read back."""
    path = new_folder(spark, "projection")
    rows = t.meter(spark, sf_dir).withColumn("generation", F.expr(f"ts div {DAY}"))
    lo, hi = rows.agg(F.min("generation"), F.max("generation")).first()
    if lo is None:
        return rows.select("account", "ts", "used_ppm")
    cuts = [lo - 1, lo + (hi - lo) // 3, lo + 2 * (hi - lo) // 3, hi]
    for a, b in zip(cuts, cuts[1:], strict=False):
        new = rows.where((F.col("generation") > a) & (F.col("generation") <= b))
        try:
            held, _ = published.read(spark, path)
            new = held.select(*rows.columns).unionByName(new)
        except published.Unavailable:
            pass
        records.publish(new, path, ["account"], ["ts", "observation"])
    return published.read(spark, path)[0].select("account", "ts", "used_ppm")


@query(
    "SK-12_counters",
    f"{E_SQL} SELECT 4::BIGINT AS ingest, 1::BIGINT AS ledger, count(DISTINCT user_id) AS messages, (SELECT sum(x)::BIGINT FROM (SELECT max(amount) AS x FROM ev WHERE event_type = 'click' GROUP BY user_id)) AS output FROM ev WHERE event_type = 'click'",
)
def sk12_counters(spark, sf_dir):
    """Clicks added to a ledger in four batches, the second twice, merged once in between; both counters beside what the ledger holds."""
    rows = t.events(spark, sf_dir, "click").select(F.col("user_id").cast("string").alias("native_id"), "k", F.col("k").alias("input"), F.col("amount").alias("output"), F.lit(0).cast("bigint").alias("cache_read"), F.lit(0).cast("bigint").alias("cache_write"), "ts")
    held = ledger.Ledger(spark, new_folder(spark, "ledger"), buckets=8)
    for i in range(3):
        held.add(rows.where(F.col("k") % 4 == i).drop("k"), "query", i)
    held.compact(2)
    for i in (1, 3):
        held.add(rows.where(F.col("k") % 4 == i).drop("k"), "query", i)
    n = published.counters(spark, held.root)
    return held.read().agg(F.lit(n["ingest"]).cast("bigint").alias("ingest"), F.lit(n["ledger"]).cast("bigint").alias("ledger"), F.count("*").alias("messages"), F.sum("output").alias("output"))


@query(
    "JN-14_overlap_pairs",
    f"""{E_SQL}, s AS (SELECT user_id AS account, event_id AS session, ts AS a, CASE WHEN k % 23 <> 0 THEN ts + (k % 200) * {12 * HOUR} END AS b FROM ev WHERE event_type = 'purchase')
SELECT x.account, x.session AS earlier, y.session AS later, CASE WHEN x.b IS NULL OR x.b >= y.b THEN 'contains' ELSE 'runs_into' END AS relation
FROM s x JOIN s y ON x.account = y.account AND (x.a < y.a OR x.a = y.a AND x.session < y.session) AND (x.b IS NULL OR x.b >= y.a)""",
)
def jn14_pairs(spark, sf_dir):
    k = F.col("k")
    sessions = t.events(spark, sf_dir, "purchase").select(F.col("user_id").alias("account"), F.col("event_id").alias("session"), F.col("ts").alias("a"), F.when(k % 23 != 0, F.col("ts") + (k % 200) * (12 * HOUR)).alias("b"))
    return attribution.overlapping_pairs(sessions, DAY, ["account"])


@query(
    "JN-19_prefixes",
    """WITH s AS (SELECT 'n' || (c_nationkey % 3) AS source, c_name AS session, c_custkey % 97 AS start FROM customer),
p AS (SELECT DISTINCT CASE WHEN c_custkey % 30 = 0 THEN '  ' ELSE ' ' || upper(left(c_name, 13 + (c_custkey % 6)::INTEGER)) END AS prefix, CASE WHEN c_custkey % 4 = 0 THEN 'n' || (c_custkey % 5) END AS namespace FROM customer WHERE c_custkey % 10 = 0),
m AS (SELECT p.*, s.* FROM p LEFT JOIN s ON trim(prefix) <> '' AND starts_with(lower(session), lower(trim(prefix))) AND (namespace IS NULL OR namespace = source)),
c AS (SELECT *, count(session) OVER w AS matches, row_number() OVER (PARTITION BY prefix, namespace ORDER BY start, source, session) AS nth FROM m WINDOW w AS (PARTITION BY prefix, namespace))
SELECT prefix, namespace, CASE WHEN trim(prefix) = '' THEN 'empty_prefix' WHEN matches = 0 THEN 'none' WHEN matches = 1 THEN 'one' ELSE 'ambiguous' END AS status, matches, CASE WHEN matches > 0 THEN nth END AS place, source, session, start FROM c""",
)
def jn19_prefixes(spark, sf_dir):
    c, key = t.table(spark, sf_dir, "customer"), F.col("c_custkey")
    n = lambda x: F.concat(F.lit("n"), x.cast("string"))
    sessions = c.select(n(F.col("c_nationkey") % 3).alias("source"), F.col("c_name").alias("session"), (key % 97).alias("start"))
    prefix = F.when(key % 30 == 0, "  ").otherwise(F.concat(F.lit(" "), F.upper(F.substring(F.col("c_name"), F.lit(1), (13 + key % 6).cast("int")))))
    return attribution.sessions_by_prefix(c.where(key % 10 == 0).select(prefix.alias("prefix"), F.when(key % 4 == 0, n(key % 5)).alias("namespace")), sessions)


SETS_SQL = f"""{E_SQL}, o AS (SELECT user_id AS account, event_id AS observation, ts - CASE WHEN k % 41 = 0 THEN {400 * DAY} ELSE 0 END AS moment, 'plan' || (k // 90) AS plan, CASE WHEN k % 31 = 0 THEN 't' END AS tier, k, amount FROM ev WHERE event_type = 'view'),
w AS (SELECT account, observation, 'w' || j AS key, ['account', 'model', 'group', 'model'][j + 1] AS scope, CASE WHEN j > 0 THEN 'm' || j END AS name, (amount * (j + 3)) % 1000001 AS used_ppm, CASE WHEN (k + j) % 7 = 0 THEN 'not_started' WHEN j = 3 AND k % 9 = 0 THEN 'scheduled' ELSE 'known' END AS reset,
  (moment // {5 * DAY} + 1) * {5 * DAY} + CASE WHEN k % 13 = 0 THEN {DAY} ELSE 0 END AS reset_at, CASE WHEN k % 3 = 0 THEN {3 * HOUR} END AS precision FROM o, range(4) r(j) WHERE (k + j) % 5 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY observation) AS n FROM o),
c AS (SELECT n.account, n.n, n.observation, n.moment, n.plan, n.tier, w.* EXCLUDE (account, observation) FROM n JOIN w USING (account, observation) WHERE scope <> 'group'),
j AS (SELECT coalesce(c.account, p.account) AS account, coalesce(c.n, p.n + 1) AS n, coalesce(c.key, p.key) AS key, coalesce(c.scope, p.scope) AS scope, coalesce(c.name, p.name) AS name, c.key IS NULL AS gone, p.key IS NULL AS fresh, c.used_ppm AS u, p.used_ppm AS ou,
  CASE WHEN c.reset <> 'not_started' THEN c.reset_at END AS r, CASE WHEN p.reset <> 'not_started' THEN p.reset_at END AS pr, c.reset AS rk, p.reset AS prk, c.precision AS pc, p.precision AS pp
  FROM c FULL JOIN c p ON p.account = c.account AND p.n + 1 = c.n AND p.key = c.key AND p.scope = c.scope AND p.name IS NOT DISTINCT FROM c.name),
f AS (SELECT j.*, a.observation, b.observation AS previous, a.moment, b.moment AS earlier, a.plan = b.plan AND a.tier IS NOT DISTINCT FROM b.tier AND a.moment >= b.moment AS judged,
  CASE WHEN pc = pp THEN greatest(2000000000, pc + a.moment - b.moment) ELSE 2000000000 END AS tol FROM j JOIN n a ON a.account = j.account AND a.n = j.n JOIN n b ON b.account = j.account AND b.n = j.n - 1),
g AS (SELECT *, (r IS NULL) <> (pr IS NULL) AS one, (r IS NULL) <> (pr IS NULL) OR coalesce(abs(r - pr) >= tol, false) AS changed, coalesce(moment >= pr - 2000000000, false) AS due FROM f),
h AS (SELECT *, changed AND due AND (one OR coalesce(r >= pr + 2000000000, false)) AS legit FROM g)
SELECT account, observation, previous, key, scope, name, CASE WHEN fresh THEN CASE scope WHEN 'account' THEN 'new_account_wide_window' END WHEN gone THEN CASE scope WHEN 'model' THEN 'missing_model_specific_window' END
  WHEN judged AND u < ou AND NOT legit THEN 'percentage_decrease_without_reset'
  WHEN judged AND u >= ou AND changed AND NOT legit AND rk <> 'scheduled' AND prk <> 'scheduled' AND NOT coalesce(prk = 'not_started' AND rk = 'known' AND r <= moment + {5 * DAY} + tol, false) THEN 'unexpected_reset_timestamp_change' END AS change FROM h"""


@query("WN-2_window_sets", f"SELECT * FROM ({SETS_SQL}) WHERE change IS NOT NULL")
def wn2_sets(spark, sf_dir):
    """Up to four windows to an observation, of an account, two models and a group, that come and go."""
    k, j = F.col("k"), F.col("j")
    seen = t.events(spark, sf_dir, "view").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("observation"), (F.col("ts") - F.when(k % 41 == 0, 400 * DAY).otherwise(0)).alias("at"),
        F.concat(F.lit("plan"), F.expr("k div 90").cast("string")).alias("plan"), F.when(k % 31 == 0, "t").alias("tier"), "k", "amount",
    )
    each = seen.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).where((k + j) % 5 != 0)
    reset = F.when((k + j) % 7 == 0, "not_started").when((j == 3) & (k % 9 == 0), "scheduled").otherwise("known")
    windows = each.select(
        "account", "observation", F.concat(F.lit("w"), j.cast("string")).alias("key"), F.when(j == 0, "account").when(j == 2, "group").otherwise("model").alias("scope"), F.when(j > 0, F.concat(F.lit("m"), j.cast("string"))).alias("name"),
        F.pmod(F.col("amount") * (j + 3), F.lit(1_000_001)).alias("used_ppm"), reset.alias("reset"), ((F.expr(f"at div {5 * DAY}") + 1) * (5 * DAY) + F.when(k % 13 == 0, DAY).otherwise(0)).alias("reset_at"),
        F.lit(5 * DAY).alias("nominal"), F.when(k % 3 == 0, 3 * HOUR).alias("precision"),
    )
    return meter.window_changes(seen.drop("k", "amount"), windows)
