"""Queries over transcripts, quota bodies and importers: lines are written from the tables and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND, format_rfc3339
from ..operators import records
from ..sources import databases, quotas, transcripts
from ..sources import tables as t
from ..sources.staging import new_folder, staged
from .meters import DAY, M_SQL
from .registry import query

FULL = {"ignoreNullFields": "true"}
E_SQL = f"WITH {t.EV_SQL}"


def _json(**columns):
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]), FULL)


def _where(condition, column):
    return F.when(condition, column)


def claude_lines(spark, sf_dir):
    """A message for each event of a user's file: some without output, some with the breakdown of cache writes only, some with an input of the wrong type, some cut off."""
    e = t.events(spark, sf_dir)
    k = F.col("k") % 6
    usage = F.struct(
        F.when(k != 3, F.col("amount")).alias("input_tokens"), F.when(k != 1, F.col("k")).alias("output_tokens"), (F.col("k") * 2).alias("cache_read_input_tokens"), F.when(k != 2, F.col("k") + 5).alias("cache_creation_input_tokens"),
        F.struct(F.col("k").alias("ephemeral_5m_input_tokens"), F.lit(7).alias("ephemeral_1h_input_tokens")).alias("cache_creation"), F.when(k == 4, F.lit(-1)).alias("server_tool_use"), F.when(k == 0, F.lit(9)).alias("odd_tokens"),
    )
    text = _json(timestamp=format_rfc3339(F.col("ts")), sessionId=F.concat(F.lit("u"), F.col("user_id").cast("string")), cwd=F.lit("/w"), message=F.struct(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.lit("claude-x").alias("model"), usage.alias("usage")))
    return e.select(F.concat(F.lit("claude/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("event_id").cast("int").alias("line"), F.when(k == 5, F.substring(text, 1, 40)).otherwise(text).alias("text"))


CLAUDE_SQL = f"""{E_SQL}, x AS (SELECT *, k % 6 AS c FROM ev)
SELECT 'claude/' || user_id || '.jsonl' AS file, event_id::INTEGER AS line, CASE WHEN c NOT IN (3, 5) THEN 'm' || event_id END AS event_id, CASE WHEN c NOT IN (3, 5) THEN 'claude-code:u' || user_id END AS session, CASE WHEN c NOT IN (3, 5) THEN ts END AS ts,
       CASE WHEN c NOT IN (3, 5) THEN amount END AS input, CASE WHEN c NOT IN (3, 5) THEN CASE WHEN c = 1 THEN 0 ELSE k END END AS output, CASE WHEN c NOT IN (3, 5) THEN 2 * k END AS cache_read,
       CASE WHEN c NOT IN (3, 5) THEN CASE WHEN c = 2 THEN k + 7 ELSE k + 5 END END AS cache_write, CASE WHEN c NOT IN (3, 5) THEN CASE WHEN c = 1 THEN 'output' ELSE '' END END AS missing, CASE c WHEN 3 THEN 'missing_required_field' WHEN 5 THEN 'truncated_structure' END AS class
FROM x"""


def _both(parsed):
    """Events and quarantined lines in one table."""
    events, faults = parsed
    kept = events.select("file", "line", "event_id", "session", "ts", "input", "output", "cache_read", "cache_write", F.array_join("missing", ",").alias("missing"))
    return kept.unionByName(faults.select("file", "line", "class"), allowMissingColumns=True)


@query("SC-3_claude_lines", CLAUDE_SQL)
def sc3(spark, sf_dir):
    return _both(transcripts.parse_claude(claude_lines(spark, sf_dir)))


@query("SC-8_usage_fields", f"{E_SQL} SELECT event_id, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END::INTEGER AS n_unknown, CASE WHEN k % 6 = 0 THEN 9 END::BIGINT AS odd, CASE k % 6 WHEN 1 THEN 'output' WHEN 2 THEN 'cache_write' ELSE '' END AS missing, CASE WHEN k % 6 = 3 THEN 'missing_required_field' END AS fault FROM ev WHERE k % 6 <> 5")
def sc8(spark, sf_dir):
    rows = claude_lines(spark, sf_dir).withColumn("u", F.try_variant_get(F.try_parse_json("text"), "$.message.usage", "variant")).where("u is not null")
    found = transcripts.usage_fields(rows, "u", transcripts.CLAUDE)
    return found.select(F.col("line").cast("bigint").alias("event_id"), F.size("unknown").alias("n_unknown"), F.try_element_at("unknown", F.lit("odd_tokens")).alias("odd"), F.array_join("missing", ",").alias("missing"), "fault")


@query(
    "SC-4_codex_files",
    f"""{E_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM ev WHERE event_type <> 'error'), m AS (SELECT user_id, arg_max('m-' || (k % 3), event_id) AS model FROM ev e WHERE event_type = 'error' AND event_id < (SELECT max(event_id) FROM n WHERE n.user_id = e.user_id) GROUP BY user_id)
SELECT 'codex/' || n.user_id AS file, (event_id + 1)::INTEGER AS line, 'codex:t' || n.user_id AS session, CASE WHEN n.user_id % 2 = 0 THEN 'codex:p' || n.user_id END AS parent, model, ts, amount AS input, k AS output FROM n LEFT JOIN m USING (user_id) WHERE back = 1""",
)
def sc4(spark, sf_dir):
    """Cumulative totals; errors stand for changes of the model; line 0 is the session's header."""
    e = t.events(spark, sf_dir)
    file = F.concat(F.lit("codex/"), F.col("user_id").cast("string"))
    turn = _json(type=F.lit("turn_context"), payload=F.struct(F.concat(F.lit("m-"), (F.col("k") % 3).cast("string")).alias("model")))
    total = F.struct(F.col("amount").alias("input_tokens"), F.col("k").alias("output_tokens"), (F.col("amount") + F.col("k")).alias("total_tokens"))
    used = _json(type=F.lit("event_msg"), timestamp=format_rfc3339(F.col("ts")), payload=F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")))
    head = e.select("user_id").distinct().select(file.alias("file"), F.lit(0).alias("line"), _json(type=F.lit("session_meta"), payload=F.struct(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 2 == 0, F.struct(F.struct(F.struct(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("parent_thread_id")).alias("thread_spawn")).alias("subagent"))).alias("source"))).alias("text"))
    lines = head.union(e.select(file, (F.col("event_id") + 1).cast("int"), F.when(F.col("event_type") == "error", turn).otherwise(used)))
    return transcripts.parse_codex(lines)[0].select("file", "line", "session", "parent", "model", "ts", "input", "output")


@query(
    "SC-5_pi_files",
    f"""{E_SQL}, h AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM ev)
SELECT 'pi/' || user_id AS file, event_id::INTEGER AS line, 'm' || event_id AS event_id, 'pi:s' || head AS session, ts, amount AS input, k AS output, 3::BIGINT AS cache_read, 0::BIGINT AS cache_write, 'cache_write' AS missing FROM h WHERE event_type <> 'error'""",
)
def sc5(spark, sf_dir):
    """Errors stand for session headers, all else for messages under the last of them."""
    e = t.events(spark, sf_dir)
    head = _json(type=F.lit("session"), id=F.concat(F.lit("s"), F.col("event_id").cast("string")), cwd=F.lit("/w"))
    usage = F.struct(F.col("amount").alias("input"), F.col("k").alias("output"), F.lit(3).alias("cacheRead"), F.lit(99).alias("totalTokens"))
    message = _json(type=F.lit("message"), id=F.lit("outer"), timestamp=format_rfc3339(F.col("ts")), message=F.struct(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("id"), F.lit("x").alias("model"), usage.alias("usage")))
    lines = e.select(F.concat(F.lit("pi/"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").cast("int").alias("line"), F.when(F.col("event_type") == "error", head).otherwise(message).alias("text"))
    return _both(transcripts.parse_pi(lines)).drop("class")


OPENCODE_SQL = f"""{E_SQL}, x AS (SELECT *, k % 4 AS c, amount + 3 AS rest FROM ev WHERE event_type <> 'error')
SELECT 'm' || event_id AS event_id, 'opencode:' || user_id AS session, '/w/' || user_id AS directory, ts // 1000000 * 1000000 AS ts, amount AS input,
       CASE c WHEN 0 THEN k + 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 5 END::BIGINT AS output FROM x"""


def _opencode_messages(spark, sf_dir) -> DataFrame:
    """Outputs as stated, as a difference below zero, as zero, and left out. Errors stand for users' messages."""
    e = t.events(spark, sf_dir)
    c, k, rest = F.col("k") % 4, F.col("k"), F.col("amount") + 3
    tokens = F.struct(
        F.col("amount").alias("input"), F.when(c == 0, k).when(c == 1, -1 - k).when(c == 2, F.lit(0)).alias("output"), F.when(c == 0, F.lit(2)).when(c == 1, k + 3).when(c == 2, F.lit(4)).otherwise(F.lit(5)).alias("reasoning"),
        F.when(c == 1, rest + 2).when(c == 2, rest + 1).alias("total"), F.struct(F.lit(1).alias("read"), F.lit(2).alias("write")).alias("cache"),
    )
    data = _json(role=F.when(F.col("event_type") == "error", "user").otherwise("assistant"), providerID=F.lit("p"), modelID=F.lit("m"), tokens=tokens)
    user = F.col("user_id").cast("string")
    return e.select("event_id", "user_id", F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), user.alias("session_id"), F.expr("ts div 1000000").alias("time_created"), data.alias("data"), F.concat(F.lit("/w/"), user).alias("directory"))


@query("SC-6_opencode_messages", OPENCODE_SQL)
def sc6(spark, sf_dir):
    rows = _opencode_messages(spark, sf_dir).withColumn("file", F.lit("a.db"))
    messages = rows.select("file", F.col("event_id").alias("line"), "message_id", "session_id", "time_created", "data")
    directories = rows.select("file", "session_id", "directory").distinct()
    return databases.parse_opencode(messages, directories)[0].select("event_id", "session", "directory", "ts", "input", "output")


@query("SC-6_databases", OPENCODE_SQL)
def sc6_databases(spark, sf_dir):
    """The same messages out of databases, each of a user and no more than 5,000 numbers of events."""
    rows = _opencode_messages(spark, sf_dir).withColumn("part", F.expr("event_id div 5000"))
    path = F.concat_ws("/", "session_id", F.concat(F.col("part").cast("string"), F.lit(".db")))
    files = staged(databases.packed(rows.withColumn("path", path), ["user_id", "part"], "path"), "databases")
    messages, directories = databases.sqlite_rows(files, databases.MESSAGES), databases.sqlite_rows(files, databases.DIRECTORIES)
    return databases.parse_opencode(messages, directories)[0].select("event_id", "session", "directory", "ts", "input", "output")


@query(
    "SC-7_agy_steps",
    f"""{E_SQL}, c AS (SELECT *, k + CASE WHEN event_type = 'click' THEN 14 ELSE 0 END AS chars FROM ev), h AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS history FROM c)
SELECT 'x' || user_id || '/.system_generated/t.jsonl' AS file, event_id::INTEGER AS line, 'agy:x' || user_id AS session, ts, (34492 + history // 4)::BIGINT AS input, (chars // 4)::BIGINT AS output FROM h WHERE event_type = 'view'""",
)
def sc7(spark, sf_dir):
    """Views stand for the planner's steps, clicks carry a call of fourteen characters."""
    e = t.events(spark, sf_dir)
    calls = F.when(F.col("event_type") == "click", F.array(F.create_map(F.lit("name"), F.lit("")).cast("map<string,string>")))
    text = _json(type=F.when(F.col("event_type") == "view", "PLANNER_RESPONSE").otherwise("USER"), created_at=format_rfc3339(F.col("ts")), content=F.repeat(F.lit("x"), F.col("k").cast("int")), tool_calls=calls)
    lines = e.select(F.concat(F.lit("x"), F.col("user_id").cast("string"), F.lit("/.system_generated/t.jsonl")).alias("file"), F.col("event_id").cast("int").alias("line"), text.alias("text"))
    return transcripts.parse_agy(lines)[0].select("file", "line", "session", "ts", "input", "output")


def written_lines(spark, sf_dir, name):
    """A folder of one text file for each fifth of the users, the last line of which ends in a blank, not in a newline."""
    path = new_folder(spark, name)
    part, number = F.col("user_id") % 5, F.col("event_id").cast("string")
    # "line 1\nline 2 " is "line", "1\nline" and "2" with a blank behind each: rows, so that no file's lines are gathered.
    w = Window.partitionBy("part").orderBy("event_id")
    rows = t.events(spark, sf_dir).select(part.alias("part"), "event_id").withColumn("before", F.lag("event_id").over(w)).withColumn("last", F.lead("event_id").over(w).isNull())
    opens = F.when(F.col("before").isNull(), "line").otherwise(F.concat(F.col("before").cast("string"), F.lit("\nline")))
    pieces = rows.select("part", "event_id", F.posexplode(F.when(F.col("last"), F.array(opens, number)).otherwise(F.array(opens))).alias("place", "value"))
    pieces.sortWithinPartitions("part", "event_id", "place").select("part", "value").write.partitionBy("part").option("lineSep", " ").text(path)
    return path


@query("SC-1_discovery", f"{E_SQL} SELECT 'part=' || (user_id % 5) AS folder, sum(length('line ' || event_id) + 1)::BIGINT AS size FROM ev GROUP BY 1")
def sc1(spark, sf_dir):
    found = transcripts.discover(spark, written_lines(spark, sf_dir, "discovery"), "*.txt")
    return found.select(F.regexp_extract("file", r"(part=\d)", 1).alias("folder"), "size")


@query("SC-10_complete_lines", f"{E_SQL}, n AS (SELECT *, row_number() OVER w AS line, count(*) OVER (PARTITION BY user_id % 5) AS lines FROM ev WINDOW w AS (PARTITION BY user_id % 5 ORDER BY event_id)) SELECT 'part=' || (user_id % 5) AS folder, line::INTEGER AS line, 'line ' || event_id AS text FROM n WHERE line < lines")
def sc10(spark, sf_dir):
    lines = transcripts.read_lines(spark, written_lines(spark, sf_dir, "lines"), "*.txt")
    return lines.select(F.regexp_extract("file", r"(part=\d)", 1).alias("folder"), "line", "text")


@query("SC-11_rate_book", "SELECT c_custkey AS card, 'v' || (c_custkey % 3) AS vendor, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey * 1000000 + 250000 END::BIGINT AS rate, (DATE '2024-01-01' + (c_custkey % 300)::INTEGER)::VARCHAR AS start, CASE WHEN c_custkey % 2 = 0 THEN 3 END::INTEGER AS days, CASE WHEN c_custkey % 2 = 0 THEN 480 END::INTEGER AS from_min, CASE WHEN c_custkey % 2 = 0 THEN 1050 END::INTEGER AS to_min FROM customer")
def sc11(spark, sf_dir):
    c = t.table(spark, sf_dir, "customer")
    cards = c.select(
        F.col("c_custkey").alias("card"), F.concat(F.lit("v"), (F.col("c_custkey") % 3).cast("string")).alias("vendor"), F.when(F.col("c_custkey") % 7 == 0, "1.2345678").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".25"))).alias("rate"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string").alias("effective_start"),
        F.when(F.col("c_custkey") % 2 == 0, F.struct(F.array(F.lit("mon"), F.lit("tue")).alias("days"), F.lit("08:00-17:30").alias("hours_utc"))).alias("schedule"),
    )
    return quotas.rate_cards(cards).select("card", "vendor", "rate", F.col("start").cast("string").alias("start"), "days", "from_min", "to_min")


@query(
    "SC-12_quota_bodies",
    f"""{E_SQL}, v AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT event_id AS body, 'five_hour' AS key, 'account' AS scope_kind, NULL::VARCHAR AS scope_name, (k * 10000)::BIGINT AS used_ppm, CASE WHEN k % 2 = 0 THEN 'known' ELSE 'not_started' END AS reset_kind, CASE WHEN k % 2 = 0 THEN ts END AS reset_at FROM v WHERE k <= 100
UNION ALL SELECT event_id, 'seven_day', 'model', 'opus', 50000, 'not_started', NULL FROM v
UNION ALL SELECT event_id, '300m', 'account', NULL, k * 10000, CASE WHEN k = 0 THEN 'not_started' ELSE 'known' END, CASE WHEN k <> 0 THEN (ts // 1000000000 + 18000) * 1000000000 END FROM v WHERE k <= 100
UNION ALL SELECT event_id, '5h', 'group', 'g', k * 1000, 'known', ts FROM v
UNION ALL SELECT event_id, 'session', 'account', NULL, k * 1000, 'scheduled', (ts // 18000000000000 + 1) * 18000000000000 FROM v
UNION ALL SELECT event_id, 'weekly', 'account', NULL, 400000, 'scheduled', (ts // 604800000000000 + 1) * 604800000000000 FROM v
UNION ALL SELECT event_id, 'week', 'account', NULL, least(k * 1000, 1000000), 'not_started', NULL FROM v""",
)
def sc12(spark, sf_dir):
    """A body of each of five providers for each view."""
    v = t.events(spark, sf_dir, "view").select(F.col("event_id").alias("body"), F.col("ts").alias("observed"), "ts", "k")
    body = lambda **c: v.withColumn("text", _json(**c))
    at = format_rfc3339(F.col("ts"))
    named = lambda used, reset: F.struct(used.alias("utilization"), reset.alias("resets_at"))
    parts = [
        quotas.anthropic_windows(body(five_hour=named(F.col("k").cast("double"), F.when(F.col("k") % 2 == 0, at)), seven_day_opus=named(F.lit(5.0), F.lit(None).cast("string")))),
        quotas.codex_windows(body(payload=F.struct(F.struct(F.struct(F.col("k").cast("double").alias("used_percent"), F.lit(300).alias("window_minutes"), (F.expr(f"ts div {SECOND}") + 18_000).alias("resets_at")).alias("primary")).alias("rate_limits")))),
        quotas.agy_windows(body(groups=F.array(F.struct(F.array(F.struct(F.lit("g").alias("bucketId"), F.lit("5h").alias("window"), at.alias("resetTime"), (1 - F.col("k") / 1000).alias("remainingFraction"))).alias("buckets"))))),
        quotas.ollama_windows(body(limits=F.struct(F.struct((F.col("k") / 1000).alias("usage")).alias("session"), F.struct(F.lit(0.4).alias("usage")).alias("weekly")))),
        quotas.opencode_windows(body(access=F.struct(F.struct(F.struct(F.lit("1000").alias("limitMicroCents"), F.col("k").cast("string").alias("usedMicroCents")).alias("week")).alias("meters")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("body", "key", "scope_kind", "scope_name", "used_ppm", "reset_kind", F.col("reset_at").cast("bigint").alias("reset_at"))


@query(
    "SC-16_legacy_import",
    f"""{E_SQL}, native AS (SELECT user_id AS account, min(ts) AS since FROM ev WHERE event_type = 'view' AND k < 5 GROUP BY 1), old AS (SELECT user_id AS account, ts, event_id, k, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'reading' ELSE 'attempt' END AS shape FROM ev)
SELECT 'attempt' AS relation, old.account, ts, CASE WHEN shape = 'failure' THEN 'failed' WHEN shape = 'reading' THEN 'success' ELSE 'unknown' END AS outcome, NULL::BIGINT AS used_ppm, 'legacy_import' AS provenance, event_id AS source_line FROM old LEFT JOIN native USING (account) WHERE since IS NULL OR ts < since
UNION ALL SELECT 'observation', old.account, ts, NULL, k * 10000, 'legacy_import', event_id FROM old LEFT JOIN native USING (account) WHERE shape = 'reading' AND k <= 100 AND (since IS NULL OR ts < since)""",
)
def sc16(spark, sf_dir):
    """Three shapes of old records, cut off for each account at its first native attempt."""
    e = t.events(spark, sf_dir)
    text = (
        F.when(F.col("event_type") == "error", _json(account=F.col("user_id"), at=format_rfc3339(F.col("ts")), error=F.lit("x")))
        .when(F.col("event_type") == "view", _json(account=F.col("user_id"), at=format_rfc3339(F.col("ts")), used_percent=F.col("k")))
        .otherwise(_json(account=F.col("user_id"), at=format_rfc3339(F.col("ts"))))
    )
    lines = e.select(F.lit("old").alias("file"), F.col("event_id").alias("line"), text.alias("text"))
    native = e.where("event_type = 'view' and k < 5").groupBy(F.col("user_id").alias("account")).agg(F.min("ts").alias("since"))
    return records.legacy_import(lines, native).withColumnRenamed("line", "source_line")


@query("SC-18_projection_read", f"WITH {M_SQL}, g AS (SELECT account, ts, used_ppm, observation, ts // {DAY} AS generation FROM meter), l AS (SELECT account, max(generation) AS generation, arg_max(used_ppm, {{'t': ts, 'o': observation}}) AS used_ppm FROM g GROUP BY account) SELECT u.account, CASE WHEN l.account IS NULL THEN 'unavailable' WHEN generation < (SELECT max(generation) FROM l) - 2 THEN 'stale' ELSE 'available' END AS state, CASE WHEN l.account IS NULL THEN 'missing' WHEN generation < (SELECT max(generation) FROM l) - 2 THEN 'old_generation' END AS reason, used_ppm FROM (SELECT DISTINCT user_id AS account FROM ev) u LEFT JOIN l USING (account)")
def sc18(spark, sf_dir):
    """The documents that generations of a projection published, read back; a generation is a day."""
    path = new_folder(spark, "projection")
    states = t.meter(spark, sf_dir).withColumn("generation", F.expr(f"ts div {DAY}"))
    records.publish(states, path, ["account"], ["ts", "observation"])
    accounts = t.events(spark, sf_dir).select(F.col("user_id").alias("account")).distinct()
    return records.read_projection(spark, path, accounts, "account", 2).select("account", "state", "reason", "used_ppm")


@query("SK-3_batches", f"{E_SQL}, n AS (SELECT user_id AS file, count(*) AS events FROM ev GROUP BY 1), b AS (SELECT *, sum(events) OVER (ORDER BY file) - events AS before, row_number() OVER (ORDER BY file) - 1 AS place FROM n) SELECT file, events, greatest(before // 500, place // 7)::BIGINT AS least_batch FROM b")
def sk3(spark, sf_dir):
    files = t.events(spark, sf_dir).groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("events"))
    return records.batch_bounds(files, "file", 500, 7).select("file", "events", "least_batch")


@query("SL-1_total_order", f"{E_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS place FROM ev")
def sl1(spark, sf_dir):
    return t.events(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"))


@query("ST-1_union_all", f"{E_SQL} SELECT user_id, event_type FROM ev WHERE k < 50 UNION ALL SELECT user_id, event_type FROM ev WHERE event_type = 'view'")
def st1(spark, sf_dir):
    e = t.events(spark, sf_dir)
    return e.where("k < 50").select("user_id", "event_type").unionByName(t.events(spark, sf_dir, "view").select("event_type", "user_id"))


@query("ST-2_union_distinct", f"{E_SQL} SELECT user_id, event_type FROM ev WHERE k < 50 UNION SELECT user_id, event_type FROM ev WHERE event_type = 'view'")
def st2(spark, sf_dir):
    return st1(spark, sf_dir).distinct()


@query("ST-6_recursive_union", "WITH RECURSIVE up AS (SELECT c_custkey AS session, c_custkey // 2 AS node FROM customer WHERE c_custkey // 2 > 0 UNION SELECT session, node // 2 FROM up WHERE node // 2 > 0) SELECT session, count(*)::BIGINT AS ancestors, min(node) AS root FROM up GROUP BY session")
def st6(spark, sf_dir):
    c = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.nullif(F.expr("c_custkey div 2"), F.lit(0)).alias("parent"))
    return records.ancestors(c).groupBy("session").agg(F.count("*").alias("ancestors"), F.min("ancestor").alias("root"))


@query("SF-4_plus_days", "SELECT o_orderkey, (o_orderdate::DATE + (o_custkey % 400)::INTEGER)::VARCHAR AS later, (o_orderdate::DATE + 1)::VARCHAR AS next FROM orders")
def sf4(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return t.table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(day, (F.col("o_custkey") % 400).cast("int")).cast("string").alias("later"), F.date_add(day, 1).cast("string").alias("next"))


@query("SF-27_labels", f"{E_SQL} SELECT event_id, concat_ws(':', event_type, CASE WHEN k % 3 <> 0 THEN 'u' || user_id || ':x' END) AS label, event_type AS space, CASE WHEN k % 3 <> 0 THEN 'u' || user_id || ':x' ELSE '' END AS name FROM ev")
def sf27(spark, sf_dir):
    label = F.concat_ws(":", "event_type", F.when(F.col("k") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":x"))))
    return t.events(spark, sf_dir).select("event_id", label.alias("label"), *records.namespaced(label))
