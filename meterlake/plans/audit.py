"""What stands behind figures and formats: drift of record shapes, trees of evidence, transcripts in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_paths
from ..operators import drift, evidence, segments
from ..sources import messages
from ..sources import tables as t
from ..sources.staging import staged
from .meters import M_SQL
from .registry import query

#: Records before this moment are the stored corpus.
CORPUS_ENDS = 1_704_164_400 * 1_000_000_000

# The facts of each record as its texts below state them; shapes are hashed from the listed lines.
REC_SQL = f"""{t.EV_SQL}, rec AS (SELECT 'h' || user_id % 3 AS source, event_type AS kind, ts < {CORPUS_ENDS} AS old, CASE WHEN k = 50 THEN NULL ELSE
list_sort(list_filter(['type:string', 'use:object', CASE WHEN k % 10 = 0 THEN 'use.k:float' ELSE 'use.k:integer' END, CASE WHEN amount > 20000 THEN 'large:array' END, CASE WHEN amount > 20000 THEN 'large[]:integer' END, CASE WHEN amount > 20000 THEN 'note:null' END], lambda x: x IS NOT NULL)) END AS lines FROM ev),
s AS (SELECT *, sha256(array_to_string(list_transform(lines, lambda x: x || chr(10)), '')) AS shape FROM rec),
f AS (SELECT source, old, 'field' AS what, split_part(unnest(lines), ':', 1) AS name FROM s UNION ALL SELECT source, old, 'kind', kind FROM s WHERE lines IS NOT NULL UNION ALL SELECT source, old, 'shape', shape FROM s WHERE lines IS NOT NULL
  UNION ALL SELECT 'h' || user_id % 3, ts < {CORPUS_ENDS}, 'class', CASE WHEN amount > 20000 THEN 'reconstructed' ELSE 'reported' END FROM ev),
g AS (SELECT source, what, name, CASE WHEN NOT bool_or(old) THEN 'new' WHEN bool_and(old) THEN 'missing' ELSE 'known' END AS status, count(*) FILTER (WHERE NOT old) AS records FROM f GROUP BY ALL)"""


def _records(spark, sf_dir):
    """Usage as JSON records: every tenth k is a float, large amounts add fields, and those with k = 50 are cut off."""
    ev = t.events(spark, sf_dir)
    k, large = F.col("k").cast("string"), F.col("amount") > 20_000
    more = F.when(large, F.concat(F.lit(',"large":['), F.col("amount").cast("string"), F.lit('],"note":null'))).otherwise("")
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","use":{"k":'), F.when(F.col("k") % 10 == 0, F.concat(k, F.lit(".0"))).otherwise(k), F.lit("}"), more, F.when(F.col("k") == 50, "").otherwise("}"))
    return ev.select(F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")).alias("source"), (F.col("ts") < CORPUS_ENDS).alias("old"), text.alias("record"), F.when(large, "reconstructed").otherwise("reported").alias("class"))


def _drift(spark, sf_dir):
    rows = _records(spark, sf_dir)
    live, corpus = (json_paths.record_shapes(rows.where(c), ["source"], "record") for c in ("not old", "old"))
    classes = lambda c: rows.where(c).groupBy("source", F.col("class").alias("name")).agg(F.count("*").alias("records"))
    return live, drift.findings(live, corpus, "source", classes("not old"), classes("old"))


@query("AG-22_drift_findings", f"WITH {REC_SQL} SELECT * FROM g")
def ag22_findings(spark, sf_dir):
    return _drift(spark, sf_dir)[1]


@query(
    "AG-22_drift_report",
    f"""WITH {REC_SQL}, r AS (SELECT source, count(*) AS records, count(*) FILTER (WHERE lines IS NULL) AS unreadable FROM s WHERE NOT old GROUP BY 1),
c AS (SELECT source, {", ".join(f"count(*) FILTER (WHERE what = '{w}' AND status = 'new') AS new_{n}" for w, n in (("field", "fields"), ("kind", "kinds"), ("class", "classes"), ("shape", "shapes")))}, count(*) FILTER (WHERE status = 'missing') AS missing FROM g GROUP BY 1)
SELECT source, records, unreadable, unreadable AS quarantined, new_fields, new_kinds, new_classes, new_shapes, missing, unreadable + new_fields + new_kinds + new_classes + new_shapes > 0 AS drift FROM r JOIN c USING (source)""",
)
def ag22_report(spark, sf_dir):
    live, found = _drift(spark, sf_dir)
    refused = live.where("shape is null").select("source", F.lit("invalid_json").alias("class"), F.col("records").alias("n"))
    return drift.report(live, found, "source", refused)


# Two states of the evidence: readings above the bound are gone in the second, those below it weren't yet there in the first.
STATES = ("used_ppm >= 1000", "used_ppm < 200000")
STATE_SQL = f"{M_SQL}, o AS (SELECT account, observation::VARCHAR AS member FROM meter WHERE used_ppm >= 1000), n AS (SELECT account, observation::VARCHAR AS member FROM meter WHERE used_ppm < 200000)"


def _states(spark, sf_dir):
    rows = t.meter(spark, sf_dir)
    return [evidence.members(rows.where(c), ["account"], "observation") for c in STATES]


def _levels_sql(rows: str) -> str:
    """The root's digest by one aggregate for each level."""
    over = lambda x, order: f"sha256(coalesce(string_agg(length({x}) || ':' || {x}, '' ORDER BY {order}), ''))"
    out = f"l4 AS (SELECT account, left(sha256(member), 4) AS p, count(*) AS n, {over('member', 'member')} AS d FROM {rows} GROUP BY 1, 2)"
    for depth in (3, 2, 1, 0):
        out += f", l{depth} AS (SELECT account, left(p, {depth}) AS p, sum(n)::BIGINT AS n, {over('(p || d)', 'p')} AS d FROM l{depth + 1} GROUP BY 1, 2)"
    return out


@query(
    "AG-26_verified",
    f"WITH {STATE_SQL}, {_levels_sql('o')}, e AS (SELECT account, bool_and(a AND b) AS same FROM (SELECT account, member, bool_or(s = 0) AS a, bool_or(s = 1) AS b FROM (SELECT *, 0 AS s FROM o UNION ALL SELECT *, 1 FROM n) GROUP BY 1, 2) GROUP BY 1) SELECT account, l0.n, d AS digest, 'count' AS arithmetic, coalesce(same, false) AS holds FROM l0 LEFT JOIN e USING (account)",
)
def ag26_verified(spark, sf_dir):
    """Whether each figure of the first state still holds in the second."""
    old, new = (evidence.tree(m, ["account"]) for m in _states(spark, sf_dir))
    claims = old.where("depth = 0").select("account", "n", "digest", F.lit(evidence.arithmetic("count")).alias("arithmetic"))
    return claims.join(evidence.verify(claims, new, ["account"]), "account")


@query("AG-26_changed_members", f"WITH {STATE_SQL} SELECT account, member, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT account, member, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)")
def ag26_changed(spark, sf_dir):
    old, new = _states(spark, sf_dir)
    shards = evidence.differing(*[staged(evidence.tree(m, ["account"]), "evidence") for m in (old, new)], ["account"])
    return evidence.changed_members(old, new, shards, ["account"])


@query(
    "SK-8_transcript_parts",
    """WITH m AS (SELECT conv_id, turn, chr(10) || '## ' || CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) AS line FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
w AS (SELECT conv_id, '# sample · ' || min(turn) || ' · ' || conv_id || chr(10) || coalesce((SELECT string_agg(line, '' ORDER BY turn NULLS FIRST, line) FROM m WHERE m.conv_id = c.conv_id), '') AS whole FROM conversations c GROUP BY conv_id),
p AS (SELECT *, (length(whole) + 499) // 500 AS parts FROM w), x AS (SELECT *, unnest(range(parts)) AS part FROM p)
SELECT conv_id, part, parts, substring(whole, part * 500 + 1, 500) AS text FROM x""",
)
def sk8_parts(spark, sf_dir):
    turns = t.table(spark, sf_dir, "conversations")
    headers = turns.groupBy("conv_id").agg(F.min("turn").alias("first")).select("conv_id", F.concat(F.lit("# sample · "), F.col("first").cast("string"), F.lit(" · "), F.col("conv_id").cast("string"), F.lit("\n")).alias("header"))
    lines = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), segments.message_lines(F.col("role"), F.col("text")).alias("line"))
    return segments.parts(lines, headers, "conv_id", 500, 4)


HARNESS_SQL = f"""{t.EV_SQL},
cl AS (SELECT user_id, k % 3 AS id, event_id FROM ev WHERE event_type = 'click'), rs AS (SELECT user_id, k % 3 AS id, event_id FROM ev WHERE event_type = 'purchase'),
met AS (SELECT rs.event_id AS result, cl.event_id AS call FROM rs ASOF LEFT JOIN cl ON rs.user_id = cl.user_id AND rs.id = cl.id AND rs.event_id >= cl.event_id),
pr AS (SELECT call, max(result) AS result FROM met WHERE call IS NOT NULL GROUP BY call)"""


def harness_lines(spark, sf_dir):
    """A line for each event of a user's file: views speak, clicks call, purchases are results, sign-ups think, errors are meta lines."""
    e, k, kind = t.events(spark, sf_dir), F.col("k"), F.col("event_type")
    id = F.concat(F.lit("c"), (k % 3).cast("string"))
    block = (
        F.when(kind == "click", F.to_json(F.struct(F.lit("tool_use").alias("type"), id.alias("id"), F.lit("run").alias("name"), F.struct(k.alias("k")).alias("input"))))
        .when(kind == "purchase", F.to_json(F.struct(F.lit("tool_result").alias("type"), id.alias("tool_use_id"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("content"))))
        .when(kind == "signup", F.to_json(F.struct(F.lit("thinking").alias("type"), F.concat(F.lit("t"), k.cast("string"), F.lit("\n\nu")).alias("thinking"))))
        .otherwise(F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" v"), k.cast("string"), F.lit(" <system-reminder>x</system-reminder> ")).alias("text"))))
    )
    role = F.when(kind.isin("click", "signup"), "assistant").otherwise("user")
    text = F.concat(F.lit('{"isMeta":'), (kind == "error").cast("string"), F.lit(',"message":{"role":"'), role, F.lit('","content":['), block, F.lit("]}}"))
    return e.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line"), text.alias("text"))


@query(
    "SK-8_harness_messages",
    f"""WITH {HARNESS_SQL}
SELECT 'f' || user_id AS file, event_id AS line, CASE WHEN event_type IN ('click', 'signup') THEN chr(10) || '## Assistant' || chr(10) ELSE chr(10) || '## User' || chr(10) END ||
  CASE event_type WHEN 'click' THEN '**Tool: run**' || chr(10) || '```json' || chr(10) || '{{"k":' || k || '}}' || chr(10) || '```' || chr(10) || CASE WHEN pr.result IS NULL THEN '' ELSE '**Tool result:**' || chr(10) || 'r' || pr.result || chr(10) END
    WHEN 'purchase' THEN '**Tool: (unknown)**' || chr(10) || '```json' || chr(10) || 'null' || chr(10) || '```' || chr(10) || '**Tool result:**' || chr(10) || 'r' || event_id || chr(10)
    WHEN 'signup' THEN '> t' || k || chr(10) || '> ' || chr(10) || '> u' || chr(10) ELSE 'v' || k || chr(10) END AS markdown
FROM ev LEFT JOIN pr ON pr.call = event_id WHERE event_type <> 'error' AND event_id NOT IN (SELECT result FROM met WHERE call IS NOT NULL)""",
)
def sk8_messages(spark, sf_dir):
    said = messages.claude_messages(harness_lines(spark, sf_dir))
    return said.select("file", "line", segments.message_lines(F.col("role"), F.col("text"), F.col("tools"), F.col("thinking")).alias("markdown"))
