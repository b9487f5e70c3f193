"""Chat formatting with linked tool calls.

Calls and results are joined by their conversation and identifier, ordered so
that each call follows those it depends on, checked against their tools'
schemas and written as canonical JSON: keys sorted at every depth, no blanks,
equal numbers written alike (100, 1e2 and 100.0 as 100) with all their digits.

Explicit calls stand in an assistant's text as
<tool_call>{"id", "name", "arguments", "depends_on"}</tool_call>, results in
any text as <tool_result>{"id", "content"}</tool_result>. Chat without markup
is linked too: a user's turn counts as a call of the tool `reply`, and an
assistant's turn right after it as its result.

All of it is DataFrame functions: no Python runs on the executors. A
conversation's rows are never gathered, so it may be of any length.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole
from .fingerprints import let

# JSON types, as prefixes of the SQL types that variants of them have.
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


@dataclass(frozen=True)
class OneOf:
    """A string that is one of these."""

    values: tuple[str, ...]


@dataclass(frozen=True)
class Items:
    """An array, each of whose items is of a kind."""

    kind: Kind


@dataclass(frozen=True)
class Fields:
    """An object with fields of (kind, whether it is required), and with no others if it is closed."""

    fields: Mapping[str, tuple[Kind, bool]]
    closed: bool = False


#: What a value may be: a JSON type by name, or one of the above.
Kind = str | OneOf | Items | Fields
#: Tool to argument to (kind, whether it is required).
Schemas = Mapping[str, Mapping[str, tuple[Kind, bool]]]
REPLY: Schemas = {"reply": {"text": ("string", True)}}


#: JSON's tokens: strings, numbers, and runs of all else. Possessive, so that no text makes the match go back or recurse.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'
#: What marks a number that is held as a string, as JSON writes it; strings that begin with it get it twice.
_MARK = r"\u0001"


def canonical_number(token: Column) -> Column:
    """A JSON number in one of its ways of writing, without loss: scientific notation where plain would append more zeros than there are digits and have over 21 places, or have six zeros behind the point."""
    part = lambda regex: F.regexp_extract(token, regex, 1)
    raised = part(r"[eE]([+-]?[0-9]+)$")
    power = F.when(raised == "", F.lit(0)).otherwise(raised.try_cast("int")).cast("bigint")
    facts = F.struct(F.regexp_replace(F.concat(part(r"^-?([0-9]+)"), part(r"\.([0-9]+)")), "^0+", "").alias("digits"), (power - F.length(part(r"\.([0-9]+)"))).alias("power"))
    short = lambda x: F.struct(F.rtrim(x["digits"], F.lit("0")).alias("d"), (x["power"] + F.length(x["digits"]) - F.length(F.rtrim(x["digits"], F.lit("0")))).alias("k"))

    def written(x: Column) -> Column:
        d, k, n = x["d"], x["k"], F.length(x["d"])
        point = n + k
        zeros = lambda count: F.repeat(F.lit("0"), F.greatest(F.lit(0), F.least(count, F.greatest(n, F.lit(21)))).cast("int"))
        inside = F.least(F.greatest(point, F.lit(0)), n).cast("int")
        science = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, F.lit(2147483647)))).otherwise(F.lit("")), F.lit("e"), F.when(point > 0, "+").otherwise(""), (point - 1).cast("string"))
        plain = (
            F.when((k >= 0) & ((point <= 21) | (k <= n)), F.concat(d, zeros(k)))
            .when((k < 0) & (point > 0), F.concat(F.substring(d, F.lit(1), inside), F.lit("."), F.substring(d, inside + 1, F.lit(2147483647))))
            .when((k < 0) & (point > -6), F.concat(F.lit("0."), zeros(-point), d))
            .otherwise(science)
        )
        return F.when(k.isNull(), token).when(d == "", "0").otherwise(F.concat(F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), plain))

    return let(let(facts, short), written)


def _marked_numbers(raw: Column) -> Column:
    """JSON text with its numbers as marked strings."""
    string = lambda t: F.when(F.startswith(t, F.lit(f'"{_MARK}')), F.concat(F.lit(f'"{_MARK}'), F.substring(t, 2, F.lit(2147483647)))).otherwise(t)
    number = lambda t: F.concat(F.lit(f'"{_MARK}'), canonical_number(t), F.lit('"'))
    return F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_TOKENS), F.lit(0)), lambda t: F.when(F.rlike(t, F.lit("^-?[0-9]")), number(t)).otherwise(string(t))), "")


def _unmarked(json: Column) -> Column:
    """The reverse, once keys are sorted. A quote right behind one of [{,: opens a string."""
    numbers = F.regexp_replace(json, r'(?<=[\[{,:]|^)"\\u0001(-?[0-9][0-9.eE+-]*+)"', "$1")
    return F.regexp_replace(numbers, r'(?<=[\[{,:]|^)"\\u0001\\u0001', r'"\\u0001')


def _tagged(conversations: DataFrame, tag: str, field: str) -> DataFrame:
    """(conv_id, turn, idx, body, json): the JSON of each tag in a text, a null variant where it isn't JSON; json: its field as canonical JSON."""
    found = F.regexp_extract_all("text", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    each = conversations.where(F.contains("text", F.lit(f"<{tag}>"))).select("conv_id", "turn", F.posexplode(found).alias("idx", "raw")).withColumn("body", F.try_parse_json("raw"))
    exact = F.when(F.col("body").isNotNull(), F.try_parse_json(_marked_numbers(F.col("raw"))))
    return each.withColumn("json", _unmarked(F.to_json(F.try_variant_get(exact, f"$.{field}", "variant"))))


def explicit_calls(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, idx, call_id, name, arguments variant, depends_on, json)."""
    body = F.col("body")
    return _tagged(conversations.where("role = 'assistant'"), "tool_call", "arguments").select(
        "conv_id", "turn", "idx",
        F.try_variant_get(body, "$.id", "string").alias("call_id"),
        F.try_variant_get(body, "$.name", "string").alias("name"),
        F.try_variant_get(body, "$.arguments", "variant").alias("arguments"),
        F.try_variant_get(body, "$.depends_on", "array<string>").alias("depends_on"),
        "json",
    )


def explicit_results(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, idx, call_id, json)."""
    return _tagged(conversations, "tool_result", "content").select("conv_id", "turn", "idx", F.try_variant_get("body", "$.id", "string").alias("call_id"), "json")


def _marked() -> Column:
    return F.coalesce(F.contains("text", F.lit("<tool_call>")) | F.contains("text", F.lit("<tool_result>")), F.lit(False))


def _object(name: str, value: str) -> Column:
    return F.to_json(F.struct(F.col(value).alias(name)), {"ignoreNullFields": "false"})


def implicit_calls(conversations: DataFrame) -> DataFrame:
    """User turns without markup as calls of `reply`, named by their turn."""
    users = conversations.where((F.col("role") == "user") & ~_marked()).withColumn("json", _object("text", "text"))
    return users.select("conv_id", "turn", F.lit(-1).alias("idx"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("call_id"), F.lit("reply").alias("name"), F.try_parse_json("json").alias("arguments"), F.array().cast("array<string>").alias("depends_on"), "json")


def implicit_results(conversations: DataFrame) -> DataFrame:
    """Assistant turns without markup as results of the turn before."""
    answers = conversations.where((F.col("role") == "assistant") & ~_marked())
    quoted = F.regexp_extract(_object("t", "text"), r'(?s)^\{"t":(.*)\}$', 1)
    return answers.select("conv_id", "turn", F.lit(-1).alias("idx"), F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("call_id"), quoted.alias("json"))


def _named(kind: Kind) -> str:
    return kind if isinstance(kind, str) else {OneOf: "value allowed", Items: "array of its items", Fields: "object of its fields"}[type(kind)]


def _fits(value: Column, kind: Kind) -> Column:
    """Whether a variant is of a kind; a JSON null is of none. Fields and items are looked at to any depth that the schema has; fields that are null count as absent."""
    found = F.schema_of_variant(value)
    if isinstance(kind, OneOf):
        fits = found.startswith("STRING") & F.try_variant_get(value, "$", "string").isin(list(kind.values))
    elif isinstance(kind, Items):
        fits = found.startswith("ARRAY") & F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: _fits(x, kind.kind))
    elif isinstance(kind, Fields):
        fits = found.startswith("OBJECT")
        for name, (inner, required) in kind.fields.items():
            field = F.try_variant_get(value, f"$['{name}']", "variant")
            absent = field.isNull() | F.is_variant_null(field)
            fits = fits & F.when(absent, F.lit(not required)).otherwise(_fits(field, inner))
        if kind.closed:
            names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
            fits = fits & F.forall(names, lambda n: n.isin(list(kind.fields)))
    else:
        fits = F.lit(False)
        for prefix in _TYPES[kind]:
            fits = fits | found.startswith(prefix)
    return F.coalesce(fits, F.lit(False))


def faults(schemas: Schemas) -> Column:
    """array<string>: how a call's arguments break its tool's schema; empty if they don't, or if the tool has none."""
    args = F.col("arguments")
    of = lambda p: F.try_variant_get(args, f"$['{p}']", "variant")
    checks = [F.when(F.col("call_id").isNull(), F.lit("no id")), F.when(F.col("name").isNull(), F.lit("no tool")), F.when(args.isNull() | ~F.schema_of_variant(args).startswith("OBJECT"), F.lit("arguments are no object"))]
    for tool, params in schemas.items():
        for p, (kind, required) in params.items():
            absent = of(p).isNull() | F.is_variant_null(of(p))
            checks.append(F.when((F.col("name") == tool) & ~absent & ~_fits(of(p), kind), F.lit(f"{p} is no {_named(kind)}")))
            if required:
                checks.append(F.when((F.col("name") == tool) & absent, F.lit(f"{p} is missing")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def _same(a: str, b: str, left: str = "call_id", right: str = "call_id") -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that depend on no other, else one more than the highest of those they depend on; null in a cycle or behind one.

    Dependencies on calls that don't exist are left out. A round serves all
    conversations at once and handles only calls that still wait for another;
    there are as many rounds as the longest chain has calls.
    """
    nodes = calls.where("call_id is not null").select("conv_id", "call_id").distinct()
    edges = calls.where("call_id is not null").select("conv_id", "call_id", F.explode("depends_on").alias("dep")).distinct()
    edges = edges.alias("x").join(nodes.hint("shuffle_hash").alias("y"), _same("x", "y", "dep"), "left_semi")
    if edges.isEmpty():
        return nodes.withColumn("level", F.lit(0))
    edges = staged(edges, "edges")
    waits = staged(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("left"), F.lit(-1).alias("level")), "waits")
    ready = staged(nodes.alias("x").join(waits.hint("shuffle_hash").alias("y"), _same("x", "y"), "left_anti").withColumn("level", F.lit(0)), "levels")
    known = ready
    while not ready.isEmpty():
        served = edges.alias("x").join(ready.hint("shuffle_hash").alias("y"), _same("x", "y", "dep")).groupBy("x.conv_id", "x.call_id").agg(F.count("*").alias("served"), F.max("level").alias("highest"))
        now = waits.alias("x").join(served.alias("y"), _same("x", "y"), "left").select("x.conv_id", "x.call_id", (F.col("left") - F.coalesce("served", F.lit(0))).alias("left"), F.greatest("level", "highest").alias("level"))
        now = staged(now, "waits")
        waits, ready = now.where("left > 0"), now.where("left = 0").select("conv_id", "call_id", (F.col("level") + 1).alias("level"))
        known = known.union(ready)
    return nodes.alias("x").join(known.hint("shuffle_hash").alias("y"), _same("x", "y"), "left").select("x.conv_id", "x.call_id", "y.level")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, turn, idx, kind, call_id, name, known, level, status, json) with a row for each call and each result.

    A call is `answered`, `unanswered`, `invalid` (its arguments break the
    schema), `cyclic` or a `repeat` (its identifier was used before); known says
    whether its tool has a schema, without which arguments are only checked to
    be an object. A result is `linked`, `early` (in a turn before its call's,
    which it doesn't answer), `late` (its call has an earlier one) or an
    `orphan`. Calls and results meet in hash joins by conversation and
    identifier.
    """
    at = F.min(F.struct("turn", "idx"))
    first_call = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(at.alias("call_at"))
    behind = F.coalesce(F.col("turn") >= F.col("call_at.turn"), F.lit(True))
    timely = results.alias("x").join(first_call.hint("shuffle_hash").alias("y"), _same("x", "y")).where(behind)
    first_result = timely.groupBy("x.conv_id", "x.call_id").agg(at.alias("result_at"))
    calls = calls.withColumn("faults", faults(schemas))
    keyed = first_call.alias("x").join(first_result.hint("shuffle_hash").alias("y"), _same("x", "y"), "left").select("x.conv_id", "x.call_id", "call_at", "result_at")
    keyed = keyed.alias("x").join(levels(calls).hint("shuffle_hash").alias("y"), _same("x", "y")).select("x.conv_id", "x.call_id", "call_at", "result_at", "level")
    c = calls.alias("x").join(keyed.hint("shuffle_hash").alias("y"), _same("x", "y"), "left").select("x.*", "call_at", "result_at", "level")
    status = F.when(F.size("faults") > 0, "invalid").when(F.struct("turn", "idx") != F.col("call_at"), "repeat").when(F.col("level").isNull(), "cyclic").when(F.col("result_at").isNull(), "unanswered").otherwise("answered")
    rest = lambda *names: F.substring(F.to_json(F.struct(F.col("call_id").alias("id"), *names), {"ignoreNullFields": "false"}), 2, 2147483647)
    json = lambda field, *names: F.concat(F.lit(f'{{"{field}":'), F.coalesce("json", F.lit("null")), F.lit(","), rest(*names))
    known = F.coalesce(F.col("name").isin(list(schemas)), F.lit(False))
    c = c.select("conv_id", "turn", "idx", F.lit("call").alias("kind"), "call_id", "name", known.alias("known"), "level", status.alias("status"), json("arguments", "name").alias("json"))
    r = results.alias("x").join(keyed.hint("shuffle_hash").alias("y"), _same("x", "y"), "left").select("x.*", "call_at", "result_at", "level")
    status = F.when(F.col("call_at").isNull(), "orphan").when(~behind, "early").when(F.struct("turn", "idx") != F.col("result_at"), "late").otherwise("linked")
    r = r.select("conv_id", "turn", "idx", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("known"), "level", status.alias("status"), json("content").alias("json"))
    return c.union(r)


@whole
def format_chat(conversations: DataFrame, schemas: Schemas = REPLY) -> DataFrame:
    """(conv_id, turn, idx, kind, call_id, name, known, level, status, json): what each turn becomes, to be read by (conv_id, level, turn, idx).

    conversations has conv_id, turn, role and text; other columns are ignored.
    Turns that are neither call nor result are messages with the status plain.
    Null texts are JSON nulls; a user's turn without text is an invalid call.
    Null conversations are one conversation; calls without identifier are
    invalid and never linked. Repeated rows each give their rows. An empty table
    gives an empty one; texts may be of any length.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    calls = explicit_calls(rows).union(implicit_calls(rows))
    results = explicit_results(rows).union(implicit_results(rows))
    plain = rows.where(_marked() | F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)))
    json = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    nothing = F.lit(None).cast("string")
    messages = plain.select("conv_id", "turn", F.lit(-2).alias("idx"), F.lit("message").alias("kind"), nothing.alias("call_id"), nothing.alias("name"), F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("int").alias("level"), F.lit("plain").alias("status"), json.alias("json"))
    return link(calls, results, schemas).union(messages)


CHAT_SQL = """
WITH c AS (
  SELECT DISTINCT conv_id, turn AS call_turn FROM conversations WHERE role = 'user'),
r AS (
  SELECT DISTINCT conv_id, turn - 1 AS call_turn FROM conversations WHERE role = 'assistant')
SELECT v.conv_id, v.turn, CASE WHEN role IN ('user', 'assistant') THEN -1 ELSE -2 END::INTEGER AS idx,
       CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
       CASE role WHEN 'user' THEN 'turn-' || v.turn WHEN 'assistant' THEN 'turn-' || (v.turn - 1) END AS call_id,
       CASE role WHEN 'user' THEN 'reply' END AS name, CASE role WHEN 'user' THEN TRUE END AS known,
       CASE WHEN role = 'user' OR role = 'assistant' AND c.call_turn IS NOT NULL THEN 0 END::INTEGER AS level,
       CASE role WHEN 'user' THEN CASE WHEN text IS NULL THEN 'invalid' WHEN r.call_turn IS NULL THEN 'unanswered' ELSE 'answered' END
                 WHEN 'assistant' THEN CASE WHEN c.call_turn IS NULL THEN 'orphan' ELSE 'linked' END
                 ELSE 'plain' END AS status,
       CASE role WHEN 'user' THEN '{"arguments":{"text":' || to_json(text) || '},"id":"turn-' || v.turn || '","name":"reply"}'
                 WHEN 'assistant' THEN '{"content":' || to_json(text) || ',"id":"turn-' || (v.turn - 1) || '"}'
                 ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM conversations v
LEFT JOIN c ON role = 'assistant' AND c.conv_id = v.conv_id AND c.call_turn = v.turn - 1
LEFT JOIN r ON role = 'user' AND r.conv_id = v.conv_id AND r.call_turn = v.turn
"""
