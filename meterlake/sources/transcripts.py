"""Agent transcripts as usage events, a DataFrame in and a DataFrame out for each format.

Every parser takes lines(file, line, text) and gives events with one shape,
and beside them the lines that it had to set aside, with a reason. Nothing is
dropped silently: a known component that a record leaves out is named in
`missing`, and components that no parser knows are kept in `unknown`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import parse_rfc3339
from ..functions.globs import to_like
from .staging import staged

EVENT = ("file", "line", "event_id", "session", "parent", "directory", "model", "ts", "input", "output", "cache_read", "cache_write", "unknown", "missing", "quality")

# Each format's names of the four components, what it repeats elsewhere, and what it must have.
CLAUDE = ({"input_tokens": "input", "output_tokens": "output", "cache_read_input_tokens": "cache_read", "cache_creation_input_tokens": "cache_write"}, ("cache_creation",), ("input_tokens",))
CODEX = ({"input_tokens": "input", "output_tokens": "output", "cached_input_tokens": "cache_read", "cache_write_input_tokens": "cache_write"}, ("total_tokens", "reasoning_output_tokens"), ("input_tokens",))
PI = ({"input": "input", "output": "output", "cacheRead": "cache_read", "cacheWrite": "cache_write"}, ("totalTokens", "reasoning"), ("input",))
# Fixed values of the estimate for agents that report no tokens.
FLOOR_TOKENS, CHARS_PER_TOKEN = 34_492, 4


def _roots(root: str, hidden: Sequence[str]) -> list[str]:
    return [root, *[f"{root.rstrip('/')}/{h}" for h in hidden]]


def _path() -> Column:
    """A file's path as the listing has it: without the escapes of a URI, which a name's own plus isn't one of."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _files(spark: SparkSession, root: str, pattern: str, hidden: Sequence[str]) -> DataFrame:
    """Spark's listing leaves out folders whose names begin with a dot or an underscore; those below root that hold transcripts are named by globs."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(_roots(root, hidden))


def discover(spark: SparkSession, root: str, pattern: str = "*.jsonl", hidden: Sequence[str] = ()) -> DataFrame:
    """(file, size, modified) of the files below root, and below the hidden folders named, whose names match, sorted."""
    rows = _files(spark, root, pattern, hidden)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("file")


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", hidden: Sequence[str] = ()) -> DataFrame:
    """lines(file, line, text) of all matching files; a last line without its newline is still being written and is left out."""
    # Spark deals a long file out in blocks; a line's number is its place in its block behind the lines of the blocks before.
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(_roots(root, hidden))
    # Written once: both passes must see the same blocks.
    rows = staged(found.select(_path().alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.octet_length("value").alias("bytes"), F.make_valid_utf8("value").alias("text")), "lines")
    blocks = rows.groupBy("file", "block", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    of_file = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = F.sum("n").over(of_file)
    # What is left of a file besides its lines and a newline for each: one byte too few if the last has none; a mark of byte order has three.
    left = F.col("size") - F.sum("bytes").over(of_file) - lines
    blocks = blocks.select("file", "block", "first", before.alias("before"), F.when(left.isin(0, 3), lines).otherwise(lines - 1).alias("complete"))
    line = F.col("id") - F.col("first") + F.col("before") + 1
    out = rows.where(F.trim("text") != "").join(blocks, ["file", "block"]).select("file", line.cast("int").alias("line"), F.trim("text").alias("text"), "complete")
    return out.where("line <= complete").drop("complete")


def _text(v: Column, path: str) -> Column:
    """A JSON string at a path; null if it is anything else."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _count(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    n = F.try_variant_get(v, path, "bigint")
    return F.when(F.schema_of_variant(at).startswith("BIGINT") & (n >= 0), n)


def _has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def _object(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.schema_of_variant(at).startswith("OBJECT"), F.lit(False))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once for each row: a filter on a plain column is moved below it with a copy of its expression, and again below those that one is made of, so that a line would be parsed hundreds of times."""
    kept = [c for c in rows.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return rows.select(*kept, made.alias("_once")).select(*kept, *[F.col(f"_once.{k}").alias(k) for k in columns])


def parsed_json(lines: DataFrame, text: str) -> DataFrame:
    """lines with v, the text as a variant, null where it isn't JSON."""
    return once(lines, v=F.try_parse_json(text))


def usage_fields(rows: DataFrame, usage: str, spec: tuple[Mapping[str, str], Sequence[str], Sequence[str]]) -> DataFrame:
    """rows plus the four components, unknown, missing and fault (null, wrong_field_type or missing_required_field), read from a variant column."""
    known, ignored, required = spec
    u = F.col(usage)
    out = rows
    wrong, absent, lacking = F.lit(False), F.lit(False), []
    for name, kind in known.items():
        path = f"$.{name}"
        out = out.withColumn(kind, F.coalesce(_count(u, path), F.lit(0)).cast("bigint"))
        wrong = wrong | (_has(u, path) & _count(u, path).isNull())
        if name in required:
            absent = absent | ~_has(u, path)
        else:
            lacking.append(F.when(~_has(u, path), F.lit(kind)))
    as_map = F.from_json(F.to_json(u), "map<string,string>")
    extra = F.map_filter(as_map, lambda k, v: ~k.isin([*known, *ignored]) & F.regexp_like(v, F.lit(r"^[0-9]+$")))
    out = out.withColumn("unknown", F.transform_values(extra, lambda k, v: v.try_cast("bigint"))).withColumn("missing", F.filter(F.array(*lacking), lambda x: x.isNotNull()))
    return out.withColumn("fault", F.when(wrong, "wrong_field_type").when(absent, "missing_required_field"))


def _shaped(rows: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"event_id": "string", "session": "string", "parent": "string", "directory": "string", "model": "string", "ts": "bigint", "quality": "string"}
    for c, kind in kinds.items():
        rows = rows.withColumn(c, columns.get(c, F.lit(None).cast(kind)))
    return rows


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined) of rows with a fault column."""
    rows = once(rows, fault=F.col("fault"))
    return rows.where("fault is null").select(*EVENT), rows.where("fault is not null").select("file", "line", F.col("fault").alias("class"))


def _broken(lines: DataFrame) -> DataFrame:
    return lines.where("v is null").select("file", "line", F.lit("truncated_structure").alias("class"))


def parse_claude(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with a usage object; their id is a strong identity. The breakdown of cache writes counts only where the total is absent."""
    parsed = parsed_json(lines, "text")
    v = F.col("v")
    rows = parsed.where(v.isNotNull() & _object(v, "$.message.usage")).withColumn("u", F.try_variant_get(v, "$.message.usage", "variant"))
    rows = usage_fields(rows, "u", CLAUDE)
    u = F.col("u")
    parts = [f"$.cache_creation.{k}" for k in ("ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens")]
    fallback = ~_has(u, "$.cache_creation_input_tokens") & (_has(u, parts[0]) | _has(u, parts[1]))
    bad = fallback & ((_has(u, parts[0]) & _count(u, parts[0]).isNull()) | (_has(u, parts[1]) & _count(u, parts[1]).isNull()))
    rows = rows.withColumn("cache_write", F.when(fallback, F.coalesce(_count(u, parts[0]), F.lit(0)) + F.coalesce(_count(u, parts[1]), F.lit(0))).otherwise(F.col("cache_write")))
    rows = rows.withColumn("missing", F.when(fallback, F.array_remove("missing", "cache_write")).otherwise(F.col("missing"))).withColumn("fault", F.coalesce("fault", F.when(bad, "wrong_field_type")))
    shaped = _shaped(rows, event_id=_text(v, "$.message.id"), session=F.concat(F.lit("claude-code:"), _text(v, "$.sessionId")), directory=_text(v, "$.cwd"), model=_text(v, "$.message.model"), ts=parse_rfc3339(_text(v, "$.timestamp")), quality=F.lit("reported"))
    events, faults = _split(shaped)
    return events, faults.union(_broken(parsed))


def parse_codex(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last cumulative total of each file, with the model in force at its line and the file's last session, directory and parent."""
    parsed = parsed_json(lines, "text")
    v = F.col("v")
    kind, inner = _text(v, "$.type"), _text(v, "$.payload.type")
    full = lambda c: F.nullif(c, F.lit(""))
    is_session = (kind == "session_meta") & _text(v, "$.payload.id").isNotNull()
    is_usage = (inner == "token_count") & _object(v, "$.payload.info.total_token_usage")
    rows = parsed.where(v.isNotNull())
    rows = rows.withColumn("named", F.when(F.coalesce(is_session | (kind == "turn_context"), F.lit(False)), full(_text(v, "$.payload.model"))))
    of_file = Window.partitionBy("file")
    w = of_file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    header = lambda path: F.last(F.when(F.coalesce(is_session, F.lit(False)), full(_text(v, path))), ignorenulls=True).over(of_file.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("in_force", F.last("named", ignorenulls=True).over(w)).withColumn("s", header("$.payload.id")).withColumn("d", header("$.payload.cwd")).withColumn("p", header("$.payload.source.subagent.thread_spawn.parent_thread_id"))
    used = usage_fields(rows.where(F.coalesce(is_usage, F.lit(False))).withColumn("u", F.try_variant_get(v, "$.payload.info.total_token_usage", "variant")), "u", CODEX)
    shaped = _shaped(used, session=F.concat(F.lit("codex:"), F.col("s")), parent=F.concat(F.lit("codex:"), F.col("p")), directory=F.col("d"), model=F.col("in_force"), ts=parse_rfc3339(_text(v, "$.timestamp")), quality=F.lit("reported"))
    good, faults = _split(shaped)
    last = good.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy(F.col("line").desc()))).where("nth = 1").drop("nth")
    return last, faults.union(_broken(parsed))


def parse_pi(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with usage, under the session header that stands before them in their file."""
    parsed = parsed_json(lines, "text")
    v = F.col("v")
    head = F.when((_text(v, "$.type") == "session") & _text(v, "$.id").isNotNull(), F.struct(_text(v, "$.id").alias("id"), _text(v, "$.cwd").alias("cwd")))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = parsed.where(v.isNotNull()).withColumn("head", F.last(head, ignorenulls=True).over(w))
    rows = rows.where(F.coalesce(_text(v, "$.type") != "session", F.lit(True)) & _object(v, "$.message.usage")).withColumn("u", F.try_variant_get(v, "$.message.usage", "variant"))
    rows = usage_fields(rows, "u", PI)
    shaped = _shaped(rows, event_id=F.coalesce(_text(v, "$.message.id"), _text(v, "$.id")), session=F.concat(F.lit("pi:"), F.col("head.id")), directory=F.col("head.cwd"), model=_text(v, "$.message.model"), ts=parse_rfc3339(_text(v, "$.timestamp")), quality=F.lit("reported"))
    events, faults = _split(shaped)
    return events, faults.union(_broken(parsed))


def parse_agy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimated usage of a planner's steps: a floor and what was said before them in its file, at four characters a token; their own characters as output.

    Tool calls count with the length of their JSON, written with a blank after
    each comma and colon.
    """
    parsed = parsed_json(lines, "text")
    v = F.col("v")
    field = lambda k: F.coalesce(F.length(_text(v, f"$.{k}")), F.lit(0))
    calls = F.try_variant_get(v, "$.tool_calls", "variant")
    json = F.to_json(calls)
    outside = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "")
    called = F.length(json) + F.length(outside) - F.length(F.translate(outside, ",:", ""))
    truthy = F.coalesce(~F.is_variant_null(calls) & ~json.isin("[]", "{}", "false", "0", '""'), F.lit(False))
    bad = F.lit(False)
    for k in ("type", "content", "thinking"):
        bad = bad | (_has(v, f"$.{k}") & _text(v, f"$.{k}").isNull())
    rows = parsed.where(v.isNotNull()).withColumn("fault", F.when(bad | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "wrong_field_type"))
    rows = rows.withColumn("chars", F.when(F.col("fault").isNull(), field("content") + field("thinking") + F.when(truthy, called).otherwise(0)).otherwise(0).cast("bigint"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("history", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    at = parse_rfc3339(_text(v, "$.created_at"))
    planner = _text(v, "$.type") == "PLANNER_RESPONSE"
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(planner & at.isNull(), "missing_required_field"))).where(F.coalesce(planner, F.lit(False)) | F.col("fault").isNotNull())
    session = F.nullif(F.regexp_extract("file", r"([^/]+)/\.system_generated(?:/|$)", 1), F.lit(""))
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("input", F.lit(FLOOR_TOKENS) + F.call_function("div", F.col("history"), F.lit(CHARS_PER_TOKEN))).withColumn("output", F.call_function("div", F.col("chars"), F.lit(CHARS_PER_TOKEN))).withColumn("cache_read", zero).withColumn("cache_write", zero)
    rows = rows.withColumn("unknown", F.create_map().cast("map<string,bigint>")).withColumn("missing", F.array().cast("array<string>"))
    shaped = _shaped(rows, session=F.concat(F.lit("agy:"), session), ts=at, quality=F.lit("estimated"))
    events, faults = _split(shaped)
    return events, faults.union(_broken(parsed))


def generated_output(output: Column, reasoning: Column, total: Column, rest: Column) -> Column:
    """The output behind one that was stored as output less reasoning, held at zero: null where the row doesn't prove it.

    rest: input and cache counts together. A negative output needs a total that
    equals the parts; a zero output with a total below the sum of the parts is
    the total less the rest; otherwise output and reasoning add up.
    """
    added = output + F.coalesce(reasoning, F.lit(0))
    negative = F.when(reasoning.isNotNull() & (added >= 0) & (total == rest + added), added)
    zero = F.when(total.isNull() | (total == rest + F.coalesce(reasoning, F.lit(0))), added).when(reasoning.isNotNull() & (total >= rest) & (total < rest + reasoning), total - rest)
    return F.when(output < 0, negative).when(output == 0, zero).otherwise(added)


#: Format to parser: a new format is a function here.
PARSERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {"claude-code": parse_claude, "codex": parse_codex, "pi": parse_pi, "agy": parse_agy}


def parse(lines: DataFrame, formats: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Events and quarantined lines of files by the first glob of (glob, format) that their path matches."""
    events = faults = None
    taken = F.lit(False)
    for glob, name in formats:
        here = F.col("file").like(to_like(glob))
        e, q = PARSERS[name](lines.where(here & ~taken))
        taken = taken | here
        e, q = e.withColumn("format", F.lit(name)), q.withColumn("format", F.lit(name))
        events, faults = (e, q) if events is None else (events.unionByName(e), faults.unionByName(q))
    return events, faults
