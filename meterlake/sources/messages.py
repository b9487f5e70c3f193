"""Transcripts' lines as messages to show: roles, texts, thinking, and tool calls with their results, which stand in later lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.segments import clean_text
from .transcripts import _text, once, parsed_json

#: The name of a call that only its result tells of.
UNNAMED = "(unknown)"
#: Lines of the second format that are no conversation (fixed values).
SETUP = ("session", "model_change", "thinking_level_change")
_BLOCKS = "array<variant>"


def _said(v: Column, path: str) -> Column:
    """A result's whole text: a string as it is, of an array the strings and texts in it, a line each, else empty."""
    parts = F.try_variant_get(v, path, _BLOCKS)
    inner = F.filter(F.transform(parts, lambda p: F.coalesce(_text(p, "$"), _text(p, "$.text"))), lambda x: x.isNotNull())
    return F.coalesce(_text(v, path), F.array_join(inner, "\n"), F.lit(""))


def _content(rows: DataFrame) -> DataFrame:
    """rows(file, line, v) with role, pos and b: a row for each block of a message's content."""
    kept = rows.select("file", "line", _text(F.col("v"), "$.message.role").alias("role"), F.try_variant_get("v", "$.message.content", _BLOCKS).alias("blocks"))
    return kept.select("file", "line", "role", F.posexplode("blocks").alias("pos", "b"))


def _block(kind: Column, text: Column, id: Column, b: Column, input: str) -> list[Column]:
    whole = F.try_variant_get(b, f"$.{input}", "variant")
    return [kind.alias("kind"), text.alias("text"), F.nullif(id, F.lit("")).alias("id"), F.coalesce(_text(b, "$.name"), F.lit(UNNAMED)).alias("name"), F.coalesce(F.to_json(whole), F.lit("null")).alias("input")]


def assemble(blocks: DataFrame) -> DataFrame:
    """(file, line, role, text, tools, thinking) of blocks(file, line, pos, role, kind, text, id, name, input).

    A result goes to the last call before it in its file that has its id, of
    several results of a call the last holds. A result without a call is shown
    where it stands, as an unnamed call behind the message's own. Lines that are
    left with nothing have no row. A message's blocks, all of one line, are
    gathered; a file's are not. What isn't a call and has no text or kind isn't shown.
    """
    blocks = once(blocks, **{c: F.col(c) for c in ("kind", "text", "id", "name", "input")}).where("kind = 'call' or text is not null and kind is not null")
    place = F.struct("line", "pos")
    tied = blocks.where(F.col("kind").isin("call", "result") & F.col("id").isNotNull())
    so_far = Window.partitionBy("file", "id").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, 0)
    met = tied.withColumn("at", F.last(F.when(F.col("kind") == "call", place), ignorenulls=True).over(so_far)).where("kind = 'result'")
    paired = met.where("at is not null").groupBy("file", F.col("at.line").alias("line"), F.col("at.pos").alias("pos")).agg(F.max_by("text", place).alias("result"))
    orphans = blocks.where("kind = 'result' and id is null").unionByName(met.where("at is null").drop("at"))
    shown = blocks.where("kind <> 'result'").join(paired, ["file", "line", "pos"], "left").unionByName(orphans.withColumn("result", F.col("text")))
    in_order = lambda kind, *cols: F.array_sort(F.collect_list(F.when(kind, F.struct(*cols))))
    kind = F.col("kind")
    tool = F.struct(F.when(kind == "result", UNNAMED).otherwise(F.col("name")).alias("name"), F.when(kind == "result", "null").otherwise(F.col("input")).alias("input"), F.coalesce("result", F.lit("")).alias("result")).alias("tool")
    per = shown.groupBy("file", "line").agg(
        F.max("role").alias("role"), in_order(kind == "text", "pos", "text").alias("texts"), in_order(kind == "thinking", "pos", "text").alias("thoughts"),
        in_order(kind.isin("call", "result"), (kind == "result").alias("late"), "pos", tool).alias("calls"),
    )
    text = F.nullif(F.array_join(F.transform("texts", lambda t: t["text"]), "\n\n"), F.lit(""))
    return per.select("file", "line", "role", text.alias("text"), F.transform("calls", lambda c: c["tool"]).alias("tools"), F.transform("thoughts", lambda t: t["text"]).alias("thinking"))


def claude_messages(lines: DataFrame) -> DataFrame:
    """assemble's rows of lines(file, line, text), (file, line) being unique, in the first harness's format.

    Contents are a string or an array of text, tool_use, tool_result and
    thinking blocks. Summaries, meta lines, other roles, and what isn't JSON
    show nothing.
    """
    v, b = F.col("v"), F.col("b")
    rows = parsed_json(lines, "text").select("file", "line", "v")
    rows = rows.where(_text(v, "$.message.role").isin("user", "assistant") & ~F.coalesce(_text(v, "$.type") == "summary", F.lit(False)) & ~F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)))
    of = _text(b, "$.type")
    kind = F.when(of.isin("text", "thinking"), of).when(of == "tool_use", "call").when(of == "tool_result", "result")
    text = F.when(of == "text", clean_text(_text(b, "$.text"))).when(of == "thinking", clean_text(_text(b, "$.thinking"))).when(of == "tool_result", _said(b, "$.content"))
    id = F.when(of == "tool_use", _text(b, "$.id")).otherwise(F.coalesce(_text(b, "$.toolUseID"), _text(b, "$.tool_use_id")))
    blocks = _content(rows).select("file", "line", "pos", "role", *_block(kind, text, id, b, "input"))
    plain = rows.select("file", "line", F.lit(0).alias("pos"), _text(v, "$.message.role").alias("role"), F.lit("text").alias("kind"), clean_text(_text(v, "$.message.content")).alias("text"))
    return assemble(blocks.unionByName(plain, allowMissingColumns=True))


def pi_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assemble's rows of lines(file, line, text) in the third harness's format, and (file, skipped, n) of what is neither shown nor setup.

    Contents are arrays of text, thinking and toolCall blocks; a result is a
    message of its own, shown as the assistant's where its call is missing.
    """
    v, b = F.col("v"), F.col("b")
    rows = parsed_json(lines, "text").select("file", "line", "v").withColumn("type", _text(v, "$.type"))
    role = _text(v, "$.message.role")
    spoken = rows.where((F.col("type") == "message") & F.is_variant_null(F.try_variant_get(v, "$.message", "variant")).isNotNull())
    turns = spoken.where(role.isin("user", "assistant"))
    of = _text(b, "$.type")
    content = _content(turns)
    kind = F.when(of.isin("text", "thinking"), of).when(of == "toolCall", "call")
    text = F.when(of == "text", clean_text(_text(b, "$.text"))).when(of == "thinking", clean_text(_text(b, "$.thinking")))
    blocks = content.select("file", "line", "pos", "role", *_block(kind, text, _text(b, "$.id"), b, "arguments"))
    results = spoken.where(role == "toolResult").select("file", "line", F.lit(0).alias("pos"), F.lit("assistant").alias("role"), F.lit("result").alias("kind"), _said(v, "$.message.content").alias("text"), F.nullif(_text(v, "$.message.toolCallId"), F.lit("")).alias("id"))
    shown = assemble(blocks.unionByName(results, allowMissingColumns=True))
    named = lambda what, c: F.concat(F.lit(f"{what}:"), F.coalesce(c, F.lit("untyped")))
    array = F.try_variant_get(v, "$.message.content", _BLOCKS)
    whole = (
        F.when(v.isNull(), "unparseable").when(F.col("type").isNull(), "untyped").when(F.col("type").isin(*SETUP), None).when(F.col("type") != "message", F.col("type"))
        .when(F.coalesce(role, F.lit("")).isin("user", "assistant"), F.when(array.isNull(), "content:non_array")).when(F.coalesce(role, F.lit("")) != "toolResult", named("role", role))
    )
    odd = content.where(kind.isNull()).select("file", named("block", of).alias("skipped"))
    skipped = rows.select("file", whole.alias("skipped")).unionByName(odd).where("skipped is not null").groupBy("file", "skipped").agg(F.count("*").alias("n"))
    return shown, skipped
