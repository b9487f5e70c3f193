"""Conversations as Markdown in parts of bounded size.

Messages are placed by running sums of their lengths: within bins of turns,
and over the bins of a conversation, so that no task sees a whole conversation.
Each message is cut where parts end; a part gathers its pieces only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most code points of a part.
PART = 65_536
#: Turns of a bin.
BIN = 256


def clean_text(text: Column) -> Column:
    """A block's text without system reminders and injected skills (one that isn't closed goes to the end) and without blanks around it; null where nothing is left."""
    for tag in ("system-reminder", "skill"):
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?(</{tag}>|\z)", "")
    blank = r"\p{IsWhite_Space}"
    return F.nullif(F.regexp_replace(text, rf"\A{blank}+|(?<!{blank}){blank}+\z", ""), F.lit(""))


def message_lines(role: Column, text: Column, tools: Column | None = None, thinking: Column | None = None) -> Column:
    """One message as Markdown; null where it shows nothing or where its role is neither user nor assistant.

    tools is array<struct<name, input, result>>, thinking an array of texts;
    both are shown where given. Nothing is shortened.
    """
    heading = F.when(role == "user", "\n## User\n").when(role == "assistant", "\n## Assistant\n")
    body = [F.coalesce(F.concat(clean_text(text), F.lit("\n")), F.lit(""))]
    if tools is not None:
        result = lambda c: F.when(F.length(c["result"]) > 0, F.concat(F.lit("**Tool result:**\n"), c["result"], F.lit("\n"))).otherwise("")
        call = lambda c: F.concat(F.lit("**Tool: "), F.coalesce(c["name"], F.lit("unknown")), F.lit("**\n```json\n"), F.coalesce(c["input"], F.lit("null")), F.lit("\n```\n"), result(c))
        body.append(F.coalesce(F.array_join(F.transform(tools, call), ""), F.lit("")))
    if thinking is not None:
        body.append(F.coalesce(F.array_join(F.transform(F.flatten(F.transform(thinking, lambda b: F.split(F.regexp_replace(b, "\n\\z", ""), "\n"))), lambda x: F.concat(F.lit("> "), x, F.lit("\n"))), ""), F.lit("")))
    whole = F.concat(*body)
    return F.when(whole != "", F.concat(heading, whole))


def parts(turns: DataFrame, headers: DataFrame, key: str, part: int = PART, width: int = BIN) -> DataFrame:
    """(key, part, parts, text): each conversation's header and lines, cut into parts of `part` code points; in order they give the whole.

    turns is (key, turn bigint, line); null turns come first, ties by line. Null
    lines aren't shown. headers is (key, header), one row for each conversation,
    also those without a turn; conversations without a header aren't written. A
    turn number that repeats without end is sorted, by spilling, in one task.
    """
    shown = turns.where(F.col("line").isNotNull()).select(key, "turn", "line", F.call_function("div", F.col("turn"), F.lit(width)).alias("bin"), F.length("line").cast("bigint").alias("n"))
    bins = shown.groupBy(key, "bin").agg(F.sum("n").alias("n"))
    heads = headers.select(key, "header", F.length("header").cast("bigint").alias("head"))
    offsets = bins.join(heads.drop("header"), key).withColumn("start", F.col("head") + F.sum("n").over(Window.partitionBy(key).orderBy(F.col("bin").asc_nulls_first())) - F.col("n"))
    a, b = shown.alias("a"), offsets.select(key, "bin", "start").alias("b")
    placed = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.col("a.bin").eqNullSafe(F.col("b.bin"))).select("a.*", "b.start")
    inside = Window.partitionBy(key, "bin").orderBy(F.col("turn").asc_nulls_first(), "line")
    placed = placed.withColumn("start", F.col("start") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    lines = placed.select(key, "start", "n", "line").unionByName(heads.select(key, F.lit(0).cast("bigint").alias("start"), F.col("head").alias("n"), F.col("header").alias("line"))).where("n > 0")
    first, last = (F.call_function("div", at, F.lit(part)) for at in (F.col("start"), F.col("start") + F.col("n") - 1))
    # Four bytes a code point: a piece is found without walking over the text before it.
    cut = lines.select(key, "start", "n", F.encode("line", "UTF-32").alias("wide"), F.explode(F.sequence(first, last)).alias("part"))
    lo, hi = F.greatest(F.col("part") * part, F.col("start")), F.least((F.col("part") + 1) * part, F.col("start") + F.col("n"))
    pieces = cut.select(key, "part", lo.alias("at"), F.decode(F.substring("wide", (4 * (lo - F.col("start")) + 1).cast("int"), (4 * (hi - lo)).cast("int")), "UTF-32").alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    out = pieces.groupBy(key, "part").agg(text.alias("text"))
    ends = bins.groupBy(key).agg(F.sum("n").alias("n")).join(heads.drop("header"), key, "right").select(key, F.call_function("div", F.coalesce("n", F.lit(0)) + F.col("head") + part - 1, F.lit(part)).alias("parts"))
    return out.join(ends, key).select(key, "part", "parts", "text")
