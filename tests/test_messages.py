"""Messages of two harnesses, with results paired to their calls, on small transcripts."""

import json

from meterlake.operators.segments import message_lines
from meterlake.sources import messages


def lines(spark, *records, file="f"):
    return spark.createDataFrame([(file, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "file string, line int, text string")


def said(role, content, **more):
    return {"message": {"role": role, "content": content}, **more}


def plain(df):
    return [(r.line, r.role, r.text, [tuple(t) for t in r.tools], r.thinking) for r in df.orderBy("line").collect()]


def test_first_format(spark):
    call = lambda i, **x: {"type": "tool_use", "id": i, "name": "run", "input": x}
    result = lambda i, c: {"type": "tool_result", "tool_use_id": i, "content": c}
    got = plain(messages.claude_messages(lines(
        spark, said("user", " hi <system-reminder>x</system-reminder>"), said("assistant", [{"type": "thinking", "thinking": "a\nb"}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}, call("1", k=1), call("2", k=2)]),
        said("user", [result("1", "early")]), said("user", [result("1", [{"text": "late"}, "more", 3]), result("9", "lost")]), said("assistant", [call("1", k=3)]), said("user", [result("1", None)]), said("user", "meta", isMeta=True), said("system", "no"),
        {"type": "summary", **said("user", "no")}, "{broken", said("user", None), said("user", "<skill>only"), said("user", [result("", "bare"), call("", k=4)]),
    )))
    assert got == [
        (0, "user", "hi", [], []),
        (1, "assistant", "one\n\ntwo", [("run", '{"k":1}', "late\nmore"), ("run", '{"k":2}', "")], ["a\nb"]),
        (3, "user", None, [("(unknown)", "null", "lost")], []),
        (4, "assistant", None, [("run", '{"k":3}', "")], []),
        (12, "user", None, [("run", '{"k":4}', ""), ("(unknown)", "null", "bare")], []),
    ]


def test_third_format_and_what_it_skips(spark):
    result = lambda i, c: {"type": "message", "message": {"role": "toolResult", "toolCallId": i, "content": c}}
    shown, skipped = messages.pi_messages(lines(
        spark, {"type": "session", "id": "s"}, {"type": "message", **said("user", [{"type": "text", "text": "go"}])}, {"type": "message", **said("assistant", [{"type": "toolCall", "id": "c", "name": "ls", "arguments": {"p": "."}}, {"type": "image"}])},
        result("c", [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]), result("none", "z"), {"type": "message", **said("robot", [])}, {"type": "message", **said("user", "text")}, {"type": "odd"}, {"n": 1}, "{",
    ))
    assert plain(shown) == [(1, "user", "go", [], []), (2, "assistant", None, [("ls", '{"p":"."}', "x\ny")], []), (4, "assistant", None, [("(unknown)", "null", "z")], [])]
    assert {r.skipped: r.n for r in skipped.collect()} == {"block:image": 1, "role:robot": 1, "content:non_array": 1, "odd": 1, "untyped": 1, "unparseable": 1}


def test_files_are_apart_and_empty_input_shows_nothing(spark):
    call = said("assistant", [{"type": "tool_use", "id": "1", "name": "f", "input": None}])
    answer = said("user", [{"type": "tool_result", "toolUseID": "1", "content": "r"}])
    both = lines(spark, call, file="a").union(lines(spark, "", answer, file="b"))
    assert [(r.file, r.tools[0].name, r.tools[0].result) for r in messages.claude_messages(both).orderBy("file").collect()] == [("a", "f", ""), ("b", "(unknown)", "r")]
    assert messages.claude_messages(both.limit(0)).count() == 0 and messages.pi_messages(both.limit(0))[1].count() == 0


def test_shown_as_markdown(spark):
    df = messages.claude_messages(lines(spark, said("assistant", [{"type": "text", "text": "t"}, {"type": "tool_use", "id": "1", "name": "f", "input": {}}]), said("user", [{"type": "tool_result", "tool_use_id": "1", "content": "r"}])))
    assert [r[0] for r in df.select(message_lines(df.role, df.text, df.tools, df.thinking)).collect()] == ["\n## Assistant\nt\n**Tool: f**\n```json\n{}\n```\n**Tool result:**\nr\n"]
