"""Transcripts, quota bodies, incremental ingest."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from meterlake.operators import attribution, records
from meterlake.sources import databases, quotas, transcripts
from meterlake.sources import published
from meterlake.sources.messages import claude_messages
from meterlake.streaming import ingest


def _write(path, records, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records) + tail)


def test_messages_with_fallback_unknown_and_faults(spark, tmp_path):
    use = lambda **u: {"timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"id": "m", "model": "x", "usage": u}}
    _write(tmp_path / "a.jsonl", [use(input_tokens=1, output_tokens=2, cache_creation={"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}, odd=9), use(output_tokens=1), use(input_tokens="1"), {"type": "other"}], '{"message": \n{"half')
    events, faults = transcripts.parse_claude(transcripts.read_lines(spark, str(tmp_path)))
    (e,) = events.collect()
    assert (e.input, e.output, e.cache_write, e.unknown, e.missing, e.session) == (1, 2, 7, {"odd": 9}, ["cache_read"], "claude-code:s")
    assert sorted(r["class"] for r in faults.collect()) == ["missing_required_field", "truncated_structure", "wrong_field_type"]


def test_cumulative_files_give_their_last_total(spark, tmp_path):
    total = lambda n: {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "output_tokens": 1}}}}
    turn = lambda m: {"type": "turn_context", "payload": {"model": m}}
    head = {"type": "session_meta", "payload": {"id": "t1", "cwd": "/w", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "t0"}}}}}
    _write(tmp_path / "c.jsonl", [head, turn("m1"), total(5), turn("m2"), total(9), turn("m3")])
    events, _ = transcripts.parse_codex(transcripts.read_lines(spark, str(tmp_path)))
    (e,) = events.collect()
    assert (e.input, e.model, e.session, e.parent, e.directory) == (9, "m2", "codex:t1", "codex:t0", "/w")


def test_generated_output(spark):
    rows = spark.createDataFrame([(-3, 10, 20, 13), (0, 5, 17, 13), (0, 5, 18, 13), (0, None, None, 13), (4, 2, None, 1), (-3, None, 1, 1), (0, 5, 99, 13)], "o bigint, r bigint, t bigint, rest bigint")
    got = [r.g for r in rows.select(transcripts.generated_output(*(F.col(c) for c in ("o", "r", "t", "rest"))).alias("g")).collect()]
    assert got == [7, 4, 5, 0, 6, None, None]


def test_quota_bodies(spark):
    body = lambda j: spark.createDataFrame([("b", json.dumps(j), 0)], "body string, text string, observed bigint")
    rows = {(r.key, r.scope_kind, r.scope_name): (r.used_ppm, r.reset_kind) for r in quotas.anthropic_windows(body({"five_hour": {"utilization": 27.0, "resets_at": None}, "seven_day": {"utilization": 91.5, "resets_at": "2024-01-01T00:00:00Z"}, "seven_day_opus": {"utilization": 1, "resets_at": None}})).collect()}
    assert rows == {("five_hour", "account", None): (270_000, "not_started"), ("seven_day", "account", None): (915_000, "known"), ("seven_day", "model", "opus"): (10_000, "not_started")}
    rows = quotas.codex_windows(body({"payload": {"rate_limits": {"primary": {"used_percent": 0, "window_minutes": 300, "resets_at": 18001}, "secondary": {"used_percent": 12, "window_minutes": 10080, "resets_at": 99}}}})).collect()
    assert sorted((r.key, r.used_ppm, r.reset_kind) for r in rows) == [("10080m", 120_000, "known"), ("300m", 0, "not_started")]
    (row,) = quotas.agy_windows(body({"groups": [{"buckets": [{"bucketId": "g", "window": "5h", "resetTime": "2024-01-01T00:00:00Z", "remainingFraction": 0.25}]}]})).collect()
    assert (row.used_ppm, row.scope_kind) == (750_000, "group")
    rows = quotas.opencode_windows(body({"access": {"meters": {"week": {"limitMicroCents": "3000", "usedMicroCents": "1000"}, "bad": {"limitMicroCents": "x"}}}})).collect()
    assert [(r.key, r.used_ppm) for r in rows] == [("week", 333_333)]
    rows = quotas.ollama_windows(body({"limits": {"session": {"usage": 0.271}, "weekly": {"usage": 0.4}}})).collect()
    assert sorted((r.key, r.used_ppm, r.reset_at) for r in rows) == [("session", 271_000, 18_000 * 10**9), ("weekly", 400_000, 604_800 * 10**9)]


def test_rate_book(spark, tmp_path):
    (tmp_path / "r.toml").write_text('[[card]]\nvendor="v"\nmodel="m"\ntoken_class="input"\nrate="1.25"\ncurrency="USD"\neffective_start="2024-01-01"\n[card.schedule]\ndays=["mon","tue"]\nhours_utc="08:00-17:30"\n')
    (row,) = quotas.read_rate_book(spark, str(tmp_path / "r.toml")).collect()
    assert (row.rate, row.days, row.from_min, row.to_min, row.end) == (1_250_000, 3, 480, 1050, None)


def test_formats_by_path(spark, tmp_path):
    """Each file goes to the parser of the first glob that its path matches, and is read from disk."""
    at = "2024-01-01T00:00:00Z"
    _write(tmp_path / "pi" / "a.jsonl", [{"type": "session", "id": "s", "cwd": "/w"}, {"type": "message", "id": "o", "timestamp": at, "message": {"id": "m", "model": "x", "usage": {"input": 4, "output": 2, "cacheRead": 1}}}, {"type": "message", "message": {"usage": {"output": 2}}}])
    _write(tmp_path / "run" / ".system_generated" / "b.jsonl", [{"type": "USER", "content": "x" * 40}, {"type": "PLANNER_RESPONSE", "created_at": at, "content": "y" * 9}, {"type": "PLANNER_RESPONSE"}])
    hidden = ("*/.system_generated",)
    found = transcripts.discover(spark, str(tmp_path), hidden=hidden).collect()
    assert [r.file.rsplit("/", 1)[1] for r in found] == ["a.jsonl", "b.jsonl"] and all(r.size > 0 for r in found)
    events, faults = transcripts.parse(transcripts.read_lines(spark, str(tmp_path), hidden=hidden), [("*/pi/*", "pi"), ("*", "agy")])
    got = {(e.format, e.session): (e.input, e.output, e.cache_read, e.quality) for e in events.collect()}
    assert got == {("pi", "pi:s"): (4, 2, 1, "reported"), ("agy", "agy:run"): (34_492 + 10, 2, 0, "estimated")}
    assert sorted((r["format"], r["line"], r["class"]) for r in faults.collect()) == [("agy", 3, "missing_required_field"), ("pi", 3, "missing_required_field")]


def test_projection_generations(spark, tmp_path):
    """A projection is replaced by its own or a later generation only; what is missing or old says so."""
    path, schema = str(tmp_path / "p"), "account int, used int, generation bigint"
    accounts = spark.createDataFrame([(1,), (2,), (3,)], "account int")
    records.publish(spark.createDataFrame([(1, 5, 7), (1, 6, 8), (2, 9, 3)], schema), path, ["account"], ["generation"])
    got = {r.account: (r.state, r.reason, r.used) for r in records.read_projection(spark, path, accounts, "account", 2).collect()}
    assert got == {1: ("available", None, 6), 2: ("stale", "old_generation", 9), 3: ("unavailable", "missing", None)}
    with pytest.raises(ValueError, match="older"):
        records.publish(spark.createDataFrame([(3, 1, 7)], schema), path, ["account"], ["generation"])
    records.publish(published.read(spark, path)[0].union(spark.createDataFrame([(3, 1, 9)], schema)), path, ["account"], ["generation"])
    assert records.read_projection(spark, path, accounts, "account", 9).where("state = 'available'").count() == 3


def test_ancestors_of_long_chains_and_cycles(spark):
    rows = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 100), (102, None)]
    got = {(r.session, r.ancestor): r.depth for r in records.ancestors(spark.createDataFrame(rows, "session int, parent int")).collect()}
    assert got[0, 70] == 70 and sum(s == 0 for s, _ in got) == 70 and {k for k in got if k[0] >= 100} == {(100, 101), (101, 100), (100, 100), (101, 101)}


def test_batches_in_any_split_give_one_ledger(spark, tmp_path):
    rows = [(f"m{i % 7}", i, i * 3 % 11, i % 5, 0, 0) for i in range(60)]
    schema = "native_id string, ts bigint, input bigint, output bigint, cache_read bigint, cache_write bigint"
    whole = spark.createDataFrame(rows, schema)
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest.ingest_stream(spark, str(tmp_path / "in"), whole.schema, str(tmp_path / "ledger"), str(tmp_path / "cp"), files_per_batch=1)
    query.awaitTermination(120)
    last = max(int(p.name.partition("=")[2]) for p in (tmp_path / "ledger").iterdir() if p.name.startswith("generation="))
    got = spark.read.parquet(str(tmp_path / "ledger" / f"generation={last}"))
    key = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert last == 3 and key(got) == key(ingest.summarize(whole))


def test_change_classes(spark):
    stored = spark.createDataFrame([("a", "i", 10, 1, 1), ("b", "i", 10, 1, 1), ("c", "i", 10, 1, 1), ("d", "i", 10, 1, 0), ("e", "i", 10, 1, 1)], "path string, identity string, size bigint, mtime bigint, parser_version int")
    now = spark.createDataFrame([("a", "i", 10, 1), ("b", "i", 12, 2), ("c", "j", 12, 2), ("d", "i", 10, 1), ("e", "i", 3, 2), ("f", "i", 1, 1)], "path string, identity string, size bigint, mtime bigint")
    got = {r.path: r.change for r in ingest.changes(stored, now, 1).collect()}
    assert got == {"a": "unchanged", "b": "appended", "c": "rebuild_required", "d": "parser_version_changed", "e": "rebuild_required", "f": "new"}


def test_contended_claims(spark):
    claims = spark.createDataFrame([(1, 10, "task-A", "claim"), (1, 20, "task-B", "claim"), (1, 20, "task-C", "claim"), (1, 30, "task-B", "release"), (1, 40, "task-D", "claim"), (1, 50, "task-D", "release"), (1, 60, "task-D", "noise")], "session int, ts bigint, task string, kind string")
    usage = spark.createDataFrame([(1, t) for t in (5, 10, 25, 35, 45, 55)] + [(2, 5)], "session int, ts bigint")
    got = {(r.session, r.ts): r.bucket for r in attribution.attribute_tasks(usage, claims).collect()}
    assert got == {(1, 5): "before_first_claim", (1, 10): "task-A", (1, 25): "contended", (1, 35): "contended", (1, 45): "task-D", (1, 55): "after_release_with_no_next_claim", (2, 5): "unclaimed_session"}


def test_ancestors_in_cycles(spark):
    s = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, None), (5, 3)], "session int, parent int")
    m = spark.createDataFrame([(4,)], "session int")
    got = {r.session: (r.ancestor, r.depth) for r in attribution.governing_ancestor(s, m).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (4, 1), 4: (4, 0), 5: (4, 2)}
    chain = spark.createDataFrame([("x", i, i + 1) for i in range(90)] + [("y", 90, None)], "space string, session int, parent int")
    got = {(r.space, r.session): (r.ancestor, r.depth) for r in attribution.governing_ancestor(chain, spark.createDataFrame([("x", 90), ("y", 7)], "space string, session int"), ["space"]).collect()}
    assert got["x", 0] == (90, 90) and got["x", 89] == (90, 1) and got["y", 90] == (None, None)


def test_messages_of_a_database(spark, tmp_path):
    use = lambda **tokens: {"role": "assistant", "providerID": "p", "modelID": "m", "time": {"created": 1, "completed": 2}, "tokens": tokens}
    records = [
        use(input=3, output=5, reasoning=2, cache={"read": 1, "write": 4}, odd=6),
        use(input=3, output=-3, reasoning=10, total=10),
        use(input=3, output=-3, reasoning=10, total=11),
        use(input=3),
        use(output=1),
        use(input=3, output=1, cache=7),
        {"role": "user"},
        {"role": "assistant"},
    ]
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
    db.execute("CREATE TABLE session (id TEXT, directory TEXT)")
    db.execute("INSERT INTO session VALUES ('s', '/w')")
    db.executemany("INSERT INTO message VALUES (?, 's', 9, ?)", [(f"m{i}", json.dumps(r)) for i, r in enumerate(records)] + [("m8", "{half")])
    db.commit()
    db.close()
    read = lambda select: databases.read_sqlite(spark, str(tmp_path), select)
    events, faults = databases.parse_opencode(read(databases.MESSAGES), read(databases.DIRECTORIES))
    got = {e.event_id: e for e in events.collect()}
    assert sorted(got) == ["m0", "m1", "m3"]
    e = got["m0"]
    assert (e.input, e.output, e.cache_read, e.cache_write, e.unknown, e.missing) == (3, 7, 1, 4, {"odd": 6}, [])
    assert (e.session, e.directory, e.model, e.ts) == ("opencode:s", "/w", "p/m", 2_000_000)
    assert got["m1"].output == 7 and got["m3"].missing == ["output", "cache_read", "cache_write"]
    assert sorted((r["line"], r["class"]) for r in faults.collect()) == [(3, "wrong_field_type"), (5, "missing_required_field"), (6, "wrong_field_type"), (8, "missing_required_field"), (9, "truncated_structure")]


def test_tracker_records_without_a_time_are_set_aside(spark):
    rows = [(1, "t", "status_changed", "open", "in_progress", "", "2024-01-01T00:00:00Z"), (2, "t", "status_changed", "in_progress", "closed", "x", "2024-01-01T00:00:01Z"), (3, "t", "note", None, None, None, "soon")]
    events, aside = databases.task_events(spark.createDataFrame(rows, databases.TASK_RECORDS[1]), "k")
    assert sorted((e.upstream_id, e.kind, e.actor) for e in events.collect()) == [(1, "claim", None), (2, "release", "x")]
    assert [(r.upstream_id, r.raw) for r in aside.collect()] == [(3, "soon")]
    assert databases.unseen(events.union(events), events.where("upstream_id = 1")).count() == 1


def test_lines_of_a_file_are_numbered_over_its_blocks(spark, tmp_path):
    bodies = {"a b+c%20.jsonl": "﻿x\n\n y \nz".encode(), "long.jsonl": b"".join(b"line %d\r\n" % i for i in range(40)), "bad.jsonl": b"a\xff\n\xfe", "none.jsonl": b"", "blank.jsonl": b"\n\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line): r.text for r in transcripts.read_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("a b+c%20.jsonl", 1): "x", ("a b+c%20.jsonl", 3): "y", ("bad.jsonl", 1): "a�"} | {("long.jsonl", i + 1): f"line {i}\r" for i in range(40)}
    assert got == want


def test_a_short_range_reads_little_more_than_its_own_bytes():
    from io import BytesIO

    from meterlake.sources.ranges import lines_between

    class Counted(BytesIO):
        taken = 0

        def read(self, n=-1):
            block = super().read(n)
            self.taken += len(block)
            return block

    body = b"".join(b"line %d\n" % i for i in range(100_000)) + b"x" * 5000 + b"\nend\n"
    source = Counted(body)
    got = [line for a in range(0, len(body), 4096) for line in lines_between(source, a, min(a + 4096, len(body)), len(body))]
    assert b"\n".join(line for _, _, line in got) + b"\n" == body and [a for a, _, _ in got] == [0, *[b for _, b, _ in got[:-1]]]
    assert source.taken < 1.2 * len(body)


def _parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_a_line_is_parsed_once_for_each_result(spark):
    lines = spark.createDataFrame([("f", 1, "{}")], "file string, line int, text string")
    events, faults = transcripts.parse_claude(lines)
    native = spark.createDataFrame([], "account bigint, since bigint")
    messages = spark.createDataFrame([("f", 1, "m", "s", 1, "{}")], "file string, line int, message_id string, session_id string, time_created bigint, data string")
    found = databases.parse_opencode(messages, messages.selectExpr("file", "session_id", "'d' AS directory"))[0]
    shown = claude_messages(lines)
    assert [_parses(x) for x in (events, transcripts.parse_pi(lines)[0], records.legacy_import(lines, native), found)] == [1, 1, 1, 1] and _parses(faults) == 2
    assert _parses(shown) == 8  # calls, results, orphans and what is shown, each of texts and of blocks
