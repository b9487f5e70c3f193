"""SQLite files of agents and issue trackers as rows, and what they mean.

A file is read whole by one task, from any store that Spark reads; many files
are many tasks. Changes that still stand in a write-ahead log beside a file
are not seen.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Sequence
from contextlib import closing
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clock import parse_rfc3339
from .transcripts import _count, _has, _object, _shaped, _split, _text, generated_output, parsed_json, usage_fields

MESSAGES = ("SELECT id AS message_id, session_id, time_created, data FROM message ORDER BY rowid", "message_id string, session_id string, time_created bigint, data string")
DIRECTORIES = ("SELECT id AS session_id, directory FROM session", "session_id string, directory string")
TASK_RECORDS = (
    "SELECT id AS upstream_id, issue_id AS task, event_type, old_value, new_value, actor, created_at AS occurred_at FROM events ORDER BY id",
    "upstream_id bigint, task string, event_type string, old_value string, new_value string, actor string, occurred_at string",
)
# The names of an opencode message's components, what it repeats elsewhere, and what it must have.
OPENCODE = ({"input": "input", "cache.read": "cache_read", "cache.write": "cache_write"}, ("output", "total", "reasoning", "cache"), ("input",))


#: Bytes of a page of the databases that are written here, which are small, and of those that leave a task at a time.
PAGE, _BATCH = 1024, 8 << 20


def read_sqlite(spark: SparkSession, root: str, select: tuple[str, str], pattern: str = "*.db") -> DataFrame:
    """file, line and the columns of a query, (SQL, schema), over every matching file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return sqlite_rows(files, select)


def sqlite_rows(files: DataFrame, select: tuple[str, str]) -> DataFrame:
    """read_sqlite's rows over databases held as rows, files(path, content)."""
    sql, schema = select

    def found(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                # Bytes 18 and 19 name the log's kind; a file by itself has none beside it.
                content = content[:18] + b"\x01\x01" + content[20:]
                with closing(sqlite3.connect(":memory:")) as db:
                    db.deserialize(content)
                    for line, row in enumerate(db.execute(sql), 1):
                        yield path, line, *row

    names = ["file", "line", *StructType.fromDDL(schema).names]

    def rows(frames):
        # Small databases share a frame, large ones take many.
        each = found(frames)
        while part := list(islice(each, 5000)):
            yield pd.DataFrame(part, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(rows, f"file string, line bigint, {schema}")


def packed(messages: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """(path, content): a database of messages and their sessions for each group of messages(by, path, message_id, session_id, time_created, data, directory), written in memory by the task that meets the group's rows in order."""
    columns = ["message_id", "session_id", "time_created", "data", "directory"]

    def rows(batches):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            yield from zip(keys, batch.column(path).to_pylist(), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True)

    def databases(batches):
        for _, group in groupby(rows(batches), key=itemgetter(0)):
            with closing(sqlite3.connect(":memory:", isolation_level=None)) as db:
                db.execute(f"PRAGMA page_size = {PAGE}")
                db.execute("BEGIN")
                db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, data TEXT)")
                db.execute("CREATE TABLE session (id TEXT, directory TEXT)")
                named, at = {}, None
                for _, at, (message, session, created, data, directory) in group:
                    db.execute("INSERT INTO message VALUES (?, ?, ?, ?)", (message, session, created, data))
                    named[session, directory] = None
                db.executemany("INSERT INTO session VALUES (?, ?)", named)
                db.execute("COMMIT")
                yield at, db.serialize()

    def batched(batches):
        held, size = [], 0
        for at, content in databases(batches):
            held.append((at, content))
            size += len(content)
            if size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["path", "content"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in held], pa.string()), pa.array([c for _, c in held], pa.binary())], ["path", "content"])

    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = messages.select(*dict.fromkeys([*by, path, *columns])).repartition(tasks, *by).sortWithinPartitions(*by, F.asc_nulls_last("message_id"))
    return dealt.mapInArrow(batched, "path string, content binary")


def parse_opencode(messages: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined) of message rows; users' messages carry no usage. An output that was stored as a difference counts only where the row proves it."""
    v, u = F.col("v"), F.col("u")
    parsed = parsed_json(messages, "data")
    parsed = parsed.withColumn("whole", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    broken = parsed.where(~F.col("whole")).select("file", "line", F.lit("truncated_structure").alias("class"))
    rows = parsed.where(F.col("whole") & F.coalesce(_text(v, "$.role") != "user", F.lit(True))).withColumn("u", F.try_variant_get(v, "$.tokens", "variant"))
    rows = usage_fields(rows, "u", OPENCODE)
    output, reasoning, total = F.try_variant_get(u, "$.output", "bigint"), _count(u, "$.reasoning"), _count(u, "$.total")
    stated = _has(u, "$.output")
    whole = F.coalesce(F.schema_of_variant(F.try_variant_get(u, "$.output", "variant")).startswith("BIGINT"), F.lit(False))
    generated = F.when(~stated, F.coalesce(reasoning, F.lit(0))).when(whole, generated_output(output, reasoning, total, F.col("input") + F.col("cache_read") + F.col("cache_write")))
    wrong = (_has(u, "$.reasoning") & reasoning.isNull()) | (stated & (output <= 0) & _has(u, "$.total") & total.isNull()) | (_has(u, "$.cache") & ~_object(u, "$.cache")) | generated.isNull()
    fault = F.when(~_has(v, "$.tokens"), "missing_required_field").when(~_object(v, "$.tokens"), "wrong_field_type").otherwise(F.coalesce("fault", F.when(wrong, "wrong_field_type")))
    rows = rows.withColumn("fault", fault).withColumn("output", generated).withColumn("missing", F.concat(F.when(stated, F.array().cast("array<string>")).otherwise(F.array(F.lit("output"))), "missing"))
    millis = F.coalesce(_count(v, "$.time.completed"), _count(v, "$.time.created"), F.when(F.col("time_created") >= 0, F.col("time_created")))
    model = F.nullif(F.concat_ws("/", _text(v, "$.providerID"), _text(v, "$.modelID")), F.lit(""))
    named = directories.select("file", "session_id", F.col("directory").alias("at")).dropDuplicates(["file", "session_id"])
    rows = rows.join(named, ["file", "session_id"], "left")
    shaped = _shaped(rows, event_id=F.col("message_id"), session=F.concat(F.lit("opencode:"), F.col("session_id")), directory=F.col("at"), model=model, ts=millis * 1_000_000, quality=F.lit("reported"))
    events, faults = _split(shaped)
    return events, faults.union(broken)


def task_events(records: DataFrame, tracker: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined) of a tracker's records: work begins when the status becomes in_progress and ends when it leaves it. A record without a readable time is set aside."""
    at = parse_rfc3339(F.col("occurred_at"))
    moved = F.col("event_type") == "status_changed"
    kind = F.when(moved & (F.col("new_value") == "in_progress"), "claim").when(moved & (F.col("old_value") == "in_progress"), "release").otherwise(F.concat(F.lit("unknown:"), F.col("event_type")))
    rows = records.select(F.lit(tracker).alias("tracker"), "upstream_id", "task", at.alias("ts"), kind.alias("kind"), F.nullif("actor", F.lit("")).alias("actor"), "occurred_at")
    events = rows.where("ts is not null").drop("occurred_at")
    return events, rows.where("ts is null").select("tracker", "upstream_id", F.col("occurred_at").alias("raw"), F.lit("unusable timestamp").alias("reason"))


def unseen(events: DataFrame, stored: DataFrame) -> DataFrame:
    """One event for each identity (tracker, upstream_id) that is not stored yet, so that an ingest can be repeated."""
    return events.dropDuplicates(["tracker", "upstream_id"]).join(stored.select("tracker", "upstream_id"), ["tracker", "upstream_id"], "left_anti")
