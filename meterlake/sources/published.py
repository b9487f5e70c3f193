"""What is published as a whole: generations in folders of their own, and a small file that is renamed into place to name the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .staging import _folder

SCHEMA_VERSION = 1
#: Bytes that a pointer may have.
MOST_BYTES = 1 << 16


class Refused(ValueError):
    """A generation older than the published one."""


class Unavailable(Exception):
    """A projection that can't be read; reason is one of missing, too_large, malformed, unsupported_schema."""

    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def write_pointer(spark: SparkSession, path: str, document: dict) -> None:
    """Write a small JSON file beside its place and rename it there: a reader sees the old or the new one whole."""
    jvm = spark._jvm
    fs, at = _folder(spark, path)
    fs.mkdirs(at.getParent())
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        out.hsync()
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, at, overwrite)


def read_pointer(spark: SparkSession, path: str) -> dict:
    """What write_pointer wrote; Unavailable says why it can't be told."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        raise Unavailable("missing", path)
    size = fs.getFileStatus(at).getLen()
    if size > MOST_BYTES:
        raise Unavailable("too_large", f"{size} bytes of {MOST_BYTES}")
    source = fs.open(at)
    try:
        raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
    finally:
        source.close()
    try:
        document = json.loads(raw)
    except ValueError as e:
        raise Unavailable("malformed", str(e)) from e
    if not isinstance(document, dict) or not isinstance(document.get("schema_version"), int):
        raise Unavailable("malformed", "no schema version")
    if document["schema_version"] != SCHEMA_VERSION:
        raise Unavailable("unsupported_schema", f"{document['schema_version']}, not {SCHEMA_VERSION}")
    return document


def _pointer(root: str) -> str:
    return f"{root.rstrip('/')}/CURRENT"


def publish(states: DataFrame, root: str, generation: int, keep: int = 2) -> str:
    """Write states as a generation and name it as current; the folder written.

    A generation below the published one is refused before anything is written
    and again before it is named. A writer that dies leaves a folder that nothing
    names. Of superseded folders the last `keep` stay for readers that still have
    them.
    """
    spark = states.sparkSession

    def held() -> dict | None:
        try:
            return read_pointer(spark, _pointer(root))
        except Unavailable as e:
            if e.reason == "missing":
                return None
            raise

    def check(before: dict | None) -> None:
        if before is not None and generation < before["generation"]:
            raise Refused(f"generation {generation} is older than the published {before['generation']}")

    check(held())
    folder = f"generation-{generation:020d}-{uuid.uuid4().hex}"
    states.write.parquet(f"{root.rstrip('/')}/{folder}")
    before = held()
    check(before)
    old = [] if before is None else [before["folder"], *before.get("before", [])]
    write_pointer(spark, _pointer(root), {"schema_version": SCHEMA_VERSION, "generation": generation, "folder": folder, "before": old[:keep]})
    fs, _ = _folder(spark, root)
    for name in old[keep:]:
        fs.delete(_folder(spark, f"{root.rstrip('/')}/{name}")[1], True)
    return folder


def read(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The current state and its generation. The reader is pinned: a later publication doesn't change what it reads."""
    current = read_pointer(spark, _pointer(root))
    folder = f"{root.rstrip('/')}/{current['folder']}"
    fs, at = _folder(spark, folder)
    if not fs.exists(at):
        raise Unavailable("malformed", f"{current['folder']} isn't there")
    return spark.read.parquet(folder), current["generation"]


COUNTERS = ("ingest", "ledger")


def counters(spark: SparkSession, root: str) -> dict[str, int]:
    """How often each counter was raised; both stand at 0 where there are none yet."""
    try:
        return {k: read_pointer(spark, f"{root.rstrip('/')}/COUNTERS")[k] for k in COUNTERS}
    except Unavailable as e:
        if e.reason == "missing":
            return dict.fromkeys(COUNTERS, 0)
        raise


def raise_counter(spark: SparkSession, root: str, name: str) -> int:
    """One more ingest batch or ledger write: the counter's new value. One writer at a time, as a ledger has."""
    now = counters(spark, root)
    now[name] += 1
    write_pointer(spark, f"{root.rstrip('/')}/COUNTERS", {"schema_version": SCHEMA_VERSION, **now})
    return now[name]
