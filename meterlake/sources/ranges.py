"""Transcripts read from where reading stopped: byte ranges of files, many tasks to a file, and a stream of appended bytes.

A range owns the lines that begin in it. A line without its newline is still
being written: it waits, and the offset that is remembered lies before it. Files
are opened through pyarrow's file systems, so that only a range's own bytes, and
what is left of its last line, are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..streaming.ingest import changes

WIDTH = 64 << 20
_READ, _LEAST = 1 << 20, 1 << 8
LINE = "file string, at bigint, until bigint, text string"


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def lines_between(source, start: int, end: int, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset behind the newline, line) of the lines that begin in [start, end) of a file of `size` bytes and have their newline by then.

    Reads from the byte before start, which tells whether a line begins there,
    to the end of the last line that begins before end: the range itself, then a
    little and twice as much at a time, so that short ranges cost their own bytes.
    """
    at = max(0, start - 1)
    source.seek(at)
    held, first = b"", start > 0
    while at < size:
        ask = end - at if at < end else max(_LEAST, at - end)
        block = source.read(min(_READ, ask, size - at))
        if not block:
            return
        begins, parts = at - len(held), (held + block).split(b"\n")
        at += len(block)
        for part in parts[:-1]:
            behind = begins + len(part) + 1
            if first:
                first = False  # the rest of the line before
            elif begins >= end:
                return
            else:
                yield begins, behind, part
            begins = behind
        held = parts[-1]
        if not first and begins >= end:
            return


def ranges(files: DataFrame, marks: DataFrame, parser_version: int, width: int = WIDTH) -> DataFrame:
    """(file, size, start, end, change) to be read: files(path, identity, size, mtime) against marks(path, identity, size, mtime, parser_version, offset).

    An appended file is read from its offset, one that is new, replaced, shorter,
    rewritten or due to a new parser from its first byte, an unchanged one not at
    all. What is to be read is cut into ranges of `width` bytes.
    """
    found = changes(marks, files, parser_version).where("change <> 'unchanged'")
    rows = found.join(marks.select("path", F.col("offset").alias("from")), "path", "left")
    rows = rows.withColumn("from", F.when(F.col("change") == "appended", F.col("from")).otherwise(F.lit(0).cast("bigint"))).where("`from` < size")
    cut = rows.withColumn("start", F.explode(F.sequence("from", F.col("size") - 1, F.lit(width).cast("bigint"))))
    return cut.select(F.col("path").alias("file"), "size", "start", F.least(F.col("start") + width, "size").alias("end"), "change")


def _found(batches):
    """The lines of a task's ranges, which come by file: one is open at a time."""
    name, source = None, None
    try:
        for batch in batches:
            for file, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "start", "end")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, _open(file)
                for at, until, line in lines_between(source, start, end, size):
                    yield file, at, until, line.decode("utf-8", "replace")
    finally:
        if source is not None:
            source.close()


def _read(batches):
    found = _found(batches)
    while part := list(islice(found, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*part, strict=True)], ["file", "at", "until", "text"])


def read_ranges(wanted: DataFrame) -> DataFrame:
    """(file, at, until, text): the complete lines of ranges(...), at and until being the bytes where a line begins and the next one does. Tasks share the ranges; a range's row is small, so that their number is given, or Spark would deal them to one."""
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.select("file", "size", "start", "end").repartition(tasks, "file", "start").sortWithinPartitions("file", "start").mapInArrow(_read, LINE)


def advanced(files: DataFrame, marks: DataFrame, wanted: DataFrame, lines: DataFrame, parser_version: int) -> DataFrame:
    """marks after reading: an offset behind the last complete line of each file read, the old one where nothing was."""
    behind = lines.groupBy(F.col("file").alias("path")).agg(F.max("until").alias("behind"))
    begun = wanted.groupBy(F.col("file").alias("path")).agg(F.min("start").alias("begun"))
    old = marks.select("path", F.col("offset").alias("old"), F.col("parser_version").alias("by"))
    rows = files.join(begun, "path", "left").join(behind, "path", "left").join(old, "path", "left")
    return rows.select("path", "identity", "size", "mtime", F.lit(parser_version).alias("parser_version"), F.coalesce("behind", "begun", "old", F.lit(0)).cast("bigint").alias("offset"))


class AppendedLines(DataSource):
    """A stream of the lines that are appended to the files of a folder.

    Options: path (a URI), pattern (of names), width. The offset is a JSON map of
    each file's identity and how far it was read; a file that shrank is read
    again from its first byte. Register with spark.dataSource.register.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, size: int) -> None:
        self.file, self.start, self.end, self.size = file, start, end, size


class AppendedReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pattern, self.width = options["path"], options.get("pattern", "*"), int(options.get("width", WIDTH))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """Each file's size, cut back to its last newline."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.pattern):
                found[info.path] = self._complete(system, info.path, info.size)
        return {"files": json.dumps(found, sort_keys=True)}

    @staticmethod
    def _complete(system, path: str, size: int) -> int:
        with system.open_input_file(path) as source:
            end = size
            while end:
                begin = max(0, end - _READ)
                source.seek(begin)
                at = source.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, size in sorted(new.items()):
            begin = old.get(file, 0)
            begin = begin if begin <= size else 0
            out += [_Range(file, a, min(a + self.width, size), size) for a in range(begin, size, self.width)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.file) as source:
            for at, until, text in lines_between(source, partition.start, partition.end, partition.size):
                yield partition.file, at, until, text.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the checkpoint."""
