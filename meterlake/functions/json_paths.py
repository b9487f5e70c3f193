"""Which fields JSON records have, and of what type."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of JSON's types.
NAMES = {type(None): "null", bool: "bool", int: "integer", float: "float", str: "string", list: "array", dict: "object"}


def _name(value: Any) -> str:
    """A value's type. Numbers that fit in no 64-bit integer, signed or not, are floats."""
    name = NAMES[type(value)]
    return "float" if name == "integer" and not -(1 << 63) <= value < 1 << 64 else name


def _walk(value: Any, path: str) -> Iterator[tuple[str, str]]:
    """(path, type) of a value and all below it, without recursion: records may nest deeply."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if at:
            yield at, _name(v)
        if isinstance(v, list):
            todo += [(f"{at}[]", x) for x in reversed(v)]
        elif isinstance(v, dict):
            todo += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]


@F.pandas_udf(T.ArrayType(T.StructType().add("path", "string").add("type", "string")))
def _paths(texts: pd.Series) -> pd.Series:
    def of(text):
        try:
            return [{"path": p, "type": t} for p, t in dict(_walk(json.loads(text), "")).items()]
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(of)


def field_paths(records: DataFrame, column: str) -> DataFrame:
    """(path, type, records): in how many records a field has a type. An array's items share a path, whose last item decides; text that isn't JSON has no fields."""
    found = records.select(F.explode(_paths(column)).alias("f"))
    return found.groupBy("f.path", "f.type").agg(F.count("*").alias("records"))


def kind_of(record: Any) -> str | None:
    """A record's kind: its type; for an event message, and where it has no type, its payload's."""
    text = lambda x: x if isinstance(x, str) else None
    if not isinstance(record, dict):
        return None
    payload = record.get("payload")
    inner = text(payload.get("type")) if isinstance(payload, dict) else None
    own = text(record.get("type"))
    return inner if own is None else (inner or own) if own == "event_msg" else own


@F.pandas_udf(T.StructType().add("kind", "string").add("shape", "string").add("fields", T.ArrayType(T.StringType())))
def _shapes(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        try:
            record = json.loads(text)
            types = dict(_walk(record, ""))
            lines = sorted(f"{p}:{t}" for p, t in types.items())
            out.append((kind_of(record), hashlib.sha256("".join(f"{x}\n" for x in lines).encode("utf-8", "surrogatepass")).hexdigest(), sorted(types)))
        except (TypeError, ValueError, RecursionError):
            out.append((None, None, None))
    return pd.DataFrame(out, columns=["kind", "shape", "fields"])


def record_shapes(records: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, kind, shape, fields, records): the distinct shapes of JSON records and how many records have each.

    A shape is the SHA-256 of a record's sorted `path:type` lines; fields are
    its sorted paths, no value of a record is kept. Blank and null texts are no
    records. Text that isn't JSON has no shape (null).
    """
    texts = records.where(F.length(F.trim(column)) > 0)
    found = texts.select(*by, _shapes(column).alias("s")).select(*by, "s.*")
    return found.groupBy(*by, "kind", "shape").agg(F.first("fields").alias("fields"), F.count("*").alias("records"))
