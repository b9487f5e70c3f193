"""What leaves the ledger: usage by session or run as JSON lines behind a header, and versioned documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT_VERSION, ENVELOPE_VERSION = 1, 5
#: The identifiers that rows carry if they are asked for (fixed values).
LOGICAL_IDS = ("project", "repository")
WRITTEN = {"ignoreNullFields": "false"}


def quantity(value: Column, unit: str) -> Column:
    return F.struct(value.alias("value"), F.lit(unit).alias("unit"))


def _by_session(usage: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(native, kind, tokens): a kind that no event of a session states is no row."""
    long = usage.where("session is not null").select(F.col("session").alias("native"), F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.col(k).cast("bigint") for k in kinds]))).alias("kind", "tokens"))
    return long.where("tokens is not null").groupBy("native", "kind").agg(F.sum("tokens").alias("tokens"))


def usage_export(sessions: DataFrame, usage: DataFrame, kinds: Sequence[str], key: str = "session", logical_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, unresolved): usage by session or by run, and how much of it no session could be told for.

    sessions(source, native, run, project, repository, start, end);
    usage(session, one column for each of kinds), where session is a native id.
    Usage goes to the one session that has the id; that of an id which several
    sources have, or none, goes to nobody: unresolved(unresolved_events) counts
    each of its kinds. rows(key, sessions, first_start, last_end, usage, project,
    repository): usage is a sorted array of kinds, empty where there is none,
    identifiers are empty unless asked for. A session's key is source:native; a
    run sums its sessions, those without a run are in no row of it.
    """
    if key not in ("session", "run"):
        raise ValueError(key)
    owners = sessions.groupBy("native").agg(F.count("*").alias("owners"))
    per = _by_session(usage, kinds).join(owners, "native", "left")
    unresolved = per.agg(F.count_if(F.coalesce("owners", F.lit(0)) != 1).alias("unresolved_events"))
    keyed = sessions.where("run is not null").withColumn("key", F.col("run")) if key == "run" else sessions.withColumn("key", F.concat_ws(":", "source", "native"))
    by = ["key"] if key == "run" else ["key", "source", "native"]
    sets = [(F.array_sort(F.collect_set(c)) if logical_ids else F.array().cast("array<string>")).alias(c) for c in LOGICAL_IDS]
    heads = keyed.groupBy(*by).agg(F.count("*").alias("sessions"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), *sets)
    used = keyed.select(*by, *([] if "native" in by else ["native"])).join(per.where("owners = 1"), "native").groupBy("key", "kind").agg(F.sum("tokens").alias("tokens"))
    usages = used.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "tokens"))).alias("usage"))
    out = heads.join(usages, "key", "left").withColumn("usage", F.coalesce("usage", F.array().cast("array<struct<kind:string,tokens:bigint>>")))
    return out.select("key", "sessions", "first_start", "last_end", "usage", *LOGICAL_IDS), unresolved


def export_lines(rows: DataFrame, unresolved: DataFrame, key: str, ledger_generation: int, ingest_generation: int, generated_at: int, logical_ids: bool = False) -> DataFrame:
    """(place, key, line): a header at place 0, a JSON object for each row at place 1. Sorted by place and key, the lines are the export; all but generated_at follows from the ledger."""
    head = unresolved.select(
        F.lit(0).alias("place"), F.lit("").alias("key"),
        F.to_json(F.struct(
            F.lit(EXPORT_VERSION).alias("schema"), F.lit(f"{key}-id").alias("key"), F.lit(ledger_generation).alias("ledger_generation"), F.lit(ingest_generation).alias("ingestion_generation"),
            F.array(*[F.lit(c) for c in LOGICAL_IDS if logical_ids]).cast("array<string>").alias("included_identifiers"), quantity(F.col("unresolved_events"), "events").alias("unresolved_events"), F.lit(generated_at).alias("generated_at"),
        ), WRITTEN).alias("line"),
    )
    usage = F.map_from_entries(F.transform("usage", lambda u: F.struct(u["kind"], quantity(u["tokens"], "tokens"))))
    body = F.struct("key", quantity(F.col("sessions"), "sessions").alias("sessions"), "first_start", "last_end", usage.alias("usage"), *LOGICAL_IDS)
    return head.union(rows.select(F.lit(1), "key", F.to_json(body, WRITTEN)))


def write_lines(lines: DataFrame, path: str) -> None:
    """The export as text files whose names and lines are in order."""
    lines.repartitionByRange("place", "key").sortWithinPartitions("place", "key").select("line").write.text(path)


def envelope(report: str, run: str, generated_at: int, generation: Column, body: Sequence[Column]) -> Column:
    """A versioned JSON document of one row: what made it, from which generation of the ledger, and its body. Nulls are written, so that what is unknown shows."""
    return F.to_json(F.struct(F.lit(ENVELOPE_VERSION).alias("schema"), F.lit(report).alias("report"), F.lit(run).alias("run"), F.lit(generated_at).alias("generated_at"), generation.alias("ledger_generation"), *body), WRITTEN)
