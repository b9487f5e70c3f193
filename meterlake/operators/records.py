"""Imported records, published projections, batches of files, lineages and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import parse_rfc3339
from ..sources import published
from ..sources.staging import scratch, staged, whole
from ..sources.transcripts import once, parsed_json


def legacy_import(lines: DataFrame, native: DataFrame) -> DataFrame:
    """(relation, account, ts, outcome, used_ppm, provenance, line) of old records, lines(file, line, text).

    A record with a reading makes a successful attempt and, where the reading is
    a percentage, an observation; one with an error a failed attempt; any other
    an attempt of unknown outcome. Records from an account's first native
    attempt on, native(account, since), are left out, as are those without an
    account or a readable time.
    """
    v = F.col("v")
    read = once(parsed_json(lines, "text").select("line", "v"), account=F.try_variant_get(v, "$.account", "bigint"), ts=parse_rfc3339(F.try_variant_get(v, "$.at", "string")), used=F.try_variant_get(v, "$.used_percent", "double"), error=F.try_variant_get(v, "$.error", "string"))
    old = read.drop("v").where("account is not null and ts is not null").join(native, "account", "left").where("since is null or ts < since")
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("used").isNotNull(), "success").otherwise("unknown")
    row = lambda relation, outcome, used: F.struct(F.lit(relation).alias("relation"), outcome.cast("string").alias("outcome"), used.cast("bigint").alias("used_ppm"))
    seen = F.when(F.col("error").isNull() & F.col("used").between(0, 100), row("observation", F.lit(None), F.round(F.col("used") * 10_000)))
    # A record's rows at once: it is read and joined once.
    rows = old.withColumn("r", F.explode(F.array_compact(F.array(row("attempt", outcome, F.lit(None)), seen))))
    return rows.select("r.relation", "account", "ts", "r.outcome", "r.used_ppm", F.lit("legacy_import").alias("provenance"), "line")


def publish(states: DataFrame, path: str, by: Sequence[str], order: Sequence[str]) -> int | None:
    """Publish the newest state of each key, with its generation, as a whole; the generation.

    states has a column generation, and its greatest is what is published: one
    below the published one is refused. Without states there is nothing to
    publish.
    """
    latest = states.groupBy(*by).agg(F.max_by(F.struct(*[c for c in states.columns if c not in by]), F.struct(*order)).alias("s")).select(*by, "s.*")
    with scratch(states.sparkSession):
        once = staged(latest, "projection")
        generation = once.agg(F.max("generation")).first()[0]
        if generation is not None:
            published.publish(once, path, generation)
    return generation


def read_projection(spark: SparkSession, path: str, keys: DataFrame, key: str, behind: int) -> DataFrame:
    """keys plus what is published for them, state and reason: unavailable (missing), stale (old_generation: more than `behind` before the newest) or available.

    Where the projection itself can't be read, all keys are unavailable, and its
    reason is theirs.
    """
    try:
        held, newest = published.read(spark, path)
    except published.Unavailable as e:
        return keys.withColumn("state", F.lit("unavailable")).withColumn("reason", F.lit(e.reason))
    old = F.col("generation") < newest - behind
    missing = F.col("generation").isNull()
    out = keys.join(held, key, "left")
    return out.withColumn("state", F.when(missing, "unavailable").when(old, "stale").otherwise("available")).withColumn("reason", F.when(missing, "missing").when(old, "old_generation"))


def batch_bounds(files: DataFrame, file: str, most_events: int, most_files: int) -> DataFrame:
    """files(file, events) plus least_batch: the number of the first batch that may hold a file, in their order, if no batch has more than so many events and files.

    Files are as many as an ingest lists; they are ranked together.
    """
    w = Window.orderBy(file)
    before = F.sum("events").over(w) - F.col("events")
    place = F.row_number().over(w) - 1
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return files.withColumn("least_batch", F.greatest(div(before, most_events), div(place, most_files)).cast("bigint"))


@whole
def ancestors(rows: DataFrame) -> DataFrame:
    """(session, ancestor, depth) for all sessions above each one, rows(session, parent): a union with itself by doubling, until a round adds nothing.

    Going round a cycle adds nothing new, so each ancestor counts once, at its least depth.
    """
    known = rows.where("parent is not null").select("session", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth")).distinct()
    known, n, reach = staged(known, "lineage"), -1, 1
    while (now := known.count()) != n:
        n = now
        # A least way of up to twice the reach leads over an ancestor that is just so far; only what lies above those is needed, few rows near the roots, where all sessions meet.
        edge = known.where(F.col("depth") == reach)
        above = known.join(edge.select(F.col("ancestor").alias("session")).distinct(), "session", "left_semi")
        up = above.select(F.col("session").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        longer = edge.join(up, "ancestor").select("session", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = staged(known.union(longer).groupBy("session", "ancestor").agg(F.min("depth").alias("depth")), "lineage")
        reach *= 2
    return known


def namespaced(label: Column) -> tuple[Column, Column]:
    """The namespace before a label's first colon, and the name behind it."""
    return F.substring_index(label, ":", 1).alias("space"), F.regexp_extract(label, r"(?s)^[^:]*:(.*)$", 1).alias("name")
