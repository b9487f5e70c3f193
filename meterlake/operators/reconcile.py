"""Reconciliation: what meters saw against what usage explains; retention and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import share_ppm, trunc_div
from .calibration import all_reasons
from .timeline import sums_within


def residuals(intervals: DataFrame) -> DataFrame:
    """intervals(observed, explained_lo, explained_hi) plus residual_lo and residual_hi: observed less explained."""
    return intervals.withColumn("residual_lo", F.col("observed") - F.col("explained_hi")).withColumn("residual_hi", F.col("observed") - F.col("explained_lo"))


#: Why an interval isn't reconciled, in the order in which the reasons are given.
CONDITIONS = ("same_account_and_window", "no_reset_inside", "acceptable_meter_coverage", "applicable_current_calibration", "sufficient_settlement_and_lag_handling", "exact_local_usage_where_required")


def eligibility(intervals: DataFrame, by: Sequence[str], usage: DataFrame, resets: DataFrame, gaps: DataFrame, health: DataFrame) -> DataFrame:
    """intervals plus failing (array, all that fail) and eligible: the six conditions of reconciliation, each judged by itself.

    by is (account, window). intervals has start and end, structs of ts,
    used_ppm, account, window and resets_at, and acceptable, settled and
    lag_handled. usage(by, ts, inexact) and resets(by, ts) count after the start
    and up to the end; gaps(by, a, b), destructive ones, if they overlap the
    inside; health(by, health) is that of the calibration in force, a row for
    each key. An unknown fact fails its condition; an interval without usage
    needs none that is exact.
    """
    count = F.lit(1).cast("bigint")
    # An instant counts over the nanosecond before it: at an interval's end it is inside, at its start it isn't.
    instant = lambda rows, n, value: rows.select(*by, (F.col("ts") - 1).alias("a"), F.col("ts").alias("b"), value.alias(n))
    facts = instant(resets, "resets", count).unionByName(instant(usage, "inexact", F.coalesce("inexact", F.lit(True)).cast("bigint")), allowMissingColumns=True).unionByName(gaps.select(*by, "a", "b", count.alias("gaps")), allowMissingColumns=True)
    found = sums_within(intervals, facts, by, ["resets", "inexact", "gaps"], F.col("start.ts"), F.col("end.ts"), closed=False).join(health.select(*by, "health"), list(by), "left")
    ends_are = lambda n: (F.col(f"start.{n}") == F.col(n)) & (F.col(f"end.{n}") == F.col(n))
    account, window = by
    held = (
        ends_are(account) & ends_are(window),
        (F.col("resets") == 0) & (F.col("start.resets_at") > F.col("end.ts")) & (F.col("start.resets_at") == F.col("end.resets_at")) & (F.col("end.used_ppm") >= F.col("start.used_ppm")),
        F.col("acceptable") & (F.col("gaps") == 0),
        F.col("health") == "current",
        F.col("settled") & F.col("lag_handled"),
        F.col("inexact") == 0,
    )
    out = found.withColumn("failing", all_reasons(*zip(held, CONDITIONS, strict=True)))
    return out.withColumn("eligible", F.size("failing") == 0).drop("resets", "inexact", "gaps", "health")


def rolling_residual(intervals: DataFrame, by: Sequence[str], least: int, floor_ppm: int) -> DataFrame:
    """(by, n, observed, explained, residual, residual_ppm, verdict): suppressed below `least` eligible intervals, else unexplained from the floor up."""
    out = intervals.groupBy(*by).agg(F.count("*").alias("n"), F.sum("observed").cast("bigint").alias("observed"), F.sum("explained").cast("bigint").alias("explained"))
    out = out.withColumn("residual", F.col("observed") - F.col("explained")).withColumn("residual_ppm", share_ppm(F.abs("residual"), F.col("observed")))
    return out.withColumn("verdict", F.when(F.col("n") < least, "suppressed").when(F.col("residual_ppm").isNull(), "no_movement").when(F.col("residual_ppm") >= floor_ppm, "unexplained").otherwise("explained"))


def residual_patterns(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, n, patterns array) of each key's residuals (whole numbers) in order; shorter runs than three have no pattern.

    persistently_positive and persistently_negative: all of one sign. From four
    on, alternating_net_zero: each sign differs from the one before, none is
    zero, and five times the net sum is no more than the sum of sizes; else
    step_change: the means of both halves, cut to whole numbers, differ by so
    much that n times it reaches the sum of sizes.
    """
    w = Window.partitionBy(*by).orderBy(order)
    sign, big = F.signum("residual"), F.col("residual").cast("decimal(38,0)")
    s = rows.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    s = s.withColumn("turns", (sign != 0) & F.coalesce(sign != F.signum(F.lag("residual").over(w)), F.lit(True)))
    half = trunc_div(F.col("n"), 2)
    facts = s.groupBy(*by).agg(
        F.count("*").alias("n"), F.bool_and(F.col("residual") > 0).alias("up"), F.bool_and(F.col("residual") < 0).alias("down"), F.bool_and("turns").alias("turns"),
        F.coalesce(F.sum(F.when(F.col("i") <= half, big)), F.lit(0)).alias("a"), F.sum(F.when(F.col("i") > half, big)).alias("b"), F.sum(big).alias("net"), F.sum(F.abs(big)).alias("size"),
    )
    whole = lambda total, count: F.call_function("div", total, F.greatest(count, F.lit(1)).cast("decimal(38,0)"))
    step = F.abs(whole(F.col("b"), F.col("n") - trunc_div(F.col("n"), 2)) - whole(F.col("a"), trunc_div(F.col("n"), 2)))
    many = (F.col("n") >= 4) & (F.col("size") > 0)
    found = [
        F.when((F.col("n") >= 3) & F.col("up"), "persistently_positive"),
        F.when((F.col("n") >= 3) & F.col("down"), "persistently_negative"),
        F.when(many & F.col("turns") & (F.abs("net") * 5 <= F.col("size")), "alternating_net_zero"),
        F.when(many & ~F.col("turns") & (step > 0) & (step * F.col("n") >= F.col("size")), "step_change"),
    ]
    return facts.select(*by, "n", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("patterns"))


def retention(backups: DataFrame, keep: dict[str, int], newest_verified: bool = True) -> DataFrame:
    """Backups (backup, ts timestamp, verified) that stay: the newest of each of the last N days, weeks, months and years, and the newest verified one."""
    kept = None
    for unit, n in keep.items():
        bucket = F.date_trunc(unit, "ts")
        rows = backups.withColumn("bucket", bucket).withColumn("nth", F.row_number().over(Window.partitionBy(bucket).orderBy(F.col("ts").desc(), F.col("backup").desc())))
        rows = rows.where("nth = 1").withColumn("place", F.dense_rank().over(Window.orderBy(F.col("bucket").desc()))).where(F.col("place") <= n).select("backup", F.lit(unit).alias("why"))
        kept = rows if kept is None else kept.union(rows)
    if newest_verified:
        best = backups.where("verified").agg(F.max_by("backup", F.struct("ts", "backup")).alias("backup")).where("backup is not null")
        kept = kept.union(best.select("backup", F.lit("verified")))
    return kept.groupBy("backup").agg(F.array_sort(F.collect_set("why")).alias("why"))


def export_sessions(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """A row for each session and kind with tokens, events, bounds, and how many of its rows have an ambiguous native id (owned by more than one session)."""
    owners = rows.select("native_id", "session").distinct().groupBy("native_id").agg(F.count("*").alias("owners"))
    long = rows.join(owners, "native_id").select("session", "native_id", "ts", (F.col("owners") != 1).alias("ambiguous"), F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.col(k) for k in kinds]))).alias("kind", "tokens"))
    return long.groupBy("session", "kind").agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if("ambiguous").alias("unresolved_events"), F.max(F.col("ambiguous").cast("int")).alias("unresolved_rows"))


def json_lines(rows: DataFrame, kind: str) -> DataFrame:
    """One JSON text for each row, with its kind; nulls are written."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def provenance(rows: DataFrame, by: Sequence[str], evidence: str, source: str, digits: int = 4) -> DataFrame:
    """(by, members, sources, digest): how much evidence each figure has, from how many sources, and a digest that doesn't depend on its order.

    Ids fall into shards by the first digits of their SHA-256. A shard's digest
    is over its sorted ids, the figure's over the digests of its shards in
    order, so that no row holds all ids of a figure. Null ids are no evidence;
    without any the digest is that of nothing.
    """
    ids = rows.where(F.col(evidence).isNotNull()).select(*by, F.col(evidence).alias("__id")).distinct()
    shards = ids.groupBy(*by, F.left(F.sha2("__id", 256), F.lit(digits)).alias("shard")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("__id")), "\0"), 256).alias("digest"))
    whole = shards.groupBy(*by).agg(F.sum("n").alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "digest"))), lambda s: s["digest"]), "\0").alias("digests"))
    c, w = rows.groupBy(*by).agg(F.count_distinct(source).alias("sources")).alias("c"), whole.alias("w")
    out = c.join(w, [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in by], "left")
    return out.select(*[f"c.{k}" for k in by], F.coalesce("w.members", F.lit(0)).cast("bigint").alias("members"), "c.sources", F.sha2(F.coalesce("w.digests", F.lit("")), 256).alias("digest"))


def transcript_markdown(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, markdown): conversations as Markdown in the order of their turns."""
    line = F.concat(F.lit("**"), F.coalesce("role", F.lit("unknown")), F.lit("**: "), F.coalesce("text", F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), body.alias("markdown"))
