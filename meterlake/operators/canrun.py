"""Whether an account can run a task: completed tasks as samples, their history by routing group, windows that constrain, and what is missing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .advice import headroom, history_distribution, verdict
from .attribution import NO_EVIDENCE

CELL = ("breadth", "verify", "spec", "critical")
#: Why a completed task is no sample, the first that holds (fixed order).
INELIGIBLE = {
    "unknown_token_components": lambda: F.col("credits").isNull(),
    "unknown_account_attribution": lambda: F.col("evidence") == NO_EVIDENCE,
    "incomplete_segmentation": lambda: ~F.col("complete"),
    "estimated_tokens": lambda: ~F.col("measured"),
}


def constrains(scope: Column, named: Column, model: Column) -> Column:
    """Whether a window constrains a model: an account's always, a model's that model, a group's none that is known from here."""
    return F.when(scope == "account", True).when(scope == "model", F.coalesce(named == model, F.lit(False))).otherwise(False)


def routing_cells(identities: DataFrame) -> DataFrame:
    """identities(task, size, verify, spec, critical) -> (task, breadth, verify, spec, critical). Without both of verify and spec they are gate and open; without a size a task is large."""
    both = F.col("verify").isNotNull() & F.col("spec").isNotNull()
    return identities.select(
        "task",
        F.when(F.col("size").isin("S", "M"), "small_medium").otherwise("large").alias("breadth"),
        F.when(both, F.col("verify")).otherwise("gate").alias("verify"),
        F.when(both, F.col("spec")).otherwise("open").alias("spec"),
        F.coalesce("critical", F.lit(False)).alias("critical"),
    )


def task_samples(usage: DataFrame, claims: DataFrame, identities: DataFrame, rates: Mapping[str, int], start: int, end: int) -> DataFrame:
    """(task, breadth, verify, spec, critical, credits, measured, evidence, complete) for each task with a release in [start, end) and any usage.

    usage(bucket, session, rank, estimated, ambiguous, one column for each of
    rates): credits are null if any component is, evidence is the worst that any
    event has, and a task is incomplete if any of its sessions has an ambiguous
    event, be it of another task.
    """
    done = claims.where((F.col("kind") == "release") & (F.col("ts") >= start) & (F.col("ts") < end)).select("task").distinct()
    unsure = usage.where("ambiguous and session is not null").select("session").distinct().withColumn("unsure", F.lit(True))
    cost = sum((F.col(k) * r for k, r in rates.items()), F.lit(0).cast("bigint"))
    events = usage.join(unsure, "session", "left").withColumnRenamed("bucket", "task")
    per = events.groupBy("task").agg(
        F.when(F.count_if(cost.isNull()) == 0, F.sum(cost)).cast("bigint").alias("credits"),
        (F.count_if("estimated") == 0).alias("measured"),
        F.max(F.coalesce("rank", F.lit(NO_EVIDENCE))).alias("evidence"),
        (F.count_if("unsure") == 0).alias("complete"),
    )
    cell = routing_cells(identities)
    usual = {"breadth": F.lit("large"), "verify": F.lit("gate"), "spec": F.lit("open"), "critical": F.lit(False)}
    joined = per.join(done, "task", "left_semi").join(cell, "task", "left")
    return joined.select("task", *[F.coalesce(c, d).alias(c) for c, d in usual.items()], "credits", "measured", "evidence", "complete")


def _groups() -> list[Column]:
    """A cell's groups from the narrowest on."""
    critical = F.concat(F.lit("critical="), F.col("critical").cast("string"))
    cell = F.when(F.col("critical"), critical).otherwise(F.concat(F.concat_ws("/", "breadth", "verify", "spec"), F.lit(" "), critical))
    return [cell, F.concat("breadth", F.lit(" "), critical), F.lit("all tasks")]


def group_history(samples: DataFrame, least: int = 12) -> DataFrame:
    """(level, grp, history_distribution's columns) of each routing group on each level: 0 cell, 1 breadth and critical, 2 all tasks."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), g.alias("grp")) for i, g in enumerate(_groups())])).alias("g")
    return history_distribution(samples.select("*", levels).select("*", "g.level", "g.grp"), ["level", "grp"], "credits", {r: c() for r, c in INELIGIBLE.items()}, least)


def select_history(cells: DataFrame, history: DataFrame) -> DataFrame:
    """cells (with the columns of CELL) plus the history of their first level with enough samples, else that of all tasks; nulls if there is none at all."""
    keyed = cells.withColumn("__g", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), g.alias("grp")) for i, g in enumerate(_groups())])))
    at = [F.col("__g.level") == F.col("h.level"), F.col("__g.grp") == F.col("h.grp")]
    fits = (F.col("h.state") == "sufficient") | (F.col("__g.level") == 2)
    best = keyed.join(history.alias("h"), at, "left").where(fits).groupBy(*cells.columns).agg(F.min_by(F.struct("h.*"), F.col("__g.level")).alias("h"))
    return best.select(*cells.columns, "h.*")


def window_basis(windows: DataFrame) -> DataFrame:
    """windows plus basis, reasons, and the credits of a full window, lo and hi, where there is a basis.

    windows(health, lo, hi, kinds_health, gaps array, estimate_lo, estimate_hi):
    a calibration in credits, if there is one, decides by its health, and none
    but a current one is a basis. Otherwise one for each kind of token refuses:
    it converts tokens, not credits, so it bounds no headroom. Only a window
    without either may stand on an estimate, if that has no gaps; each gap is a
    reason. An older measurement is evidence still, so no estimate stands in for
    one that isn't current.
    """
    none, kinds = F.col("health").isNull(), F.col("kinds_health")
    estimated = F.col("estimate_lo").isNotNull() & F.col("estimate_hi").isNotNull()
    gaps = F.coalesce("gaps", F.array().cast("array<string>"))
    basis = F.when(~none & (F.col("health") == "current"), "calibration").when(none & kinds.isNull() & estimated & (F.size(gaps) == 0), "estimate")
    refused = (
        F.when(~none, F.array(F.concat(F.lit("calibration_"), "health")))
        .when(kinds == "current", F.array(F.lit("calibration_per_kind")))
        .when(kinds.isNotNull(), F.array(F.concat(F.lit("calibration_"), kinds)))
        .when(F.size(gaps) > 0, F.array_sort(gaps))
        .otherwise(F.array(F.lit("no_calibration")))
    )
    value = lambda c, e: F.when(F.col("__basis") == "calibration", F.col(c)).when(F.col("__basis") == "estimate", F.col(e))
    kept = [c for c in windows.columns if c not in ("lo", "hi")]
    out = windows.withColumn("__basis", basis)
    return out.select(*kept, F.col("__basis").alias("basis"), F.when(F.col("__basis").isNull(), refused).otherwise(F.array().cast("array<string>")).alias("reasons"), value("lo", "estimate_lo").alias("lo"), value("hi", "estimate_hi").alias("hi"))


def can_run(requests: DataFrame, windows: DataFrame, least_coverage: int, multiple: int = 2) -> DataFrame:
    """(request, verdict, missing, limiting) for each request.

    requests(request, account, model, meter, unpriced array, account_tier,
    calibration_tier, and a history's included, coverage_ppm, p50, upper, state);
    windows(account, window, scope, named, remaining_ppm, health, lo, hi,
    estimate_lo, estimate_hi, and kinds_health and gaps if there are any): credits
    of a full window by window_basis. Every missing prerequisite
    is named, windows by their own names. If history alone is missing, evidence
    is insufficient; if anything else, the answer is unknown. Otherwise the
    window with the least margin over the upper reference decides.
    """
    ready = F.col("meter") == "fresh"
    for c, kind in (("kinds_health", "string"), ("gaps", "array<string>")):
        if c not in windows.columns:
            windows = windows.withColumn(c, F.lit(None).cast(kind))
    windows, lo, hi = window_basis(windows), F.col("lo"), F.col("hi")
    known = F.col("remaining_ppm").isNotNull() & lo.isNotNull() & hi.isNotNull()
    r, w = requests.alias("r"), windows.alias("w")
    pairs = r.where(ready).select("request", "account", "model", "p50", "upper").join(w, "account").where(constrains(F.col("scope"), F.col("named"), F.col("model"))).withColumns({"known": known, "room": headroom(F.col("remaining_ppm"), lo, hi)})
    margin = F.struct((F.col("room.lo") - F.col("upper")).alias("lo"), (F.col("room.hi") - F.col("upper")).alias("hi"), "window")
    per = pairs.groupBy("request").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.when(~F.col("known"), F.col("window")))).alias("refused"),
        F.min_by(F.struct("window", "room"), margin).alias("limit"),
    )
    all_ = r.join(per, "request", "left")
    fact = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    facts = F.concat(
        fact(~ready, "meter"),
        F.when(F.coalesce(ready, F.lit(False)), fact(F.coalesce("n", F.lit(0)) == 0, "constraining_windows")).otherwise(F.array().cast("array<string>")),
        F.coalesce("refused", F.array().cast("array<string>")),
        fact(F.size("unpriced") > 0, "cost_model"),
        fact(F.col("account_tier") != F.col("calibration_tier"), "plan_tier"),
        fact(F.col("state") != "sufficient", "historical_task_evidence"),
        F.when(F.col("coverage_ppm") < least_coverage, F.array(F.lit("attribution_quality"))).otherwise(F.array().cast("array<string>")),
    )
    said = verdict(F.col("limit.room.lo"), F.col("limit.room.hi"), F.col("p50"), F.col("upper"), multiple)
    out = all_.withColumn("missing", facts)
    label = F.when(F.size("missing") == 0, said).when((F.size("missing") == 1) & (F.col("missing")[0] == "historical_task_evidence"), "INSUFFICIENT_EVIDENCE").otherwise("UNKNOWN")
    return out.select("request", label.alias("verdict"), "missing", F.when(F.size("missing") == 0, F.col("limit.window")).alias("limiting"))
