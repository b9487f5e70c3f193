"""Old archives brought into the ledger once: seed readings of several vendors, and fits of a former calibration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import parse_rfc3339

#: Failures that a seed record may name (fixed values).
FAILURES = ("spawn_failed", "non_zero_exit", "empty_output")
WINDOWS = "array<struct<window:string,used_ppm:bigint,reset_at:bigint>>"
_RECORD = (
    "received_at string, account string, failure string, "
    "reading struct<providers: array<struct<provider: string, windows: array<struct<id: string, percentUsed: double, resetsAt: string>>>>>"
)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def seed_records(lines: DataFrame) -> DataFrame:
    """(file, line, vendor, ts, windows, failure, reason) of lines(file, line, text): a row for each provider of a reading, one for a failure, one with its reason for a line that can't be used.

    A line with one bad window is refused as a whole. A failure's vendor is its
    account; a provider named anthropic is the vendor claude.
    """
    r = F.col("r")
    at = parse_rfc3339(r["received_at"])
    providers = r["reading"]["providers"]
    bad = lambda test: F.exists(providers, lambda p: F.exists(p["windows"], test))
    reason = (
        F.when(F.try_parse_json("text").isNull(), "invalid_json")
        .when(r["received_at"].isNull(), "missing_received_at")
        .when(at.isNull(), "invalid_received_at")
        .when(r["reading"].isNull() & r["failure"].isNull(), "unrecognized_shape")
        .when(r["reading"].isNull() & ~r["failure"].isin(*FAILURES), "unknown_failure_class")
        .when(r["reading"].isNull(), F.when(_blank(r["account"]), "invalid_account"))
        .when(providers.isNull(), "missing_providers")
        .when(F.size(providers) == 0, "no_provider_entries")
        .when(F.exists(providers, lambda p: _blank(p["provider"])), "missing_provider_name")
        .when(F.exists(providers, lambda p: p["windows"].isNull()), "missing_windows")
        .when(bad(lambda w: w["id"].isNull()), "missing_window_id")
        .when(bad(lambda w: ~F.coalesce(w["percentUsed"].between(0, 100), F.lit(False))), "invalid_percent_used")
        .when(bad(lambda w: w["resetsAt"].isNotNull() & parse_rfc3339(w["resetsAt"]).isNull()), "invalid_resets_at")
    )
    read = lines.select("file", "line", "text", F.from_json("text", _RECORD).alias("r")).select("file", "line", "r", at.alias("ts"), reason.alias("reason"))
    window = lambda w: F.struct(w["id"].alias("window"), F.round(w["percentUsed"] * 10_000).cast("bigint").alias("used_ppm"), parse_rfc3339(w["resetsAt"]).alias("reset_at"))
    each = F.transform(providers, lambda p: F.struct(F.lower(p["provider"]).alias("vendor"), F.array_sort(F.transform(p["windows"], window)).cast(WINDOWS).alias("windows")))
    one = F.array(F.struct(F.lower(r["account"]).alias("vendor"), F.lit(None).cast(WINDOWS).alias("windows")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("vendor"), F.lit(None).cast(WINDOWS).alias("windows")))
    out = read.withColumn("e", F.explode(F.when(F.col("reason").isNotNull(), none).when(r["reading"].isNull(), one).otherwise(each)))
    vendor = F.when(F.col("e.vendor") == "anthropic", "claude").otherwise(F.col("e.vendor"))
    return out.select("file", "line", vendor.alias("vendor"), "ts", F.col("e.windows").alias("windows"), F.when(r["reading"].isNull(), r["failure"]).alias("failure"), "reason")


def seed_import(records: DataFrame, accounts: DataFrame, native: DataFrame, stored: DataFrame, asserted_from: Mapping[str, int]) -> DataFrame:
    """records plus account, disposition and asserted.

    accounts(vendor, account); native(account, since): an account's first own
    attempt; stored(account, ts, windows): what earlier imports left. A record is
    quarantined, discarded_unmapped_vendor, superseded_by_native (from `since`
    on), imported (the first of its account and instant), reinterpreted (its
    windows differ from the reading held so far) or unchanged. Imported again, a
    source changes nothing. `asserted`: the account is somebody's word from a
    vendor's instant on. A key's records are those of one account and instant.
    """
    found = records.join(accounts.select("vendor", "account"), "vendor", "left").join(native.select("account", "since"), "account", "left")
    refused = F.when(F.col("reason").isNotNull(), "quarantined").when(F.col("account").isNull(), "discarded_unmapped_vendor").when(F.col("ts") >= F.col("since"), "superseded_by_native")
    found = found.withColumn("disposition", refused)
    usable = found.where("disposition is null").drop("disposition")
    held = stored.select("account", "ts", F.col("windows").alias("held"), F.lit(True).alias("known"))
    w = Window.partitionBy("account", "ts").orderBy("file", "line", "vendor")
    before = F.coalesce(F.last("windows", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("held"))
    # A null in a reading is a value: arrays that differ in nothing else are equal.
    differs = F.col("windows").isNotNull() & before.isNotNull() & ~F.col("windows").eqNullSafe(before)
    first = F.col("known").isNull() & (F.row_number().over(w) == 1)
    judged = usable.join(held, ["account", "ts"], "left").withColumn("disposition", F.when(first, "imported").when(differs, "reinterpreted").otherwise("unchanged")).drop("held", "known")
    out = judged.unionByName(found.where("disposition is not null"))
    asserted = F.lit(False)
    for vendor, since in asserted_from.items():
        asserted = asserted | F.coalesce((F.col("vendor") == vendor) & (F.col("ts") >= since), F.lit(False))
    return out.select(*records.columns, "account", "disposition", (asserted & F.col("disposition").isin("imported", "reinterpreted")).alias("asserted"))


_FIT = (
    "format string, calibration_id string, provider string, plan_tier string, window string, fitted_micros_per_point string, fit_timestamp string, "
    "provenance struct<origin: string>, experiment struct<experiment_id: string, method: string, evidence_ids: array<string>>"
)


def legacy_calibrations(documents: DataFrame, known: DataFrame, form: str) -> DataFrame:
    """(file, digest, disposition, calibration_id, provider, plan_tier, window, micros_per_point, fitted_at, experiment, method, evidence, history, activatable) of documents(file, text).

    A document is known by the digest of its bytes: one that known(digest) or an
    earlier file has is unchanged. It is empty, quarantined (no JSON of the form
    `form`, or a field missing, or a fit that isn't a positive integer), refused
    (a coefficient without the evidence of its experiment) or imported. What is
    imported is history on an incomplete cost model, never activatable; `history`
    marks the first document of each calibration.
    """
    v = F.col("v")
    micros, at = F.expr("try_cast(v.fitted_micros_per_point as bigint)"), parse_rfc3339(v["fit_timestamp"])
    evidence = F.filter(F.transform(v["experiment"]["evidence_ids"], lambda e: F.trim(e)), lambda e: e != "")
    missing = _blank(v["calibration_id"]) | _blank(v["provider"]) | _blank(v["plan_tier"]) | _blank(v["window"]) | _blank(v["provenance"]["origin"])
    unfit = F.coalesce(micros <= 0, F.lit(True)) | at.isNull() | ~v["format"].eqNullSafe(F.lit(form))
    text = F.coalesce("text", F.lit(""))
    state = (
        F.when(F.trim(text) == "", "empty")
        .when(F.try_parse_json(text).isNull() | missing | unfit, "quarantined")
        .when(_blank(v["experiment"]["experiment_id"]) | (F.coalesce(F.size(evidence), F.lit(0)) < 1), "refused")
        .otherwise("imported")
    )
    read = documents.select("file", F.sha2(text, 256).alias("digest"), F.from_json(text, _FIT).alias("v"), text.alias("text"))
    rows = read.withColumn("state", state).join(known.select("digest", F.lit(True).alias("seen")).distinct(), "digest", "left")
    again = F.col("seen").isNotNull() | (F.row_number().over(Window.partitionBy("digest").orderBy("file")) > 1)
    # A refused document leaves no trace, so it is refused again.
    rows = rows.withColumn("disposition", F.when(again & (F.col("state") != "refused"), "unchanged").otherwise(F.col("state")))
    kept = F.col("disposition") == "imported"
    first = F.row_number().over(Window.partitionBy(kept, F.when(kept, F.trim(v["calibration_id"])).otherwise(F.col("file").cast("string"))).orderBy("file")) == 1
    only = lambda c: F.when(kept, c)
    return rows.select(
        "file", "digest", "disposition", only(F.trim(v["calibration_id"])).alias("calibration_id"), only(F.trim(v["provider"])).alias("provider"), only(F.trim(v["plan_tier"])).alias("plan_tier"), only(F.trim(v["window"])).alias("window"),
        only(micros).alias("micros_per_point"), only(at).alias("fitted_at"), only(F.trim(v["experiment"]["experiment_id"])).alias("experiment"), only(F.coalesce(v["experiment"]["method"], F.lit("ordinary-least-squares"))).alias("method"), only(evidence).alias("evidence"),
        (kept & first).alias("history"), F.lit(False).alias("activatable"),
    )
