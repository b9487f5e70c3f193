"""Recorded bodies of quota meters as windows, and the dated rate book."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import SECOND, hours_window, next_grid, parse_rfc3339
from ..functions.exact import PPM

WINDOW = ("body", "key", "scope_kind", "scope_name", "used_ppm", "resolution_ppm", "quantization", "reset_kind", "reset_at")
# Nominal lengths of the windows that are told by name, in seconds.
LENGTHS = {"five_hour": 5 * 3600, "seven_day": 7 * 86400, "5h": 5 * 3600, "weekly": 7 * 86400, "session": 5 * 3600}
TOLERANCE = 2 * SECOND


def _ppm(x: Column, scale: int) -> Column:
    return F.round(x * scale).cast("bigint")


def _window(rows: DataFrame, **c: Column) -> DataFrame:
    return rows.select("body", *[c.get(k, F.lit(None).cast("string")).alias(k) for k in WINDOW[1:]])


def anthropic_windows(bodies: DataFrame) -> DataFrame:
    """bodies(body, text): the list of limits where there is one, else the named windows. A null reset: not started."""
    kind = "struct<limits:array<struct<kind:string,percent:double,resets_at:string,scope:string>>,five_hour:struct<utilization:double,resets_at:string>,seven_day:struct<utilization:double,resets_at:string>,seven_day_sonnet:struct<utilization:double,resets_at:string>,seven_day_opus:struct<utilization:double,resets_at:string>>"
    rows = bodies.withColumn("j", F.from_json("text", kind))
    listed = rows.where("j.limits is not null").select("body", F.explode("j.limits").alias("w"))
    model = F.get_json_object("w.scope", "$.model")
    scoped = F.coalesce(model, F.when(~F.col("w.scope").startswith("{"), F.col("w.scope")))
    reset = parse_rfc3339(F.col("w.resets_at"))
    out = _window(listed.where("w.percent between 0 and 100"), key=F.col("w.kind"), scope_kind=F.when(scoped.isNull(), "account").otherwise("model"), scope_name=scoped, used_ppm=_ppm(F.col("w.percent"), 10_000), resolution_ppm=F.lit(100), quantization=F.lit("exact"), reset_kind=F.when(reset.isNull(), "not_started").otherwise("known"), reset_at=reset)
    names = ("five_hour", "seven_day", "seven_day_sonnet", "seven_day_opus")
    legacy = rows.where("j.limits is null").select("body", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"j.{n}.utilization").alias("percent"), F.col(f"j.{n}.resets_at").alias("resets_at")) for n in names])).alias("w"))
    name = F.nullif(F.regexp_extract("w.kind", "seven_day_(.*)", 1), F.lit(""))
    return out.union(_window(legacy.where("w.percent between 0 and 100"), key=F.when(name.isNull(), F.col("w.kind")).otherwise("seven_day"), scope_kind=F.when(name.isNull(), "account").otherwise("model"), scope_name=name, used_ppm=_ppm(F.col("w.percent"), 10_000), resolution_ppm=F.lit(100), quantization=F.lit("exact"), reset_kind=F.when(reset.isNull(), "not_started").otherwise("known"), reset_at=reset))


def codex_windows(bodies: DataFrame) -> DataFrame:
    """bodies(body, text, observed): primary and secondary windows in whole percent. An unused window whose reset is just its length away hasn't started."""
    part = "struct<used_percent:double,window_minutes:bigint,resets_at:bigint>"
    rows = bodies.withColumn("j", F.from_json("text", f"struct<payload:struct<rate_limits:struct<primary:{part},secondary:{part}>>>"))
    each = rows.select("body", "observed", F.explode(F.array("j.payload.rate_limits.primary", "j.payload.rate_limits.secondary")).alias("w")).where("w.used_percent between 0 and 100")
    reset = F.col("w.resets_at") * SECOND
    idle = (F.col("w.used_percent") == 0) & (F.abs(reset - F.col("observed") - F.col("w.window_minutes") * 60 * SECOND) <= TOLERANCE)
    idle = F.coalesce(idle, F.lit(True))
    return _window(each, key=F.concat(F.col("w.window_minutes").cast("string"), F.lit("m")), scope_kind=F.lit("account"), used_ppm=_ppm(F.col("w.used_percent"), 10_000), resolution_ppm=F.lit(10_000), quantization=F.lit("nearest"), reset_kind=F.when(idle, "not_started").otherwise("known"), reset_at=F.when(~idle, reset))


def agy_windows(bodies: DataFrame) -> DataFrame:
    """bodies(body, text): buckets of model groups, which report what remains."""
    rows = bodies.withColumn("j", F.from_json("text", "struct<groups:array<struct<buckets:array<struct<bucketId:string,window:string,resetTime:string,remainingFraction:double>>>>>"))
    each = rows.select("body", F.explode("j.groups").alias("g")).select("body", F.explode("g.buckets").alias("w"))
    reset = parse_rfc3339(F.col("w.resetTime"))
    return _window(each, key=F.col("w.window"), scope_kind=F.lit("group"), scope_name=F.col("w.bucketId"), used_ppm=PPM - _ppm(F.col("w.remainingFraction"), PPM), resolution_ppm=F.lit(1), quantization=F.lit("unknown"), reset_kind=F.when(reset.isNull(), "not_started").otherwise("known"), reset_at=reset)


def ollama_windows(bodies: DataFrame, anchor: int = 0) -> DataFrame:
    """bodies(body, text, observed): used parts of two windows that reset on a fixed grid."""
    rows = bodies.withColumn("j", F.from_json("text", "struct<limits:struct<session:struct<usage:double>,weekly:struct<usage:double>>>"))
    each = rows.select("body", "observed", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"j.limits.{k}.usage").alias("usage")) for k in ("session", "weekly")])).alias("w")).where("w.usage is not null")
    grid = F.when(F.col("w.k") == "session", next_grid(F.col("observed"), anchor, LENGTHS["session"] * SECOND)).otherwise(next_grid(F.col("observed"), anchor, LENGTHS["weekly"] * SECOND))
    return _window(each, key=F.col("w.k"), scope_kind=F.lit("account"), used_ppm=_ppm(F.col("w.usage"), PPM), resolution_ppm=F.lit(10_000), quantization=F.lit("unknown"), reset_kind=F.lit("scheduled"), reset_at=grid)


def opencode_windows(bodies: DataFrame) -> DataFrame:
    """bodies(body, text): meters of spending against limits in micro-cents."""
    rows = bodies.withColumn("j", F.from_json("text", "struct<access:struct<meters:map<string,struct<resetsAt:string,limitMicroCents:string,usedMicroCents:string>>>>"))
    each = rows.select("body", F.explode("j.access.meters").alias("k", "w"))
    limit, used = F.col("w.limitMicroCents").try_cast("decimal(20,0)"), F.col("w.usedMicroCents").try_cast("decimal(20,0)")
    reset = parse_rfc3339(F.col("w.resetsAt"))
    return _window(each.where(limit > 0), key=F.col("k"), scope_kind=F.lit("account"), used_ppm=F.least(F.round(used * PPM / limit).cast("bigint"), F.lit(PPM)), resolution_ppm=F.lit(1), quantization=F.lit("exact"), reset_kind=F.when(reset.isNull(), "not_started").otherwise("known"), reset_at=reset)


def rate_cards(cards: DataFrame) -> DataFrame:
    """cards(card, vendor, rate text, effective_start, schedule struct<days, hours_utc>, and others) plus rate in millionths, start, days (a bitmask from Monday on), from_min and to_min.

    A rate that isn't a decimal number of six places at most is null. A schedule
    without days holds on all of them, one without hours all day; without a
    schedule all three are null.
    """
    days = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
    shape = r"^([0-9]+)(?:\.([0-9]{0,6}))?$"
    whole, part = F.regexp_extract("rate", shape, 1), F.regexp_extract("rate", shape, 2)
    rate = F.when(F.regexp_like("rate", F.lit(shape)), whole.cast("bigint") * PPM + F.rpad(part, 6, "0").cast("bigint"))
    s = F.col("schedule")
    mask = sum((F.when(F.array_contains(s["days"], d), 1 << i).otherwise(0) for i, d in enumerate(days)), F.lit(0))
    hours = hours_window(s["hours_utc"])
    out = cards.withColumn("rate", rate).withColumn("start", F.col("effective_start").cast("date"))
    out = out.withColumn("days", F.when(s.isNotNull(), F.when(s["days"].isNull(), 127).otherwise(mask)).cast("int"))
    out = out.withColumn("from_min", F.when(s.isNotNull(), F.when(s["hours_utc"].isNull(), 0).otherwise(hours["start"])).cast("int"))
    return out.withColumn("to_min", F.when(s.isNotNull(), F.when(s["hours_utc"].isNull(), 1440).otherwise(hours["end"])).cast("int"))


def read_rate_book(spark: SparkSession, path: str) -> DataFrame:
    """(card, vendor, model, token_class, rate in millionths, currency, start, end, days, from_min, to_min) of a TOML rate book. A book is a page of prices, read by the driver."""
    names = ("vendor", "model", "token_class", "rate", "currency", "effective_start", "effective_end")
    out = []
    for i, c in enumerate(tomllib.loads(Path(path).read_text()).get("card", []), 1):
        s = c.get("schedule") or None
        out.append((i, *[None if c.get(k) is None else str(c[k]) for k in names], s and (s.get("days"), s.get("hours_utc"))))
    rows = spark.createDataFrame(out, "card int, vendor string, model string, token_class string, rate string, currency string, effective_start string, effective_end string, schedule struct<days:array<string>,hours_utc:string>")
    return rate_cards(rows).withColumn("end", F.col("effective_end").cast("date")).select("card", "vendor", "model", "token_class", "rate", "currency", "start", "end", "days", "from_min", "to_min")
