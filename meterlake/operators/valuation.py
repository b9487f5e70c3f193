"""Prices and credits: effective-dated ranked rate lookup, rounding per event, conversion to quota points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import schedule_contains, utc_date
from ..functions.exact import big, ceil_div, clamp, floor_div, interval, round_div, trunc_div


def rate_micros(text: Column) -> Column:
    """A decimal text of up to six places as micros; null if malformed."""
    return (F.try_to_number(text, F.lit("999999999.999999")) * 1_000_000).cast("bigint")


#: Shares of the cards of one model and class, which are compared with all of them apart.
SHARES = 16


def overlapping_cards(cards: DataFrame) -> DataFrame:
    """Pairs of cards of one model and class whose date ranges overlap, where both or neither are scheduled and schedules overlap too."""
    # Few models and classes hold all cards and a card's row is small: each card meets the others of its key in one of several shares, and their number of tasks is given.
    tasks = 4 * int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["model", "token_class", "timed", "share"]
    known = cards.withColumn("timed", F.col("days").isNotNull())
    one = known.withColumn("share", F.pmod(F.hash("card"), F.lit(SHARES)).cast("int"))
    all_shares = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    a, b = one.repartition(tasks, *key).alias("a"), all_shares.repartition(tasks, *key).alias("b")
    dates = (F.col("a.start") <= F.coalesce("b.end", F.lit("9999-12-31").cast("date"))) & (F.col("b.start") <= F.coalesce("a.end", F.lit("9999-12-31").cast("date")))
    sched = (F.col("a.days").bitwiseAND(F.col("b.days")) != 0) & (F.col("a.from_min") < F.col("b.to_min")) & (F.col("b.from_min") < F.col("a.to_min"))
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    joined = a.join(b, [*same, (F.col("a.card") < F.col("b.card")) & dates & (~F.col("a.timed") | sched)])
    return joined.select(F.col("a.card").alias("card_a"), F.col("b.card").alias("card_b"))


def priced(events: DataFrame, cards: DataFrame, key: Sequence[str]) -> DataFrame:
    """events (key, model, token_class, ts) plus card and rate: the card in force, null if none.

    Date ranges are inclusive at both ends. A card whose schedule holds beats
    one without a schedule; a narrower window beats a wider one; then the
    latest start and the greatest card. A rate book is small: a vendor's
    published prices, not a table that grows with usage.
    """
    on = (
        (F.col("e.model") == F.col("c.model"))
        & (F.col("e.token_class") == F.col("c.token_class"))
        & (utc_date(F.col("e.ts")) >= F.col("c.start"))
        & (F.col("c.end").isNull() | (utc_date(F.col("e.ts")) <= F.col("c.end")))
        & (F.col("c.days").isNull() | schedule_contains(F.col("c.days"), F.col("c.from_min"), F.col("c.to_min"), F.col("e.ts")))
    )
    # The best card is a minimum over a key: partly aggregated before its shuffle, with no sort of the candidates.
    rank = F.struct(F.col("c.days").isNull().cast("int"), F.coalesce(F.col("c.to_min") - F.col("c.from_min"), F.lit(0)), -F.unix_date("c.start"), -F.col("c.card"))
    best = events.alias("e").join(cards.alias("c"), on, "left").groupBy(*[F.col(f"e.{k}") for k in key]).agg(F.min_by(F.struct("c.card", "c.rate"), rank).alias("b"))
    return best.select(*key, "b.card", "b.rate")


def cost(rate: Column, tokens: Column) -> Column:
    """Micros of money for tokens at a rate for a million, rounded for each event and class."""
    return round_div(big(rate) * tokens, 1_000_000)


def combine(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """values(by, currency, micros, missing): summed money; missing rates unite, and differing currencies leave no sum."""
    mixed = F.count_distinct("currency") > 1
    lack = F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing"))))
    return values.groupBy(*by).agg(mixed.alias("mixed"), F.sum("micros").cast("bigint").alias("sum"), lack.alias("missing"), F.min("currency").alias("currency")).withColumn("micros", F.when(~F.col("mixed") & (F.size("missing") == 0), F.col("sum"))).drop("sum")


def credits(tokens: dict[str, Column], rates: dict[str, int]) -> Column:
    """Micro-credits of a group's summed tokens: rounded for each kind after grouping. rates are micro-credits for a million tokens."""
    out = F.lit(0).cast("bigint")
    for kind, rate in rates.items():
        out = out + round_div(big(tokens[kind]) * rate, 1_000_000)
    return out


def window_points(lo: Column, hi: Column, coef_lo: int, coef_hi: int) -> Column:
    """Credits lo..hi as quota points, given credits for a point between coef_lo and coef_hi: widened to whole points."""
    return interval(floor_div(lo, coef_hi), ceil_div(hi, coef_lo))


def points_for_tokens(rate: Column, tokens: Column) -> Column:
    """Quota points: cut to whole hundredths first, then rounded; null outside a million."""
    points = round_div(trunc_div(big(rate) * tokens, F.lit(1_000_000).cast("decimal(38,0)")).cast("bigint"), 100)
    return F.when(F.abs(points) <= 1_000_000, points)


def saturated_points(a: Column, b: Column) -> Column:
    """The sum of two percentage-point values, held inside a million."""
    return clamp(a + b, -1_000_000, 1_000_000)


def latest_effective(rows: DataFrame, by: Sequence[str], effective: str, at: int, keep: Sequence[str], tie: str) -> DataFrame:
    """For each key the row in force at an instant: the latest effective at or before it."""
    return rows.where(F.col(effective) <= at).groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(effective, tie)).alias("r")).select(*by, "r.*")


def active_across(*shapes: tuple[DataFrame, int], by: Sequence[str], ts: str) -> DataFrame:
    """The latest lifecycle row of each key over several result tables, the first shape winning ties."""
    both = None
    for rows, preference in shapes:
        part = rows.withColumn("preference", F.lit(preference))
        both = part if both is None else both.unionByName(part)
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc(), "preference")
    return both.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "preference")
