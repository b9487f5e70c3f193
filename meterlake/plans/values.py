"""Queries over prices, credits and quota points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, exact
from ..operators import spend, valuation
from ..sources import tables as t
from .ledger import DEDUP_SQL, canonical
from .meters import M_SQL, observations
from .registry import query

# Fixed values of the sample rate book: card, model family, class, micros for a million tokens, first and last day, weekday bits, minutes.
CARDS = (
    (1, "standard", "input", 3_000_000, "1995-01-01", None, None, None, None),
    (2, "standard", "input", 2_500_000, "1998-01-01", None, None, None, None),
    (3, "standard", "input", 2_000_000, "1996-01-01", "1999-12-31", 31, 0, 720),
    (4, "standard", "input", 1_500_000, "1996-06-01", None, 3, 0, 60),
    (5, "standard", "output", 15_000_000, "1995-01-01", None, None, None, None),
    (6, "premium", "input", 5_000_001, "1997-01-01", None, None, None, None),
    (7, "premium", "output", 25_000_003, "1997-01-01", "2000-06-30", None, None, None),
    (8, "economy", "output", 999_999, "1992-01-01", None, 96, 0, 1440),
)
CARD_SCHEMA = "card int, model string, token_class string, rate bigint, start string, end string, days int, from_min int, to_min int"


def cards(spark):
    rows = spark.createDataFrame(list(CARDS), CARD_SCHEMA)
    return rows.withColumn("start", F.col("start").cast("date")).withColumn("end", F.col("end").cast("date"))


def _lit(x):
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


CARD_SQL = "card AS (SELECT card, model, token_class, rate::BIGINT AS rate, first::DATE AS first, last::DATE AS last, days::INT AS days, from_min::INT AS from_min, to_min::INT AS to_min FROM (VALUES " + ", ".join(f"({', '.join(map(_lit, c))})" for c in CARDS) + ") v(card, model, token_class, rate, first, last, days, from_min, to_min))"
PRICE_SQL = f"""
{DEDUP_SQL}, {CARD_SQL},
fam AS (SELECT native_id, CASE (l_partkey % 3) WHEN 0 THEN 'standard' WHEN 1 THEN 'premium' ELSE 'economy' END AS model, ts, input, output, l_orderkey FROM canon),
long AS (SELECT native_id, model, ts, l_orderkey, token_class, tokens FROM (UNPIVOT fam ON input, output INTO NAME token_class VALUE tokens)),
cand AS (
  SELECT long.*, card.card, card.rate, row_number() OVER (PARTITION BY native_id, long.token_class ORDER BY days IS NULL, to_min - from_min, first DESC, card.card DESC) AS nth
  FROM long LEFT JOIN card ON card.model = long.model AND card.token_class = long.token_class AND make_timestamp(ts // 1000)::DATE BETWEEN first AND coalesce(last, DATE '9999-12-31')
   AND (days IS NULL OR ((days >> (isodow(make_timestamp(ts // 1000)) - 1)::INT) & 1 = 1 AND ts // 60000000000 % 1440 >= from_min AND ts // 60000000000 % 1440 < to_min))),
priced AS (SELECT native_id, l_orderkey, model, token_class, tokens, card, rate, ((2 * rate::HUGEINT * tokens + 1000000) // 2000000)::BIGINT AS micros FROM cand WHERE nth = 1)"""


def priced(spark, sf_dir):
    """(native_id, l_orderkey, model, token_class, tokens, card, rate, micros) for each canonical event and class."""
    family = F.element_at(F.array(F.lit("standard"), F.lit("premium"), F.lit("economy")), (F.col("l_partkey") % 3 + 1).cast("int"))
    events = canonical(spark, sf_dir).select("native_id", "l_orderkey", family.alias("model"), "ts", "input", "output").unpivot(["native_id", "l_orderkey", "model", "ts"], ["input", "output"], "token_class", "tokens")
    # The book is as large as CARDS: a handful of rows, broadcast.
    return valuation.priced(events, F.broadcast(cards(spark)), ["native_id", "l_orderkey", "model", "token_class", "tokens"]).withColumn("micros", valuation.cost(F.col("rate"), F.col("tokens")))


@query("JN-10_rate_lookup", f"WITH {PRICE_SQL} SELECT native_id, token_class, coalesce(card, 0) AS card FROM priced")
def jn10(spark, sf_dir):
    return priced(spark, sf_dir).select("native_id", "token_class", F.coalesce("card", F.lit(0)).alias("card"))


@query("SF-9_cost_per_class", f"WITH {PRICE_SQL} SELECT token_class, model, count(micros) AS priced, coalesce(sum(micros), 0)::BIGINT AS micros FROM priced GROUP BY ALL")
def sf9(spark, sf_dir):
    return priced(spark, sf_dir).groupBy("token_class", "model").agg(F.count("micros").alias("priced"), F.coalesce(F.sum("micros"), F.lit(0)).cast("bigint").alias("micros"))


@query(
    "AG-20_valuation_combine",
    f"WITH {PRICE_SQL}, o AS (SELECT l_orderkey % 100 AS grp, CASE WHEN l_orderkey % 50 = 7 THEN 'EUR' ELSE 'USD' END AS currency, micros, CASE WHEN micros IS NULL THEN model || ':' || token_class END AS lack FROM priced) SELECT grp, count(DISTINCT currency) > 1 AS mixed, min(currency) AS currency, coalesce(array_to_string(list_sort(list(DISTINCT lack) FILTER (WHERE lack IS NOT NULL)), ','), '') AS missing, CASE WHEN count(DISTINCT currency) <= 1 AND count(lack) = 0 THEN sum(micros)::BIGINT ELSE -1 END AS micros FROM o GROUP BY grp",
)
def ag20(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("missing", F.when(F.col("micros").isNull(), F.array(F.concat_ws(":", "model", "token_class"))).otherwise(F.array().cast("array<string>")))
    rows = rows.select((F.col("l_orderkey") % 100).alias("grp"), F.when(F.col("l_orderkey") % 50 == 7, "EUR").otherwise("USD").alias("currency"), "micros", "missing")
    return valuation.combine(rows, ["grp"]).select("grp", "mixed", "currency", F.array_join("missing", ",").alias("missing"), F.coalesce("micros", F.lit(-1)).alias("micros"))


BOOK_SQL = """book AS (
  SELECT p_partkey AS card, p_brand AS model, p_type AS token_class, DATE '2024-01-01' + (p_partkey * 37 % 900)::INTEGER AS first, CASE WHEN p_partkey % 9 <> 0 THEN DATE '2024-01-01' + (p_partkey * 37 % 900 + p_size)::INTEGER END AS last,
         CASE p_partkey % 4 WHEN 0 THEN 31 WHEN 1 THEN 96 END AS days, CASE WHEN p_partkey % 4 < 2 THEN p_size * 10 END AS from_min, CASE WHEN p_partkey % 4 < 2 THEN p_size * 10 + 300 END AS to_min FROM part)"""


@query(
    "JN-9_card_overlap",
    f"WITH {BOOK_SQL} SELECT a.card AS card_a, b.card AS card_b FROM book a JOIN book b ON a.model = b.model AND a.token_class = b.token_class AND a.card < b.card AND a.first <= coalesce(b.last, DATE '9999-12-31') AND b.first <= coalesce(a.last, DATE '9999-12-31') AND ((a.days IS NULL AND b.days IS NULL) OR ((a.days & b.days) <> 0 AND a.from_min < b.to_min AND b.from_min < a.to_min))",
)
def jn9(spark, sf_dir):
    """A rate book of a card for each part: its brand and type stand for model and token class, its number and size for dates and schedules."""
    p, n, size = t.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    first = F.date_add(F.lit("2024-01-01").cast("date"), (n * 37 % 900).cast("int"))
    timed = n % 4 < 2
    book = p.select(
        n.alias("card"), F.col("p_brand").alias("model"), F.col("p_type").alias("token_class"), first.alias("start"), F.when(n % 9 != 0, F.date_add(first, size.cast("int"))).alias("end"),
        F.when(n % 4 == 0, 31).when(n % 4 == 1, 96).alias("days"), F.when(timed, size * 10).alias("from_min"), F.when(timed, size * 10 + 300).alias("to_min"),
    )
    return valuation.overlapping_cards(book)


@query("SF-8_schedule", f"WITH {M_SQL} SELECT observation, (31 >> (isodow(make_timestamp(ts // 1000)) - 1)::INT) & 1 = 1 AND ts // 60000000000 % 1440 >= 480 AND ts // 60000000000 % 1440 < 1080 AS inside FROM meter")
def sf8(spark, sf_dir):
    return t.meter(spark, sf_dir).select("observation", clock.schedule_contains(F.lit(31), F.lit(480), F.lit(1080), F.col("ts")).alias("inside"))


# Micro-credits for a million tokens of each kind.
CREDIT_RATES = {"input": 3_000_000, "output": 15_000_000, "cache_read": 300_000, "cache_write": 3_750_000}
CREDIT_SQL = " + ".join(f"(2 * sum({k})::HUGEINT * {r} + 1000000) // 2000000" for k, r in CREDIT_RATES.items())


@query("SF-10_credits", f"WITH {DEDUP_SQL} SELECT l_orderkey, ({CREDIT_SQL})::BIGINT AS credits FROM canon GROUP BY l_orderkey")
def sf10(spark, sf_dir):
    rows = canonical(spark, sf_dir).groupBy("l_orderkey").agg(*[F.sum(k).alias(k) for k in CREDIT_RATES])
    return rows.select("l_orderkey", valuation.credits({k: F.col(k) for k in CREDIT_RATES}, CREDIT_RATES).alias("credits"))


@query("SF-11_window_points", f"WITH {DEDUP_SQL}, c AS (SELECT l_orderkey, ({CREDIT_SQL})::BIGINT AS credits FROM canon GROUP BY l_orderkey) SELECT l_orderkey, greatest(credits - 1000, 0) // 1300 AS lo, -(-(credits + 1000) // 1100) + CASE WHEN (credits + 1000) % 1100 <> 0 THEN 1 ELSE 0 END AS hi FROM c")
def sf11(spark, sf_dir):
    rows = sf10(spark, sf_dir)
    return rows.withColumn("p", valuation.window_points(F.greatest(F.col("credits") - 1000, F.lit(0)), F.col("credits") + 1000, 1100, 1300)).select("l_orderkey", "p.lo", "p.hi")


@query("SF-13_basis_points", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN CASE WHEN n < 0 THEN -((2 * -n + 2 * 0 + b) // (2 * b)) ELSE (2 * n + b) // (2 * b) END END AS bp FROM (SELECT o_orderkey, o_custkey, (round(o_totalprice * 100)::BIGINT - 5000000) * 10000 AS n, abs((o_custkey % 5) * 100000) AS b FROM orders)")
def sf13(spark, sf_dir):
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"), ((F.col("o_custkey") % 5) * 100_000).alias("b"))
    return rows.select("o_orderkey", exact.basis_points(F.col("b") + F.col("v") - 5_000_000, F.col("b")).alias("bp"))


@query("SF-16_headroom", f"WITH {M_SQL} SELECT observation, least((1000000 - used_ppm) * 900 // 1000000, (1000000 - used_ppm) * 1300 // 1000000) AS lo, greatest((1000000 - used_ppm) * 900 // 1000000, (1000000 - used_ppm) * 1300 // 1000000) AS hi FROM meter")
def sf16(spark, sf_dir):
    from ..operators.advice import headroom

    return t.meter(spark, sf_dir).withColumn("h", headroom(1_000_000 - F.col("used_ppm"), F.lit(900), F.lit(1300))).select("observation", "h.lo", "h.hi")


@query("JN-11_policy_asof", f"WITH {M_SQL} SELECT account, arg_max(observation, {{'r': ts, 'o': observation}}) AS observation FROM meter WHERE ts <= 1705000000000000000 GROUP BY account")
def jn11(spark, sf_dir):
    return valuation.latest_effective(t.meter(spark, sf_dir), ["account"], "ts", 1_705_000_000 * clock.SECOND, ["observation"], "observation")


@query(
    "JN-17_active_across_shapes",
    f"WITH {M_SQL}, u AS (SELECT account, ts // 86400000000000 AS day, observation, 0 AS pref FROM meter WHERE observation % 2 = 0 UNION ALL SELECT account, ts // 86400000000000, observation, 1 FROM meter WHERE observation % 2 = 1), f AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY day DESC, pref, observation DESC) AS nth FROM (SELECT account, day, max(observation) AS observation, pref FROM u GROUP BY account, day, pref)) SELECT account, day, observation FROM f WHERE nth = 1",
)
def jn17(spark, sf_dir):
    rows = t.meter(spark, sf_dir).withColumn("day", F.expr("ts div 86400000000000"))
    shape = lambda k: rows.where(F.col("observation") % 2 == k).groupBy("account", "day").agg(F.max("observation").alias("observation"))
    return valuation.active_across((shape(0), 0), (shape(1), 1), by=["account"], ts="day")


@query("AG-2_unknown_map_sum", f"WITH {t.EV_SQL} SELECT user_id, event_type AS kind, sum(k)::BIGINT AS tokens FROM ev GROUP BY ALL")
def ag2_map(spark, sf_dir):
    rows = t.events(spark, sf_dir).select("user_id", F.create_map("event_type", "k").alias("unknown"))
    return spend.map_sum(rows, ["user_id"], "unknown").select("user_id", F.explode("unknown").alias("kind", "tokens"))


@query("SF-23_authoritative", f"WITH {M_SQL} SELECT observation, abs(used_ppm - (used_ppm // 10000) * 10000) <= 4000 AS agrees FROM meter")
def sf23(spark, sf_dir):
    near = F.abs(F.col("used_ppm") - F.expr("used_ppm div 10000") * 10_000) <= 4000
    return observations(spark, sf_dir).select("observation", near.alias("agrees"))
