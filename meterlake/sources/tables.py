"""The ledger's relations over the star-schema tables, and the same as SQL for the oracles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import nanos


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def occurrences(spark: SparkSession, sf_dir: str, more: Sequence[str] = ()) -> DataFrame:
    """Usage as it was read, duplicates included: a row for each line item, with more of its columns as they are."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("native_id"),
        "l_orderkey", "l_partkey", "l_suppkey",
        nanos(F.col("l_shipdate")).alias("ts"),
        F.round("l_quantity").cast("bigint").alias("input"),
        _cents("l_extendedprice").alias("output"),
        _cents("l_discount").alias("cache_read"),
        _cents("l_tax").alias("cache_write"),
        "l_returnflag", "l_linestatus", *more,
    )


#: The order of a message's occurrences: there is no row number, so all columns decide.
OCCURRENCE_ORDER = ("ts", "l_partkey", "l_suppkey", "input", "output", "cache_read", "cache_write", "l_returnflag", "l_linestatus")

OCC_SQL = """
occ AS (
  SELECT l_orderkey || '-' || l_linenumber AS native_id, l_orderkey, l_partkey, l_suppkey, epoch_us(l_shipdate) * 1000 AS ts,
         round(l_quantity)::BIGINT AS input, round(l_extendedprice * 100)::BIGINT AS output, round(l_discount * 100)::BIGINT AS cache_read,
         round(l_tax * 100)::BIGINT AS cache_write, l_returnflag, l_linestatus
  FROM lineitem)"""
ORDER_SQL = ", ".join(OCCURRENCE_ORDER)


def sessions(spark: SparkSession, sf_dir: str, more: Sequence[str] = (), orders: DataFrame | None = None) -> DataFrame:
    """order key -> session, harness, account, project, and more columns of orders and customers as they are; orders may be given as they are dealt."""
    orders, customer = table(spark, sf_dir, "orders") if orders is None else orders, table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    out = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", F.col("o_custkey").alias("session"), F.col("o_orderstatus").alias("harness"), F.col("n_name").alias("account"), F.col("r_name").alias("project"), *more)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part key -> model id."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("/"), F.col("p_brand")).alias("model"))


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(event_id, ts ns, user_id, event_type, amount, k); kind keeps one type of event."""
    rows = table(spark, sf_dir, "events")
    if kind is not None:
        rows = rows.where(F.col("event_type") == kind)
    return rows.select("event_id", nanos(F.col("ts")).alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("amount"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EV_SQL = """
ev AS (
  SELECT event_id, epoch_us(ts) * 1000 AS ts, user_id, event_type, round(value * 100)::BIGINT AS amount, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, ts, used_ppm, observation): one quota meter for each account."""
    return events(spark, sf_dir, "view").select(F.col("user_id").alias("account"), "ts", F.pmod(F.col("amount") * 10, F.lit(1_000_001)).cast("bigint").alias("used_ppm"), F.col("event_id").alias("observation"))


METER_SQL = "meter AS (SELECT user_id AS account, ts, (amount * 10) % 1000001 AS used_ppm, event_id AS observation FROM ev WHERE event_type = 'view')"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, attempt, ts, outcome, context, retry_s): outcome from the kind of event, credential context and hold from its number."""
    rows = events(spark, sf_dir)
    outcome = F.when(F.col("event_type") == "error", F.when(F.col("k") % 3 == 0, "auth_required").when(F.col("k") % 3 == 1, "unreachable").otherwise("rate_limited")).when((F.col("event_type") == "purchase") & (F.col("k") % 4 == 0), "interrupted").otherwise("success")
    return rows.select(F.col("user_id").alias("account"), F.col("event_id").alias("attempt"), "ts", outcome.alias("outcome"), F.when(F.col("k") % 5 != 0, F.col("k") % 7).alias("context"), F.when(F.col("k") % 2 == 0, F.col("k") * 10).alias("retry_s"))


ATT_SQL = """
att AS (
  SELECT user_id AS account, event_id AS attempt, ts,
         CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 'auth_required' WHEN 1 THEN 'unreachable' ELSE 'rate_limited' END
              WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'interrupted' ELSE 'success' END AS outcome,
         CASE WHEN k % 5 <> 0 THEN k % 7 END AS context, CASE WHEN k % 2 = 0 THEN k * 10 END AS retry_s
  FROM ev)"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, ts, account, rank, okey, marker): account markers of sessions."""
    rows = events(spark, sf_dir, "signup")
    return rows.select(F.col("user_id").alias("session"), "ts", F.concat(F.lit("acct-"), (F.col("k") % 5).cast("string")).alias("account"), (1 + F.col("k") % 3).alias("rank"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("okey"), F.col("event_id").alias("marker"))


MARK_SQL = "mark AS (SELECT user_id AS session, ts, 'acct-' || (k % 5) AS account, 1 + k % 3 AS rank, CASE WHEN k % 2 = 0 THEN k END AS okey, event_id AS marker FROM ev WHERE event_type = 'signup')"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim, session, ts, task, kind): task claims and releases."""
    rows = events(spark, sf_dir, "purchase")
    return rows.select(F.col("event_id").alias("claim"), F.col("user_id").alias("session"), "ts", F.concat(F.lit("task-"), (F.col("k") % 20).cast("string")).alias("task"), F.when(F.col("event_id") % 2 == 0, "claim").otherwise("release").alias("kind"))


CLAIM_SQL = "claim AS (SELECT user_id AS session, ts, 'task-' || (k % 20) AS task, CASE WHEN event_id % 2 = 0 THEN 'claim' ELSE 'release' END AS kind FROM ev WHERE event_type = 'purchase')"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, session, ts, tokens): usage to be attributed."""
    return events(spark, sf_dir, "click").select("event_id", F.col("user_id").alias("session"), "ts", F.col("amount").alias("tokens"))


USE_SQL = "use AS (SELECT event_id, user_id AS session, ts, amount AS tokens FROM ev WHERE event_type = 'click')"
