"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight at every knot of a schedule over training time 0..1,
and weights run linearly between knots: so much of the source training asks
for at that time. Their integral over time is the source's share of all words.
A source is never read more than `most` times: what exceeds that is shared out
again by these integrals.

Inside a source, documents stand in the order of a hash of id and text. The
words before a document are the source's cumulative demand at which training
needs it; inverting the integrated weight gives the time, its training position.

A source may hold any part of all rows: running sums are taken inside 1,024
hash ranges of a source and completed by the ranges' own totals. Only rows that
repeat an id with its text stand together in one range. The table of sources,
with a row for each, is ranked and filled up in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, doc_text

#: Hash ranges of a source: 2**RANGE_BITS.
RANGE_BITS = 10


def word_count() -> Column:
    return F.regexp_count(doc_text(), F.lit(WORD)).cast("bigint")


def _hash60() -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), doc_text())), 1, 15), 16, 10).cast("bigint")


def rising_and_falling(rank: Column) -> Column:
    """Weights that integrate to 1, 2, 3, repeating; those of odd ranks fall from one and a half of it to a half, the others rise. rank counts sources from 1."""
    w = (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")
    return F.when(F.pmod(rank, F.lit(2)) == 1, F.array(w * 1.5, w * 0.5)).otherwise(F.array(w * 0.5, w * 1.5))


def source_plan(sizes: DataFrame, weights: Callable[[Column], Column], most: int) -> DataFrame:
    """(skey, source_size, target, take, at array, reached array) with one row for each source.

    sizes has skey and size. weights maps the rank of a source by code point
    (null last) to its weights at the knots (two or more, none below zero): at.
    reached is their integral up to each knot. A source whose weights are all
    zero has target zero; if all are, every target is.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("at", weights(F.row_number().over(Window.orderBy("skey"))))
    width = F.lit(1.0) / (F.size("at") - 1)
    steps = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda j: (F.element_at("at", j) + F.element_at("at", j + 1)) / 2 * width)
    reached = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    plan = ranked.withColumn("reached", reached).withColumn("w", F.element_at("reached", -1))
    # Filling up to the limits: sources reach their limit in the order of limit / weight; the level at which the rest is served is the greatest of the levels met on the way.
    everything = Window.partitionBy()
    cap = F.col("source_size") * most
    order = Window.orderBy(F.when(F.col("w") > 0, cap / F.col("w")).asc_nulls_last(), "skey")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    plan = plan.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", F.when(F.col("w") > 0, (F.col("total") - before) / rest))
    level = F.coalesce(F.max("level").over(everything), F.lit(0.0))
    plan = plan.withColumn("target", F.least(cap.cast("double"), level * F.col("w")))
    return plan.select("skey", "source_size", "target", F.least(F.round("target").cast("bigint"), cap).alias("take"), "at", "reached")


def position(offset: Column, take: Column) -> Column:
    """The time at which a source's demand reaches offset words of its take."""
    y = offset / take * F.element_at("reached", -1)
    seg = F.least(F.greatest(F.size(F.filter("reached", lambda r: r <= y)), F.lit(1)), F.size("at") - 1)
    a, b = F.element_at("at", seg), F.element_at("at", seg + 1)
    width = F.lit(1.0) / (F.size("at") - 1)
    done = y - F.element_at("reached", seg)
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) / width * done, F.lit(0.0)))
    return (seg - 1) * width + F.when(a + root > 0, 2 * done / (a + root)).otherwise(F.lit(0.0))


def mix(docs: DataFrame, weights: Callable[[Column], Column] = rising_and_falling, most: int = 3) -> DataFrame:
    """docs plus size, source_size, target, take, before, taken and the plan's at and reached.

    docs has doc_id, text and source; other columns pass through, but for those
    of the added columns' names, which are replaced. Null text has
    size 0; null source is a source of its own, after all others; null ids
    count as an empty id. Rows with equal ids and texts are interchangeable.
    Words are taken from whole passes over a source, then from its first
    documents, the last of which may be taken in part. A source without words
    gets none, nor does one of weight zero; an empty table gives an empty one.
    Texts may be of any length.
    """
    mixed = _placed(docs, weights, most)
    facts = [c for c in mixed.columns if c != "row"]
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in facts], *facts)


def _placed(docs: DataFrame, weights: Callable[[Column], Column], most: int, columns: list[str] | None = None) -> DataFrame:
    """What mix() gives, with docs' own columns, or those named, in the struct row."""
    skey = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    sized = docs.select(F.struct(*(columns or docs.columns)).alias("row"), skey.alias("skey"), word_count().alias("size"), _hash60().alias("h"))
    sized = sized.withColumn("bin", F.shiftright("h", 60 - RANGE_BITS).cast("int"))
    bins = sized.groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"))
    plan = source_plan(bins.withColumnRenamed("bin_size", "size"), weights, most)
    run = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(run), F.lit(0))).drop("bin_size").join(plan, "skey")
    inside = Window.partitionBy("skey", "bin").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["skey", "bin"]).withColumn("before", F.col("bin_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0))
    part = F.col("take") - passes * F.col("source_size") - F.col("before")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part))
    return placed.select("row", "size", "source_size", "target", "take", "before", taken.cast("bigint").alias("taken"), "at", "reached")


def training_order(docs: DataFrame, weights: Callable[[Column], Column] = rising_and_falling, most: int = 3) -> DataFrame:
    """docs' columns, a row for each time that the mix takes a document, range-sorted by training position.

    A document taken in part counts as taken if that is half of it or more.
    Columns of any names pass through. Documents without words aren't taken.
    """
    mixed = _placed(docs, weights, most)
    copies = F.floor((F.col("taken") + F.col("size") / 2) / F.col("size")).cast("int")
    each = mixed.where("size > 0").withColumn("copies", copies).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    when = position(F.col("pass") * F.col("source_size") + F.col("before"), F.col("take"))
    placed = each.select("row", when.alias("when"), F.col("row")["doc_id"].alias("id"))
    return placed.repartitionByRange("when", "id").sortWithinPartitions("when", "id").select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document, range-sorted by the position of its first word taken (null: none taken)."""
    mixed = _placed(docs, rising_and_falling, 3, ["doc_id"])
    when = F.when(F.col("taken") > 0, F.round(position(F.col("before"), F.col("take")), 6))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", when.alias("position")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
numbered AS (SELECT *, row_number() OVER (ORDER BY skey) AS k FROM per),
-- Weights run from a to b over time; both schedules integrate to w.
ranked AS (SELECT *, ((k - 1) % 3 + 1)::DOUBLE AS w, w * CASE WHEN k % 2 = 1 THEN 1.5 ELSE 0.5 END AS a, w * CASE WHEN k % 2 = 1 THEN 0.5 ELSE 1.5 END AS b FROM numbered),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY 3 * source_size / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
plan AS (
  SELECT skey, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target, w, a, b FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target, w, a, b, least(round(target)::BIGINT, 3 * source_size) AS take,
         coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN plan USING (skey)),
done AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE take // source_size END AS passes FROM placed),
counted AS (
  SELECT *, (passes * size + greatest(0, least(size, take - passes * source_size - before)))::BIGINT AS taken FROM done)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * (before / take * w) / (a + sqrt(a * a + 2 * (b - a) * (before / take * w))), 6) END AS position
FROM counted
"""
