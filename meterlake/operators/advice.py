"""Capacity advice: nearest-rank history, fallback ladder, headroom, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import PPM, share_ppm


def nearest_ranks(rows: DataFrame, by: Sequence[str], value: str, percents: dict[str, int]) -> DataFrame:
    """(by, n, a column for each of percents): the value at rank ceil(p * n / 100) of each group, at least the first.

    Values are whole and not below zero; nulls are left out. No group is sorted
    as one: values are counted, the counts gathered by the values' length and
    leading bits, and only the bins that hold a wanted rank are ordered.
    """
    bits = F.bin(value)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")).withColumn("__bin", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.left(bits, F.lit(10))))
    run = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = counts.groupBy(*by, "__bin").agg(F.sum("__n").alias("__m")).withColumns({"__upto": F.sum("__m").over(run), "n": F.sum("__m").over(Window.partitionBy(*by))})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.call_function("div", p * F.col("n") + 99, F.lit(100))).alias("rank")) for name, p in percents.items()])
    hit = bins.select(*by, "__bin", "n", "__upto", "__m", F.explode(wanted).alias("w")).where("w.rank <= __upto and w.rank > __upto - __m").select(*by, "__bin", "n", "w.name", (F.col("w.rank") - F.col("__upto") + F.col("__m")).alias("__left"))
    c, h = counts.alias("c"), hit.alias("h")
    inside = c.join(h, [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in (*by, "__bin")]).select("h.*", f"c.{value}", "c.__n")
    upto = F.sum("__n").over(Window.partitionBy(*by, "name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("__upto", upto).where("__upto >= __left")
    return found.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("name") == name, F.col(value))).alias(name) for name in percents])


def history_distribution(samples: DataFrame, by: Sequence[str], value: str, reasons: dict[str, Column], least: int = 12, low: int = 25, high: int = 75, upper: int = 90) -> DataFrame:
    """(by, included, excluded_<reason>, coverage_ppm, p50, central_low, central_high, upper, state) for each group.

    A sample counts for the first reason that excludes it. Coverage is the part
    of all priced value that included samples hold. Quantiles are by nearest
    rank in whole numbers; below `least` samples there are none.
    """
    why = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in reasons.items()]) if reasons else F.lit(None).cast("string")
    tagged = samples.withColumn("why", why)
    fine = F.col("why").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    groups = tagged.groupBy(*by).agg(F.count_if(fine).alias("included"), *[F.count_if(F.col("why") == r).alias(f"excluded_{r}") for r in reasons], total(F.when(fine, F.col(value))).alias("some"), total(F.col(value)).alias("all"))
    ranks = nearest_ranks(tagged.where(fine), by, value, {"p50": 50, "central_low": low, "central_high": high, "upper": upper})
    g, r = groups.alias("g"), ranks.alias("r")
    enough = F.col("g.included") >= least
    out = g.join(r, [F.col(f"g.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by], "left")
    quantiles = [F.when(enough, F.col(f"r.{c}")).alias(c) for c in ("p50", "central_low", "central_high", "upper")]
    return out.select(*[f"g.{k}" for k in by], "g.included", *[f"g.excluded_{x}" for x in reasons], share_ppm(F.col("g.some"), F.col("g.all")).alias("coverage_ppm"), *quantiles, F.when(enough, "sufficient").otherwise("insufficient").alias("state"))


def fallback_ladder(samples: DataFrame, ladder: Sequence[Sequence[str]], least: int = 12) -> DataFrame:
    """For each cell of the first rung the first rung whose group has enough samples: (cell, level, n), level null if none."""
    cells = samples.select(*ladder[0]).distinct()
    found = cells
    for i, rung in enumerate(ladder):
        if rung:
            counts = samples.groupBy(*rung).agg(F.count("*").alias(f"n{i}"))
            found = found.join(counts, list(rung), "left")
        else:
            found = found.withColumn(f"n{i}", F.lit(None).cast("bigint")).drop(f"n{i}").crossJoin(samples.agg(F.count("*").alias(f"n{i}")))
    level = F.coalesce(*[F.when(F.col(f"n{i}") >= least, F.lit(i)) for i in range(len(ladder))])
    n = F.coalesce(*[F.when(F.col(f"n{i}") >= least, F.col(f"n{i}")) for i in range(len(ladder))])
    return found.select(*ladder[0], level.alias("level"), n.alias("n"))


def headroom(remaining_ppm: Column, coef_lo: Column, coef_hi: Column) -> Column:
    """Credits left behind a remaining part, given credits for a full window between two bounds."""
    a, b = F.call_function("div", remaining_ppm * coef_lo, F.lit(PPM)), F.call_function("div", remaining_ppm * coef_hi, F.lit(PPM))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def verdict(headroom_lo: Column, headroom_hi: Column, median: Column, upper: Column, multiple: int = 2) -> Column:
    """AMPLE if even the low end covers the upper quantile several times; INSUFFICIENT if the median exceeds the high end; else MARGINAL."""
    return F.when(headroom_lo >= upper * multiple, "AMPLE").when(median > headroom_hi, "INSUFFICIENT").otherwise("MARGINAL")


def readiness(checks: dict[str, Column]) -> Column:
    """All missing prerequisites, in order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
