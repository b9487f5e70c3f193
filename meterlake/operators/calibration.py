"""Calibration: settled plateaus, blocks, robust and multivariate fits, gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SECOND
from ..functions.exact import floor_div
from ..sources.staging import staged
from .timeline import sums_within

# What settles a plateau.
POINTS, SPACING, SPAN, UNITS, WITHIN = 3, 300 * SECOND, 600 * SECOND, 0, 3600 * SECOND
# Of long series: points in a block, rows whose pairs are made at once, bits of a slope that a pass settles.
BLOCK, STRIP, DIGIT = 2048, 64, 16


def plateau_ends(rows: DataFrame, by: Sequence[str], points: int = POINTS, spacing: int = SPACING, span: int = SPAN, units: int = UNITS, within: int | None = None) -> DataFrame:
    """rows plus ok: whether a series held still up to this row, for `points` observations far enough apart, of one resolution, that changed by no more than units of it and took no longer than `within`."""
    w = Window.partitionBy(*by).orderBy("ts")
    frame = w.rowsBetween(1 - points, 0)
    gapped = rows.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    inner = w.rowsBetween(2 - points, 0)
    plateau = (
        (F.count("*").over(frame) == points)
        & (F.min("gap").over(inner) >= spacing)
        & (F.col("ts") - F.min("ts").over(frame) >= span)
        # Whole units of the resolution count: a change of less than one more is none.
        & (F.max("used_ppm").over(frame) - F.min("used_ppm").over(frame) < (units + 1) * F.col("resolution"))
        & (F.min("resolution").over(frame) == F.max("resolution").over(frame))
    )
    if within is not None:
        plateau = plateau & (F.col("ts") - F.min("ts").over(frame) <= within)
    return gapped.withColumn("ok", plateau)


def settled(rows: DataFrame, by: Sequence[str], points: int = POINTS, spacing: int = SPACING, span: int = SPAN, units: int = UNITS) -> DataFrame:
    """(by, settled_at): when each series first held still."""
    return plateau_ends(rows, by, points, spacing, span, units).where("ok").groupBy(*by).agg(F.min("ts").alias("settled_at"))


def settlement(observations: DataFrame, series: DataFrame, by: Sequence[str], points: int = POINTS, spacing: int = SPACING, span: int = SPAN, units: int = UNITS, within: int = WITHIN) -> DataFrame:
    """(by, settled, settled_at, used_ppm, reason, deadline, observed_until): the outcome of waiting for each series to hold still.

    series is (by, started_at, covered, resolution), a row for each key;
    observations is (by, ts, used_ppm, resolution). Only those from the start to
    the deadline, `within` later, count, and a plateau is of the series'
    resolution. Where coverage is insufficient or unknown that is the reason,
    however stable the readings look; else no_plateau_within_window. A series
    without observations has a row, observed_until null.
    """
    known = series.select(*by, "started_at", "covered", F.col("resolution").alias("__resolution"), (F.col("started_at") + within).alias("deadline"))
    rows = observations.select(*by, "ts", "used_ppm", "resolution").join(known, list(by)).where(F.col("ts") >= F.col("started_at"))
    until = rows.groupBy(*by).agg(F.max("ts").alias("observed_until"))
    ends = plateau_ends(rows.where(F.col("ts") <= F.col("deadline")), by, points, spacing, span, units).where(F.col("ok") & (F.col("resolution") == F.col("__resolution")))
    first = ends.groupBy(*by).agg(F.min(F.struct(F.col("ts").alias("settled_at"), "used_ppm")).alias("first"))
    out = known.join(until, list(by), "left").join(first, list(by), "left")
    covered = F.coalesce("covered", F.lit(False))
    reason = F.when(~covered, "insufficient_meter_coverage").when(F.col("first").isNull(), "no_plateau_within_window")
    shown = F.when(covered, F.col("first"))
    return out.select(*by, reason.isNull().alias("settled"), shown["settled_at"].alias("settled_at"), shown["used_ppm"].alias("used_ppm"), reason.alias("reason"), "deadline", "observed_until")


def passive_intervals(rows: DataFrame, by: Sequence[str], **plateau: int) -> DataFrame:
    """rows(by, ts, observation, used_ppm, resolution, resets_at) -> (by, start, end, settled, reset_inside): the intervals that passive calibration considers.

    They lie between the ends of consecutive settled plateaus where a series
    has two or more, else between consecutive observations, unsettled. start
    and end are the observations there. A reset is inside if any observation
    of the interval names one, or if usage fell by more than the resolution.
    """
    w = Window.partitionBy(*by).orderBy("ts", "observation")
    flagged = plateau_ends(rows, by, **({"within": WITHIN} | plateau))
    # A plateau has the resolution of the series' first observation.
    flagged = flagged.withColumn("ok", F.col("ok") & (F.col("resolution") == F.first("resolution").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    flagged = flagged.withColumn("settled", F.count_if("ok").over(Window.partitionBy(*by)) >= 2)
    flagged = flagged.withColumn("edge", F.col("ok") | ~F.col("settled"))
    pieces = flagged.withColumn("piece", F.count_if("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("ts", "observation", "used_ppm", "resolution")
    found = pieces.where("edge").select(*by, "piece", "settled", at.alias("start"), F.lead(at).over(w).alias("end")).where("end is not null")
    # An edge ends one interval and begins the next.
    inside = pieces.where("resets_at is not null").select(*by, "resets_at", F.explode(F.when(F.col("edge"), F.array(F.col("piece") - 1, "piece")).otherwise(F.array("piece"))).alias("piece"))
    named = inside.join(found, [*by, "piece"]).where((F.col("resets_at") > F.col("start.ts")) & (F.col("resets_at") < F.col("end.ts"))).select(*by, "piece", F.lit(True).alias("named")).distinct()
    fell = F.col("end.used_ppm") < F.col("start.used_ppm") - F.col("start.resolution")
    return found.join(named, [*by, "piece"], "left").select(*by, "start", "end", "settled", (fell | F.coalesce("named", F.lit(False))).alias("reset_inside"))


#: Columns of evidence on an interval, each with the reason that it gives when false or unknown. In the reference's order.
PASSIVE_CONDITIONS = {
    "attributed": "high_confidence_account_attribution",
    "both_sides": "meter_observations_on_both_sides",
    "no_reset": "no_reset_inside",
    "same_tier": "unchanged_plan_tier",
    "exact_usage": "exact_contributing_usage",
    "known_components": "no_unknown_token_components",
    "covered": "sufficient_meter_coverage",
    "alone": "no_second_local_session_or_consumer",
    "permitted": "exclusivity_policy_permits_passive",
    "settled": "server_side_settlement_satisfied",
    "no_anomaly": "meter_window_anomaly",
    "no_mismatch": "external_validation_mismatch",
}


def passive_reasons(intervals: DataFrame) -> DataFrame:
    """passive_intervals plus columns of evidence -> the same plus reasons: every condition that fails. An interval without any is eligible."""
    checked = intervals.withColumns({"both_sides": F.col("start").isNotNull() & F.col("end").isNotNull(), "no_reset": ~F.col("reset_inside")})
    return checked.withColumn("reasons", all_reasons(*[(F.col(c), reason) for c, reason in PASSIVE_CONDITIONS.items()])).drop("both_sides", "no_reset")


def passive_evidence(intervals: DataFrame, by: Sequence[str], usage: DataFrame, sessions: DataFrame, markers: DataFrame, anomalies: DataFrame, mismatches: DataFrame, permits: DataFrame, tiers: DataFrame, gaps: DataFrame) -> DataFrame:
    """passive_intervals plus the columns of PASSIVE_CONDITIONS and credits, out of the ledger.

    usage(by, ts, credits, estimated, unknown), markers(by, ts, rank) and
    mismatches(by, ts) count from an interval's start to its end, both included;
    sessions(by, a, b), of which it allows one, if they touch it, b null while
    running; anomalies(by, a, b) if they overlap its inside. permits(by,
    permitted) is the policy. Evidence of rank 4 and 5 is inferred or none.
    tiers(by, ts) are changes of plan or tier: one after an interval's start and
    up to its end puts its ends in different tiers. gaps(by, a, b) are times
    without sampling coverage: one that overlaps the inside leaves it uncovered.
    """
    at, to, one = F.col("start.ts"), F.col("end.ts"), F.lit(1)
    moment = lambda rows, **sums: rows.select(*by, F.col("ts").alias("a"), F.col("ts").alias("b"), *[c.cast("bigint").alias(n) for n, c in sums.items()])
    facts = moment(usage, credits=F.col("credits"), estimates=F.col("estimated"), unknowns=F.col("unknown"))
    for more in (moment(markers, inferred=F.col("rank") >= 4), moment(mismatches, mismatched=one), sessions.select(*by, "a", "b", one.cast("bigint").alias("running"))):
        facts = facts.unionByName(more, allowMissingColumns=True)
    found = sums_within(intervals, facts, by, facts.columns[len(by) + 2 :], at, to)
    # A change counts over the nanosecond before it: at an interval's end it is inside, at its start it isn't.
    changed = tiers.select(*by, (F.col("ts") - 1).alias("a"), F.col("ts").alias("b"), one.alias("retiered"))
    for more in (gaps.select(*by, "a", "b", one.alias("uncovered")), anomalies.select(*by, "a", "b", one.alias("anomalous"))):
        changed = changed.unionByName(more, allowMissingColumns=True)
    found = sums_within(found, changed, by, ["anomalous", "uncovered", "retiered"], at, to, closed=False)
    found = found.join(permits.select(*by, "permitted"), list(by), "left")
    none = {"attributed": "inferred", "exact_usage": "estimates", "known_components": "unknowns", "no_anomaly": "anomalous", "no_mismatch": "mismatched", "same_tier": "retiered", "covered": "uncovered"}
    held = {c: F.col(n) == 0 for c, n in none.items()} | {"alone": F.col("running") <= 1}
    return found.withColumns(held).drop(*none.values(), "running")


def passive_points(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """passive_reasons(credits) -> (by, x, y) for a fit: the first eligible interval's start at no credits, then each one's end at the credits so far."""
    w = Window.partitionBy(*by).orderBy("start.ts", "start.observation")
    eligible = intervals.where(F.size("reasons") == 0).withColumns({"x": F.sum("credits").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), "first": F.row_number().over(w) == 1})
    point = lambda x, at: F.struct(x.alias("x"), F.col(f"{at}.used_ppm").cast("double").alias("y"))
    end = point(F.col("x"), "end")
    return eligible.select(*by, F.explode(F.when(F.col("first"), F.array(point(F.lit(0.0), "start"), end)).otherwise(F.array(end))).alias("p")).select(*by, "p.x", "p.y")


def reset_partition(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows plus fate: accepted, duplicate (an instant again) or after_reset (from the first drop by more than the resolution on)."""
    w = Window.partitionBy(*by).orderBy("ts", "observation")
    once = rows.withColumn("again", F.coalesce(F.lag("ts").over(w) == F.col("ts"), F.lit(False)))
    of = Window.partitionBy(*by, "again").orderBy("ts", "observation")
    drop = ~F.col("again") & F.coalesce(F.lag("used_ppm").over(of) - F.col("used_ppm") > F.col("resolution"), F.lit(False))
    marked = once.withColumn("drop", drop.cast("int"))
    past = F.max("drop").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return marked.withColumn("fate", F.when(past, "after_reset").when(F.col("again"), "duplicate").otherwise("accepted")).drop("again", "drop")


def running_credits(observations: DataFrame, usage: DataFrame, by: Sequence[str]) -> DataFrame:
    """observations plus credits: the sum of usage at or before each."""
    o = observations.select(*by, "ts", F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("c"), F.struct(*observations.columns).alias("o"))
    u = usage.select(*by, "ts", F.lit(0).alias("side"), F.col("credits").alias("c"), F.lit(None).cast(o.schema["o"].dataType).alias("o"))
    w = Window.partitionBy(*by).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(u).withColumn("total", F.sum("c").over(w)).where("o is not null").select("o.*", F.col("total").alias("credits"))


def blocks(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, start, credits, delta): a meter series cut where usage falls; a block's delta is the rise of the reading until the next such place, the last until the final observation."""
    w = Window.partitionBy(*by).orderBy("ts")
    spent = F.col("credits") - F.coalesce(F.lag("credits").over(w), F.lit(0))
    marked = rows.withColumn("spent", spent).withColumn("final", F.last("used_ppm").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("before", F.lag("used_ppm").over(w))
    used = marked.where((F.col("spent") > 0) & F.col("before").isNotNull())
    return used.select(*by, F.col("ts").alias("start"), F.col("spent").alias("credits"), (F.coalesce(F.lead("before").over(w), F.col("final")) - F.col("before")).alias("delta"))


def _ordered(slopes: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the slopes; both zeros are one, NaN is last."""
    bits = np.where(np.isnan(slopes), np.nan, slopes + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _slopes(df: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slopes of a group's pairs as ordered numbers, and how often each occurs; a strip of rows at a time."""
    p, q = df["p"].iloc[0], df["q"].iloc[0]
    one, two = (df.loc[df["mine"] == k, ["x", "y", "w"]].to_numpy(float) for k in (p, q))
    for start in range(0, len(one), STRIP):
        a, b = one[start : start + STRIP], two[start:] if p == q else two
        dx = b[:, 0] - a[:, :1]
        far = ~(np.abs(dx) <= 1e-6)
        if p == q:
            far &= np.arange(len(b)) > np.arange(len(a))[:, None]
        yield _ordered((b[:, 1] - a[:, 1:2])[far] / dx[far]), (b[:, 2] * a[:, 2:])[far]


def _large_ranked(points: DataFrame, by: Sequence[str], places: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """ranked_slopes for series of any size: points(by, x, y, w, blocks), each once.

    A series is cut in blocks, and each pair of blocks is a group that counts
    its slopes by their next DIGIT bits among those that share the bits found
    so far. Four passes settle all bits; no slope leaves its group.
    """
    dealt = points.withColumn("mine", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*by, "x", "y", "w", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    keys = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)

    def counter(shift: int):
        def count(df: pd.DataFrame) -> pd.DataFrame:
            prefixes = df["prefixes"].iloc[0] if "prefixes" in df else [None]
            sums = np.zeros((len(prefixes), 1 << DIGIT), np.int64)
            for slopes, times in _slopes(df):
                for t, prefix in enumerate(prefixes):
                    chosen = slice(None) if prefix is None else slopes >> (shift + DIGIT) == prefix
                    digit = (slopes[chosen] >> shift) + (1 << DIGIT - 1) if prefix is None else slopes[chosen] >> shift & (1 << DIGIT) - 1
                    sums[t] += np.bincount(digit, times[chosen], 1 << DIGIT).astype(np.int64)
            t, digit = sums.nonzero()
            out = {**{k: [df[k].iloc[0]] * len(t) for k in by}, "t": t, "digit": digit - (1 << DIGIT - 1 if prefixes[0] is None else 0), "c": sums[t, digit]}
            return pd.DataFrame(out).astype({"t": "int32", "digit": "int64"})

        return count

    found = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        asked = dealt if found is None else dealt.join(found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "prefix")))["prefix"].alias("prefixes")), list(by))
        counted = asked.groupBy(*by, "p", "q").applyInPandas(counter(shift), f"{keys}, t int, digit bigint, c bigint").groupBy(*by, "t", "digit").agg(F.sum("c").alias("c"))
        run = counted.withColumn("before", F.sum("c").over(Window.partitionBy(*by, "t").orderBy("digit")) - F.col("c"))
        if found is None:
            total = F.sum("c").over(Window.partitionBy(*by))
            run = run.withColumn("total", total).select("*", F.posexplode(F.array(*[place(F.col("total")) for place in places])).alias("rank_of", "left"))
            run = run.select(*by, F.col("rank_of").alias("t"), F.lit(0).cast("bigint").alias("prefix"), "digit", "c", "before", "left")
        else:
            run = run.join(found, [*by, "t"])
        here = run.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("c")))
        found = here.select(*by, "t", (F.col("prefix") * (1 << DIGIT) + F.col("digit")).alias("prefix"), (F.col("left") - F.col("before")).alias("left"))

    def slope(ordered: pd.Series) -> pd.Series:
        bits = ordered.to_numpy(np.int64)
        return pd.Series((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(float))

    exact = found.withColumn("slope", F.pandas_udf(slope, "double")("prefix"))
    return exact.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "slope")))["slope"].alias("s"))


def ranked_slopes(points: DataFrame, by: Sequence[str], places: Sequence[Callable[[Column], Column]], few: int = 400) -> DataFrame:
    """(by, s): of the slopes of a series' pairs whose x differ by more than 1e-6, in order, those at the places (counted from 0, given the number of slopes).

    A series of up to `few` points gathers its slopes; a longer one counts
    them in groups of pairs. The results are the same.
    """
    known = points.where(" and ".join(f"`{c}` is not null" for c in (*by, "x", "y"))).select(*by, "x", "y")
    long = known.groupBy(*by).agg(F.count("*").alias("points")).where(F.col("points") > few)
    numbered = known.join(long, list(by), "left_anti").withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("x", "y")))
    a, b = numbered.alias("a"), numbered.alias("b")
    pairs = a.join(b, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in by], F.col("a.i") < F.col("b.i"), F.abs(F.col("b.x") - F.col("a.x")) > 1e-6])
    slopes = pairs.groupBy(*[F.col(f"a.{k}") for k in by]).agg(F.array_sort(F.collect_list((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x")))).alias("s"))
    total = F.size("s").cast("bigint")
    short = slopes.select(*by, F.array(*[F.element_at("s", (place(total) + 1).cast("int")) for place in places]).alias("s"))
    # Written once: every pass must see the same rows.
    once = staged(known.join(long, list(by)).groupBy(*by, "x", "y", "points").agg(F.count("*").alias("w")).select(*by, "x", "y", "w", F.ceil(F.col("points") / BLOCK).cast("int").alias("blocks")), "points")
    return short if once.isEmpty() else short.unionByName(_large_ranked(once, by, places))


def rejection(slope: Column) -> Column:
    """Why a line can't be a calibration: too few different x, or a meter that doesn't rise with use. Null: it can."""
    return F.when(slope.isNull(), "underidentified").when(slope <= 0, "non_positive_slope")


def theil_sen(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, slope, intercept, n, rejection) for each series: the median of slopes of pairs whose x differ by more than 1e-6, and the median remainder.

    A series without such a pair has neither, and one whose slope isn't positive
    keeps its line; rejection says which. Points without a key are no series.
    """
    middle = [lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2)]
    slopes = ranked_slopes(points, by, middle).select(*by, (F.col("s")[0] * 0.5 + F.col("s")[1] * 0.5).alias("slope"))
    named = points.where(" and ".join(f"`{c}` is not null" for c in by))
    rest = named.join(slopes, list(by), "left").groupBy(*by).agg(F.first("slope").alias("slope"), F.expr("percentile(y - slope * x, 0.5)").alias("intercept"), F.count("*").alias("n"))
    return rest.select(*by, "slope", "intercept", "n", rejection(F.col("slope")).alias("rejection"))


def scalar_fit(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, slope, residual, rejection) for each series: the line of median slope through readings taken at face value, and their mean distance from it."""
    off = F.abs(F.col("intercept") + F.col("slope") * F.col("x") - F.col("y"))
    return points.join(theil_sen(points, by), list(by)).groupBy(*by).agg(F.first("slope").alias("slope"), F.avg(off).alias("residual"), F.first("rejection").alias("rejection"))


def slope_spread(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, lo, hi): the pairwise slopes at the 16th (index rounded down) and 84th percentile (rounded up)."""
    ends = [lambda n: F.floor((n - 1) * 16 / 100), lambda n: F.ceil((n - 1) * 84 / 100)]
    return ranked_slopes(points, by, ends).select(*by, F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"))


def huber(points: DataFrame, by: Sequence[str], steps: int = 100) -> DataFrame:
    """(by, slope, intercept, loss, steps, rejection) for each series: a line that comes as near the admissible intervals (x, lo, hi, resolution) as Huber's loss allows.

    Starts from the line of median slope through the intervals' middles, which
    any number of points may have, and goes down the loss' gradient in equal
    steps that shrink with the points' spread. A series whose starting line is
    rejected isn't fitted: it has the reason, and that line's slope. The loop needs a series' points over and over: one Arrow group
    holds them as four columns.
    """
    start = theil_sen(points.select(*by, "x", ((F.col("lo") + F.col("hi")) / 2).alias("y")), by)

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["x", "lo", "hi"])  # sums come out alike in every run
        x, lo, hi = (df[c].to_numpy(float) for c in ("x", "lo", "hi"))
        delta = float(np.clip(df["resolution"].max() / 2, 100, 5000))
        slope, intercept = float(df["slope"].iloc[0]), float(df["intercept"].iloc[0])
        # Mean square of x about zero is its variance plus its mean's square.
        rate = min(max(1.0 / (1.0 + float((x * x).mean())), 1e-5), 0.5) / len(x)
        outside = lambda y: y - np.clip(y, lo, hi)
        # Added up one by one in the points' order: steep steps blow a last bit up, and NumPy's sums of eight strands end in another one.
        total = lambda v: float(np.cumsum(v)[-1])
        done = 0
        for done in range(1, steps + 1):
            pull = np.clip(outside(intercept + slope * x), -delta, delta)
            up, tilt = rate * total(pull), rate * total(pull * x)
            intercept, slope = intercept - up, slope - tilt
            if abs(up) < 1e-6 and abs(tilt) < 1e-7:
                break
        off = np.abs(outside(intercept + slope * x))
        loss = float(np.where(off <= delta, off * off / 2, delta * (off - delta / 2)).sum())
        return pd.DataFrame({**{k: [df[k].iloc[0]] for k in by}, "slope": [slope], "intercept": [intercept], "loss": [loss], "steps": [done]})

    keys = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in by)
    both = points.select(*by, "x", "lo", "hi", "resolution").join(start.where("rejection is null").select(*by, "slope", "intercept"), list(by))
    fitted = both.groupBy(*by).applyInPandas(fit, f"{keys}, slope double, intercept double, loss double, steps int").withColumn("rejection", F.lit(None).cast("string"))
    return fitted.unionByName(start.where("rejection is not null").select(*by, "slope", "rejection"), allowMissingColumns=True)


def gram(points: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """(by, n, yy, xy_i, xx_i_j, flat_i): the sums that a least-squares fit through the origin needs, and which columns hold one value, in one aggregate."""
    sums = [F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    sums += [F.sum(F.col(x) * F.col(y)).alias(f"xy_{i}") for i, x in enumerate(xs)]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    sums += [(F.min(x) == F.max(x)).alias(f"flat_{i}") for i, x in enumerate(xs)]
    return points.groupBy(*by).agg(*sums)


def least_squares(points: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, ridge: float = 0.0, most_condition: float = 1e6, least_rows: int = 2) -> DataFrame:
    """(by, kind, estimate, std_error, lo, hi, refusal) for each x: the fit through the origin over unit-norm columns, or why there is none.

    Rows in which no x is above zero carry no signal and are left out. Sums are
    distributed; only the small systems are solved in tasks. Refused are, in
    this order, fewer rows than least_rows, no more rows than columns, columns
    that hold one value throughout (an intercept by another name),
    ill-conditioned ones, and estimates below zero by more than two standard
    errors.
    """
    k = len(xs)

    def rows_of(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in df.to_dict("records"):
            g = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            v, n = np.array([r[f"xy_{i}"] for i in range(k)], float), int(r["n"])
            norm = np.sqrt(np.diag(g))
            refusal, est, err = None, np.full(k, np.nan), np.full(k, np.nan)
            if n < least_rows:
                refusal = "too_few_rows"
            elif n <= k:
                refusal = "underidentified"
            elif any(r[f"flat_{i}"] for i in range(k)):
                refusal = "constant_column"
            else:
                unit = g / np.outer(norm, norm) + ridge * np.eye(k)
                values = np.linalg.eigvalsh(unit)
                if values[0] <= 0 or values[-1] / values[0] > most_condition:
                    refusal = "ill_conditioned"
                else:
                    inverse = np.linalg.inv(unit)
                    est = inverse @ (v / norm) / norm
                    rss = max(0.0, float(r["yy"]) - 2 * est @ v + est @ g @ est)
                    err = np.sqrt(rss / (n - k) * np.diag(inverse)) / norm
                    if (est < -2 * err).any():
                        refusal = "negative_coefficient"
            for i, x in enumerate(xs):
                out.append([*[r[b] for b in by], x, est[i], err[i], est[i] - 1.96 * err[i], est[i] + 1.96 * err[i], refusal])
        return pd.DataFrame(out, columns=[*by, "kind", "estimate", "std_error", "lo", "hi", "refusal"])

    signal = F.lit(False)
    for x in xs:
        signal = signal | F.coalesce(F.col(x) > 0, F.lit(False))
    sums = gram(points.where(signal), by, xs, y)
    keys = ", ".join(f"{b} {points.schema[b].dataType.simpleString()}" for b in by)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield rows_of(df)

    return sums.mapInPandas(solve, f"{keys}, kind string, estimate double, std_error double, lo double, hi double, refusal string")


def admissible(used: Column, resolution: Column, quantization: Column) -> Column:
    """The readings that could lie behind a quantized one: exact; rounded down (resolution above); rounded to nearest (its floor half below, the rest above); unknown (resolution on both sides)."""
    half = floor_div(resolution, 2)
    lo = F.when(quantization == "exact", used).when(quantization == "floor", used).when(quantization == "nearest", used - half).otherwise(used - resolution)
    hi = F.when(quantization == "exact", used).when(quantization == "nearest", used + resolution - half).otherwise(used + resolution)
    return F.struct(F.greatest(lo, F.lit(0)).alias("lo"), F.least(hi, F.lit(1_000_000)).alias("hi"))


def distance(value: Column, lo: Column, hi: Column) -> Column:
    """How far a value lies outside an interval."""
    return F.when(value < lo, lo - value).when(value > hi, value - hi).otherwise(value * 0)


def held_out_residual(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows(by, predicted, lo, hi) -> (by, n, residual): the mean distance of predictions to their intervals."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(distance(F.col("predicted"), F.col("lo"), F.col("hi"))).alias("residual"))


def contamination(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, drift, sessions, foreign, unexplained): signs that others used the account during an experiment."""
    idle = F.col("credits") == 0
    return rows.groupBy(*by).agg(
        (F.max(F.when(idle, F.col("used_ppm"))) - F.min(F.when(idle, F.col("used_ppm")))).alias("drift"),
        F.count_distinct("session").alias("sessions"),
        F.count_if(~F.col("own")).alias("foreign"),
        F.count_if(idle & (F.col("delta") > F.col("resolution"))).alias("unexplained"),
    )


#: The signs of contamination in the order that they are told in (fixed values).
SIGNALS = ("pre_burn_idle_movement", "extended_settlement_drift", "flat_credits_with_meter_movement", "overlapping_session")


def experiment_contamination(experiments: DataFrame, readings: DataFrame, markers: DataFrame, width: int) -> DataFrame:
    """(experiment, signals, pre_ppm, post_ppm, meter_ppm, sessions): the signs that somebody else used the account during each experiment, in order, by thresholds recorded with it.

    experiments(experiment, account, session, plateau, started, ended, evaluated,
    meter_start, meter_end, credits, pre_most, post_most, grace, meter_least,
    credits_most); readings(account, ts, used_ppm); markers(session, account, ts).
    Work ends at `ended`, or is under way until `evaluated`. Quota that moves by
    more than pre_most from the plateau to the start, or by more than post_most
    after work's end and the grace until `evaluated`, is a sign; so is a meter
    that moves by meter_least or more while no more than credits_most were spent,
    and any other session marked against the account during work. Movements of
    fewer than two readings are null and no sign.

    Experiments are dealt to bins of `width`, so that a reading meets only those
    whose time is near its own.
    """
    e = experiments.withColumn("work_end", F.coalesce("ended", "evaluated"))
    bins = F.sequence(F.expr(f"plateau div {width}"), F.expr(f"greatest(plateau, evaluated, work_end) div {width}"))
    dealt = e.where("plateau is not null").select("experiment", "account", F.col("session").alias("own"), "plateau", "started", "work_end", "evaluated", "grace", F.explode(bins).alias("bin"))
    seen = readings.select("account", "ts", "used_ppm", F.lit(None).cast(markers.schema["session"].dataType).alias("other"))
    others = markers.where("session is not null").select("account", "ts", F.lit(None).cast("bigint").alias("used_ppm"), F.col("session").alias("other"))
    near = dealt.join(seen.union(others).withColumn("bin", F.expr(f"ts div {width}")), ["account", "bin"])
    pre = F.when(F.col("ts").between(F.col("plateau"), F.col("started")), F.col("used_ppm"))
    post = F.when((F.col("ts") > F.col("work_end") + F.col("grace")) & (F.col("ts") <= F.col("evaluated")), F.col("used_ppm"))
    moved = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c))
    marked = F.when(F.col("ts").between(F.col("started"), F.col("work_end")) & ~F.col("other").eqNullSafe(F.col("own")), F.col("other"))
    found = near.groupBy("experiment").agg(moved(pre).alias("pre_ppm"), moved(post).alias("post_ppm"), F.count_distinct(marked).alias("sessions"))
    all_ = e.join(found, "experiment", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0))).withColumn("meter_ppm", F.abs(F.col("meter_end") - F.col("meter_start")))
    tests = (F.col("pre_ppm") > F.col("pre_most"), F.col("post_ppm") > F.col("post_most"), (F.col("meter_ppm") >= F.col("meter_least")) & (F.col("credits") <= F.col("credits_most")), F.col("sessions") > 0)
    signals = F.array_compact(F.array(*[F.when(t, F.lit(s)) for s, t in zip(SIGNALS, tests, strict=True)]))
    return all_.select("experiment", signals.alias("signals"), "pre_ppm", "post_ppm", "meter_ppm", "sessions")


def health(applicable: Column, superseded: Column, provisional: Column, suspect: Column, review_due: Column) -> Column:
    """The first that holds, top down."""
    return F.when(~applicable, "inapplicable").when(superseded, "superseded").when(provisional, "provisional").when(suspect, "suspect").when(review_due, "review_due").otherwise("current")


def activation_refusal(overlap: Column, residual: Column, most_residual: float, samples: Column, least_samples: int, healthy: Column) -> Column:
    """The first reason not to activate a candidate, or null."""
    return F.when(overlap > 0, "training_in_validation").when(samples < least_samples, "too_few_samples").when(residual > most_residual, "residual_too_large").when(~healthy, "unhealthy")


def all_reasons(*checks: tuple[Column, str]) -> Column:
    """Every reason whose check fails, in order; never only the first."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for ok, r in checks]), lambda x: x.isNotNull())
