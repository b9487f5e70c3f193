"""Order-dependent rules, by hand-made rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import advice, attribution, calibration, canrun, coverage, dedup, reconcile, timeline


def test_identity_dedup_judges_against_the_row_kept_then(spark):
    rows = spark.createDataFrame([("m", 1, 5, 10, 0, 0), ("m", 2, 6, 30, 0, 0), ("m", 3, 6, 20, 0, 0), ("m", 4, 5, 1, 0, 0)], "native_id string, ts bigint, input bigint, output bigint, cache_read bigint, cache_write bigint")
    got = {r.ts: (r["class"], r.is_kept) for r in dedup.classify_identities(rows).collect()}
    assert got == {1: ("new", False), 2: ("collision", True), 3: ("replay", False), 4: ("collision", False)}


def test_identity_dedup_keeps_the_earliest_of_equals(spark):
    rows = spark.createDataFrame([("m", 1, 5, 10, 0, 0), ("m", 2, 5, 10, 0, 0)], "native_id string, ts bigint, input bigint, output bigint, cache_read bigint, cache_write bigint")
    (row,) = dedup.dedup_identities(rows).collect()
    assert (row.ts, row.replays, row.collisions) == (1, 1, 0)


def test_pair_quarantine_frees_the_key(spark):
    rows = spark.createDataFrame([("k", i, d) for i, d in enumerate("AABA")], "key string, ts int, digest string")
    (row,) = dedup.pair_quarantine(rows, "key", "digest", ["ts"]).collect()
    assert (row.kept, row.replays, row.quarantined) == (True, 1, 2)


def test_pair_quarantine_in_bins_is_the_plain_fold(spark):
    rng = random.Random(3)
    data = [(rng.choice("kl"), rng.randrange(40), i, rng.choice("ABC")) for i in range(300)]
    want = {}
    for key, _, _, d in sorted(data):
        held, replays, pairs, n = want.get(key, (None, 0, 0, 0))
        want[key] = (d, replays, pairs, n + 1) if held is None else (held, replays + 1, pairs, n + 1) if held == d else (None, replays, pairs + 2, n + 1)
    rows = spark.createDataFrame([*data, ("k", 1, 999, None)], "key string, ts long, n int, digest string")
    for width in (1, 7, 1000):
        got = {r.key: (r.kept, r.replays, r.quarantined) for r in dedup.pair_quarantine(rows, "key", "digest", ["ts", "n"], width).collect()}
        assert got == {k: (h is not None, r, q) for k, (h, r, q, _) in want.items()}
    assert dedup.pair_quarantine(rows.limit(0), "key", "digest", ["ts", "n"]).count() == 0


def test_rejected_totals_stay_predecessors(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate((10, 25, 5, 9))], "s int, ts int, x bigint")
    got = [r.delta_x for r in dedup.cumulative_deltas(rows, ["s"], ["ts"], ["x"]).orderBy("ts").collect()]
    assert got == [10, 15, None, 4]


def test_thinning_is_against_the_last_kept(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 4, 8, 12)], "a int, ts bigint")
    assert sorted(r.ts for r in timeline.thin_instants(rows, ["a"], "ts", 5).collect()) == [0, 8]


def test_touching_intervals_merge(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "a int, start bigint, end bigint")
    assert sorted((r.start, r.end) for r in timeline.merge_intervals(rows, ["a"]).collect()) == [(0, 7), (9, 10)]


def test_longest_gap_takes_the_last_of_equals(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 5, 10, 12)], "a int, ts bigint")
    (row,) = timeline.longest_gap(timeline.gaps(rows, ["a"], "ts", 0, 15), ["a"], "ts").collect()
    assert (row.gap, row.until) == (5, 10)
    got = {r.a: (r.gap, r.until) for r in timeline.longest_gap(timeline.gaps(rows, ["a"], "ts", -7, 30, spark.range(1, 3).toDF("a")), ["a"], "ts").collect()}
    assert got == {1: (18, 30), 2: (37, 30)}


def test_everything_from_the_first_drop_is_after_the_reset(spark):
    rows = spark.createDataFrame([(1, 1, 1, 100, 10), (1, 1, 2, 100, 10), (1, 2, 3, 150, 10), (1, 3, 4, 20, 10), (1, 4, 5, 160, 10)], "a int, ts bigint, observation bigint, used_ppm bigint, resolution bigint")
    got = {r.observation: r.fate for r in calibration.reset_partition(rows, ["a"]).collect()}
    assert got == {1: "accepted", 2: "duplicate", 3: "accepted", 4: "after_reset", 5: "after_reset"}


def test_asof_ties_and_edges(spark):
    events = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (1, 9, "c"), (2, 9, "d")], "k int, ts bigint, e string")
    facts = spark.createDataFrame([(1, 5, "x", None), (1, 5, "y", 1), (1, 8, "z", 2)], "k int, ts bigint, f string, o int")
    got = {r.e: r.f for r in timeline.asof(events, facts, ["k"], "ts", ["f"], ["o"]).collect()}
    assert got == {"a": None, "b": "y", "c": "z", "d": None}
    strict = {r.e: r.f for r in timeline.asof(events, facts, ["k"], "ts", ["f"], ["o"], inclusive=False).collect()}
    assert strict == {"a": None, "b": None, "c": "z", "d": None}


def test_settled_plateau(spark):
    minute = 60 * 10**9
    rows = spark.createDataFrame([(1, i * 6 * minute, 100, 10) for i in range(2)] + [(1, 12 * minute, 100, 10), (1, 18 * minute, 300, 10)], "a int, ts bigint, used_ppm bigint, resolution bigint")
    (row,) = calibration.settled(rows, ["a"]).collect()
    assert row.settled_at == 12 * minute


def test_least_squares_recovers_and_refuses(spark):
    good = [("g", float(i % 7 + 1), float(i % 5), 3.0 * (i % 7 + 1) + 2.0 * (i % 5)) for i in range(40)]
    bad = [("b", float(i + 1), 2.0 * (i + 1), 5.0 * (i + 1)) for i in range(40)]
    rows = spark.createDataFrame(good + bad, "arm string, p double, q double, y double")
    got = {(r.arm, r.kind): (r.estimate, r.refusal) for r in calibration.least_squares(rows, ["arm"], ["p", "q"], "y").collect()}
    assert abs(got["g", "p"][0] - 3) < 1e-6 and abs(got["g", "q"][0] - 2) < 1e-6 and got["g", "p"][1] is None
    assert got["b", "p"][1] == "ill_conditioned"
    flat = [("f", 3.0, float(i), 7.0 * i) for i in range(1, 9)] + [("f", 0.0, 0.0, 99.0)] * 3 + [("u", 1.0, 2.0, 3.0), ("u", 2.0, 1.0, 3.0)] + [("w", 1.0, 2.0, 3.0)]
    got = {r.arm: r.refusal for r in calibration.least_squares(spark.createDataFrame(flat, "arm string, p double, q double, y double"), ["arm"], ["p", "q"], "y").collect()}
    assert got == {"f": "constant_column", "u": "underidentified", "w": "too_few_rows"}


def test_huber_resists_an_outlier(spark):
    rows = [("a", float(x), 10.0 * x - 5, 10.0 * x + 5, 100.0) for x in range(1, 20)] + [("a", 10.0, 9000.0, 9010.0, 100.0)]
    (row,) = calibration.huber(spark.createDataFrame(rows, "k string, x double, lo double, hi double, resolution double"), ["k"]).collect()
    assert abs(row.slope - 10) < 1


def test_huber_takes_the_same_steps_as_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in "ab":
        for x in rng.uniform(0, 5, 30):
            y = 7 + 300 * x + rng.normal(0, 80) + (4000 if rng.random() < 0.1 else 0)
            rows.append((k, float(x), float(y - 20), float(y + 20), 400.0))
    got = {r.k: r for r in calibration.huber(spark.createDataFrame(rows, "k string, x double, lo double, hi double, resolution double"), ["k"]).collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        x, mid = np.array([r[1] for r in own]), np.array([(r[2] + r[3]) / 2 for r in own])
        slope = float(np.median(pair_slopes(x, mid)))
        intercept = float(np.median(mid - slope * x))
        mean = sum(x) / len(x)
        rate = min(max(1 / (1 + sum((v - mean) ** 2 for v in x) / len(x) + mean**2), 1e-5), 0.5) / len(x)
        for _ in range(100):
            pull = []
            for (_, v, lo, hi, _), _ in zip(own, x, strict=True):
                y = intercept + slope * v
                off = y - lo if y < lo else y - hi if y > hi else 0.0
                pull.append(off if abs(off) <= 200 else 200 * np.sign(off))
            a, b = rate * sum(pull), rate * sum(p * v for p, v in zip(pull, x, strict=True))
            intercept, slope = intercept - a, slope - b
            if abs(a) < 1e-6 and abs(b) < 1e-7:
                break
        assert got[k].slope == pytest.approx(slope, rel=1e-9) and got[k].intercept == pytest.approx(intercept, rel=1e-9)


def test_patterns_of_residuals(spark):
    runs = {"up": [1, 2, 3], "down": [-1, -2, -3, -4], "short": [5, 5], "alternating": [5, -5, 5, -5], "alternating_off": [9, -1, 9, -1], "step": [0, 0, 100, 100], "step_up": [1, 1, 100, 100], "none": [0, 1, 0, 1, 0], "zeros": [0, 0, 0, 0]}
    rows = [(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)]
    got = {r.k: r.patterns for r in reconcile.residual_patterns(spark.createDataFrame(rows, "k string, i int, residual bigint"), ["k"], "i").collect()}
    assert got == {"up": ["persistently_positive"], "down": ["persistently_negative"], "short": [], "alternating": ["alternating_net_zero"], "alternating_off": [], "step": ["step_change"], "step_up": ["persistently_positive", "step_change"], "none": [], "zeros": []}


MINUTE = 60 * 10**9


def _report(spark, minutes, policies=((0, 5),), attempts=(), resets=(), held=()):
    """The coverage of one account over so many minutes. policies: (at, cadence); attempts: (at, finished, observed); all in minutes."""
    table = lambda rows, schema: spark.createDataFrame([(1, *(int(x * MINUTE) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows], f"account int, {schema}")
    out = coverage.report(table(policies, "ts bigint, cadence bigint"), table(attempts, "ts bigint, finished boolean, observed boolean"), table(held, "start bigint, end bigint"), table([(r,) for r in resets], "ts bigint"), 0, minutes * MINUTE).collect()
    return out[0].asDict() if out else None


def test_coverage_scenarios(spark):
    tries = lambda n, seen=False, first=0: [(first + 5 * i, True, seen) for i in range(n)]
    r = _report(spark, 60)
    assert (r["expected"], r["attempted"], r["attempt_ppm"], r["measured_ppm"], r["no_attempt"]) == (12, 0, 0, None, 60 * MINUTE)
    r = _report(spark, 60, attempts=tries(12))
    assert (r["attempted"], r["observed"], r["attempt_ppm"], r["measured_ppm"]) == (12, 0, 1_000_000, 0)
    r = _report(spark, 60, attempts=[(5 * i, True, i % 2 == 1) for i in range(1, 7)])
    assert (r["attempt_ppm"], r["measured_ppm"]) == (500_000, 500_000)
    r = _report(spark, 120, attempts=tries(1, True))
    assert r["no_attempt"] == 120 * MINUTE
    r = _report(spark, 60, attempts=[(5, True, True), (10, False, False), (15, True, True)])
    assert (r["attempted"], r["unfinished"], r["observed"], r["measured_ppm"]) == (3, 1, 2, 1_000_000)
    r = _report(spark, 60, attempts=[(5, True, True)], resets=[33])
    assert r["severe"] == 1
    assert _report(spark, 60, attempts=tries(12) + [(27, True, False)], resets=[30])["severe"] == 0
    r = _report(spark, 60, attempts=tries(12) + [(27, True, False)])
    assert (r["expected"], r["attempted"], r["attempt_ppm"]) == (12, 13, 1_000_000)
    assert _report(spark, 60, policies=[(0, 5), (30, 15)])["expected"] == 8
    r = _report(spark, 60, policies=[(30, 5)], attempts=[(10, True, True), (40, True, True)])
    assert (r["expected"], r["attempted"], r["no_attempt"]) == (6, 2, 20 * MINUTE)
    r = _report(spark, 60, policies=[], attempts=tries(1))
    assert (r["expected"], r["attempt_ppm"], r["no_attempt"]) == (None, None, 60 * MINUTE)
    r = _report(spark, 60, held=[(0, 60)])
    assert (r["expected"], r["attempt_ppm"]) == (0, None)
    r = _report(spark, 60, attempts=[(20, True, True)], resets=[20, 20.05])
    assert r["severe"] == 2


def test_all_reasons_reports_every_failure(spark):
    (row,) = spark.range(1).select(calibration.all_reasons((F.lit(False), "x"), (F.lit(True), "y"), (F.lit(None).cast("boolean"), "z")).alias("r")).collect()
    assert row.r == ["x", "z"]


def pair_slopes(x, y):
    i, j = np.triu_indices(len(x), 1)
    far = np.abs(x[j] - x[i]) > 1e-6
    return np.sort((y[j] - y[i])[far] / (x[j] - x[i])[far])


@pytest.fixture(scope="module")
def long_series(spark):
    """Two series of more than 400 points, one of them cut in blocks, with ties and repeats; and a short one."""
    rng = np.random.default_rng(5)
    made = {"hot": (rng.integers(0, 900, 2600), rng.integers(-50, 50, 2600)), "long": (rng.integers(0, 10**6, 402), rng.integers(-(10**6), 10**6, 402)), "short": (np.arange(5), np.array([0, 3, 1, 9, 4]))}
    made = {k: (x.astype(float), 0.3 * x + y) for k, (x, y) in made.items()}
    rows = [(k, float(a), float(b)) for k, (x, y) in made.items() for a, b in zip(x, y, strict=True)]
    return made, spark.createDataFrame([*rows, (None, 1.0, 1.0), (None, 2.0, 2.0)], "k string, x double, y double").repartition(3)


def test_theil_sen_of_long_series(long_series):
    made, points = long_series
    got = {r.k: r for r in calibration.theil_sen(points, ["k"]).collect()}
    assert set(got) == set(made)
    for k, (x, y) in made.items():
        slope = np.median(pair_slopes(x, y))
        assert got[k].slope == slope and got[k].n == len(x)
        assert abs(got[k].intercept - np.median(y - slope * x)) < 1e-9


def test_scalar_fit_of_long_series(long_series):
    made, points = long_series
    got = {r.k: r for r in calibration.scalar_fit(points, ["k"]).collect()}
    assert set(got) == set(made)
    for k, (x, y) in made.items():
        slope = np.median(pair_slopes(x, y))
        assert abs(got[k].residual - np.abs(np.median(y - slope * x) + slope * x - y).mean()) < 1e-9


def test_slope_spread_of_long_series_gathers_no_array(long_series, monkeypatch):
    made, points = long_series
    few = []
    ranked = calibration._large_ranked
    monkeypatch.setattr(calibration, "_large_ranked", lambda rows, *a: few.extend(r.k for r in rows.select("k").distinct().collect()) or ranked(rows, *a))
    got = {r.k: r for r in calibration.slope_spread(points, ["k"]).collect()}
    assert set(got) == set(made) and sorted(few) == ["hot", "long"]
    for k, (x, y) in made.items():
        s = pair_slopes(x, y)
        last = len(s) - 1
        assert (got[k].lo, got[k].hi) == (s[last * 16 // 100], s[(last * 84 + 99) // 100])


MINUTE = 60 * 10**9


def readings(spark, series):
    """Readings ten minutes apart, of resolution 10; those of a series that are (used, reset) name a reset, in minutes."""
    rows = [(a, i * 10 * MINUTE, i, *((u[0], 10, u[1] * MINUTE) if isinstance(u, tuple) else (u, 10, None))) for a, us in series.items() for i, u in enumerate(us)]
    return spark.createDataFrame(rows, "a string, ts bigint, observation bigint, used_ppm bigint, resolution bigint, resets_at bigint")


def test_passive_intervals_lie_between_plateau_ends(spark):
    two = [100] * 4 + [150, 200, 200, 200, (200, 75), 50, 50, 50]
    rows = readings(spark, {"two": two, "one": [5, 5, 5, 90], "raw": [10, 40, 20], "single": [7]})
    got = sorted((r.a, r.start.observation, r.end.observation, r.settled, r.reset_inside) for r in calibration.passive_intervals(rows, ["a"]).collect())
    plateaus = [("two", 2, 3, True, False), ("two", 3, 7, True, False), ("two", 7, 8, True, True), ("two", 8, 11, True, True)]
    assert got == [("one", 0, 1, False, False), ("one", 1, 2, False, False), ("one", 2, 3, False, False), ("raw", 0, 1, False, False), ("raw", 1, 2, False, True), *plateaus]


def test_passive_conditions_and_points(spark):
    rows = readings(spark, {"s": [100] * 3 + [200] * 3 + [300] * 3 + [400] * 3, "raw": [1, 2]})
    found = calibration.passive_intervals(rows, ["a"])
    evidence = {c: F.lit(True) for c in calibration.PASSIVE_CONDITIONS if c not in ("both_sides", "no_reset", "settled")}
    judged = calibration.passive_reasons(found.withColumns({**evidence, "alone": F.col("end.observation") != 8, "same_tier": F.when(F.col("end.observation") != 8, True), "credits": F.lit(5)}))
    reasons = {(r.a, r.end.observation): r.reasons for r in judged.collect()}
    assert reasons == {("s", 5): [], ("s", 8): ["unchanged_plan_tier", "no_second_local_session_or_consumer"], ("s", 11): [], ("raw", 1): ["server_side_settlement_satisfied"]}
    points = calibration.passive_points(judged, ["a"])
    assert sorted((r.a, r.x, r.y) for r in points.collect()) == [("s", 0.0, 100.0), ("s", 5.0, 200.0), ("s", 10.0, 400.0)]
    assert [r.slope for r in calibration.theil_sen(points, ["a"]).collect()] == [30.0]


def test_asof_by_bins_is_asof(spark):
    rng = random.Random(5)
    events = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(100)) for i in range(200)], "id int, a string, ts long")
    facts = spark.createDataFrame([(rng.choice("ab"), rng.randrange(100), rng.choice([None, i]), i % 3) for i in range(30)], "a string, ts long, what int, tie int")
    facts = facts.dropDuplicates(["a", "ts", "tie"])
    for inclusive in (True, False):
        plain = timeline.asof(events, facts, ["a"], "ts", ["what"], ["tie"], inclusive).select("id", "what").collect()
        bins = timeline.asof_by_bins(events, facts, ["a"], "ts", ["what"], 7, ["tie"], inclusive).select("id", "what").collect()
        assert sorted(plain, key=str) == sorted(bins, key=str) and len(bins) == 200


def test_overlaid_timelines(spark):
    """Contention among a session's own claims stands; its gaps fall back, if there is anything to fall back on."""
    claims = spark.createDataFrame([("s", 10, "task-a", "claim"), ("s", 20, "task-a", "release"), ("s", 30, "task-b", "claim"), ("s", 30, "task-c", "claim"), (None, 5, "task-z", "claim"), (None, 32, "task-z", "release")], "session string, ts long, task string, kind string")
    usage = spark.createDataFrame([("s", t) for t in (2, 7, 15, 25, 35)] + [("u", 3), ("u", 6), ("u", 40), (None, 15)], "session string, ts long")
    both = {(r.session, r.ts): r.bucket for r in attribution.attribute_overlaid(usage, claims, width=8).collect()}
    none, over = "before_first_claim", "after_release_with_no_next_claim"
    assert both == {("s", 2): none, ("s", 7): "task-z", ("s", 15): "task-a", ("s", 25): "task-z", ("s", 35): "contended", ("u", 3): none, ("u", 6): "task-z", ("u", 40): over, (None, 15): "unmapped_session"}
    alone = {(r.session, r.ts): r.bucket for r in attribution.attribute_overlaid(usage, claims.where("session is not null")).collect()}
    assert alone[("s", 2)] == none and alone[("s", 25)] == over and alone[("u", 6)] == "unclaimed_session"


def test_sums_within_against_all_pairs(spark):
    rng = random.Random(9)
    facts = [(rng.choice("xy"), a, rng.choice([None, a, a + rng.randrange(9)]), rng.randrange(5)) for a in (rng.randrange(60) for _ in range(80))]
    spans = sorted({(rng.choice("xyz"), a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(60))})
    rows = spark.createDataFrame(spans, "k string, lo long, hi long")
    for closed in (True, False):
        got = {tuple(r)[:3]: r.n for r in timeline.sums_within(rows, spark.createDataFrame(facts, "k string, a long, b long, n long"), ["k"], ["n"], F.col("lo"), F.col("hi"), closed).collect()}
        over = (lambda a, b, lo, hi: a <= hi and (b is None or b >= lo)) if closed else (lambda a, b, lo, hi: a < hi and (b is None or b > lo))
        assert got == {(k, lo, hi): sum(n for kk, a, b, n in facts if kk == k and over(a, b, lo, hi)) for k, lo, hi in spans}


def test_nearest_ranks_against_sorting(spark):
    rng = random.Random(4)
    made = {"big": [rng.randrange(10**12) for _ in range(400)], "ties": [7] * 50 + [0] * 3, "one": [5], "small": [rng.randrange(3000) for _ in range(333)]}
    rows = spark.createDataFrame([(k, v) for k, vs in made.items() for v in [*vs, None]] + [("none", None)], "k string, v long")
    percents = {"least": 0, "low": 25, "mid": 50, "high": 90, "most": 100}
    got = {r.k: r for r in advice.nearest_ranks(rows, ["k"], "v", percents).collect()}
    assert set(got) == set(made)
    for k, vs in made.items():
        assert got[k].n == len(vs)
        assert {c: got[k][c] for c in percents} == {c: sorted(vs)[max(1, -(-p * len(vs) // 100)) - 1] for c, p in percents.items()}


def test_can_run_names_all_that_is_missing(spark):
    windows = spark.createDataFrame([("a", "five_hour", "account", None, 500_000, "current", 100, 200, None, None), ("a", "other", "model", "m2", 10, None, None, None, None, None), ("b", "five_hour", "account", None, 500_000, "suspect", 100, 200, 1, 1), ("c", "g", "group", "m1", 1, "current", 1, 1, None, None)], "account string, window string, scope string, named string, remaining_ppm long, health string, lo long, hi long, estimate_lo long, estimate_hi long")
    requests = spark.createDataFrame(
        [("ample", "a", "m1", "fresh", [], "p", "p", 12, 900_000, 10, 25, "sufficient"), ("thin", "a", "m1", "fresh", [], "p", "p", 1, 900_000, None, None, "insufficient"), ("many", "b", "m1", "fresh", ["input"], "p", "q", 1, 10, None, None, "insufficient"), ("stale", "a", "m2", "stale", [], "p", "p", 12, 900_000, 10, 25, "sufficient"), ("none", "c", "m1", "fresh", [], "p", "p", 12, 900_000, 10, 25, "sufficient"), ("gap", "a", "m2", "fresh", [], "p", "p", 12, 900_000, 10, 25, "sufficient")],
        "request string, account string, model string, meter string, unpriced array<string>, account_tier string, calibration_tier string, included long, coverage_ppm long, p50 long, upper long, state string",
    )
    got = {r.request: (r.verdict, r.missing, r.limiting) for r in canrun.can_run(requests, windows, 500_000).collect()}
    assert got == {
        "ample": ("AMPLE", [], "five_hour"),
        "thin": ("INSUFFICIENT_EVIDENCE", ["historical_task_evidence"], None),
        "many": ("UNKNOWN", ["five_hour", "cost_model", "plan_tier", "historical_task_evidence", "attribution_quality"], None),
        "stale": ("UNKNOWN", ["meter"], None),
        "none": ("UNKNOWN", ["constraining_windows"], None),
        "gap": ("UNKNOWN", ["other"], None),
    }


def test_huber_adds_up_in_the_points_order(spark):
    """The steps are so steep here that they blow up the last bit of a sum."""
    points = [(1951, -34900), (3711, 8760), (3988, 37100), (7813, -142340), (8117, 20940), (10465, -59460), (13931, -41120), (15198, 165060)]
    rows = [("a", float(x), float(d - 1250), float(d + 1250), 2500.0) for x, d in points]
    schema = "k string, x double, lo double, hi double, resolution double"
    got = calibration.huber(spark.createDataFrame(rows, schema), ["k"]).first()
    start = calibration.theil_sen(spark.createDataFrame([(k, x, (lo + hi) / 2) for k, x, lo, hi, _ in rows], "k string, x double, y double"), ["k"]).first()
    slope, intercept = start.slope, start.intercept
    rate = min(max(1 / (1 + sum(x * x for _, x, *_ in rows) / len(rows)), 1e-5), 0.5) / len(rows)
    for _ in range(100):
        up = tilt = 0.0
        for _, x, lo, hi, _ in rows:
            y = intercept + slope * x
            pull = min(max(y - min(max(y, lo), hi), -1250.0), 1250.0)
            up, tilt = up + pull, tilt + pull * x
        intercept, slope = intercept - rate * up, slope - rate * tilt
    assert (got.slope, got.intercept, got.steps) == (slope, intercept, 100)


def test_cards_of_one_key_are_compared_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from meterlake.operators import valuation

    cards = spark.range(60).selectExpr("id AS card", "'m' AS model", "'c' AS token_class", "DATE '2024-01-01' + CAST(id AS INT) AS start", "DATE '2024-01-05' + CAST(id AS INT) AS end", "CAST(IF(id % 2 = 0, 31, NULL) AS INT) AS days", "CAST(IF(id % 2 = 0, 0, NULL) AS INT) AS from_min", "CAST(IF(id % 2 = 0, 60, NULL) AS INT) AS to_min")
    rows = valuation.overlapping_cards(cards).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.card_a, r.card_b) for r in rows) == [(a, b) for a in range(60) for b in range(a + 1, 60) if b - a in (2, 4)]
    assert len({r.task for r in rows}) > 4


def test_ancestors_by_their_least_depth_with_many_parents_and_cycles(spark):
    import random

    from meterlake.operators import records

    rng = random.Random(5)
    edges = {(a, rng.randrange(40)) for a in range(40) for _ in range(rng.randrange(3))} | {(i, i + 1) for i in range(100, 117)} | {(117, 105)}
    want = {}
    for s in {a for a, _ in edges}:
        front, depth = {s}, 0
        while front := {b for a, b in edges if a in front and (s, b) not in want}:
            depth += 1
            want |= {(s, b): depth for b in front}
    got = records.ancestors(spark.createDataFrame(sorted(edges), "session long, parent long")).collect()
    assert {(r.session, r.ancestor): r.depth for r in got} == want and len(got) == len(want)


def test_coverage_does_not_stack_its_steps_in_one_task(spark):
    rows = lambda values, schema: spark.createDataFrame([("a", *v) for v in values], f"account string, {schema}")
    minutes = lambda *x: [(m * 60_000_000_000,) for m in x]
    out = coverage.report(rows([(0, 60_000_000_000)], "ts bigint, cadence bigint"), rows([(t, True, True) for (t,) in minutes(1, 2, 9)], "ts bigint, finished boolean, observed boolean"), rows([], "start bigint, end bigint"), rows(minutes(5), "ts bigint"), 0, 600_000_000_000)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    (r,) = out.collect()
    assert (r.expected, r.attempted, r.no_attempt, r.no_observation, r.severe) == (10, 3, 420_000_000_000, 420_000_000_000, 1)
