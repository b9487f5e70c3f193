"""Batches, overlapping pairs, prefixes, sets of windows, drift, Merkle proofs, rejected fits and qualified roll-ups on small cases."""

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from meterlake.operators import attribution, batches, calibration, dedup, meter, qualified
from meterlake.plans import QUERIES
from meterlake.sources import staging


def plain_batches(files, most_events, most_files):
    events = [f for f, n in sorted(files) for _ in range(n)]
    out, start, held = [], 0, []
    for i, f in enumerate(events):
        if i > start and (i - start >= most_events or f not in held and len(held) >= most_files):
            out.append((start, i - start, len(held), held[0], held[-1]))
            start, held = i, []
        if f not in held:
            held.append(f)
    return [*out, (start, len(events) - start, len(held), held[0], held[-1])] if events else []


@pytest.mark.parametrize(("most_events", "most_files", "block"), [(7, 3, 5), (4, 2, 1000), (1, 1, 3), (50, 4, 16), (9, 100, 8)])
def test_greedy_batches_as_the_plain_loop(spark, most_events, most_files, block):
    rng = random.Random(most_events)
    files = [(f"f{i:03d}", rng.choice([0, 1, 1, 2, 5, 30])) for i in range(25)]
    got = batches.greedy_batches(spark.createDataFrame(files, "file string, events int"), "file", most_events, most_files, block)
    rows = [tuple(r)[1:] for r in got.orderBy("batch").collect()]
    assert rows == plain_batches(files, most_events, most_files)
    assert [r.batch for r in got.orderBy("batch").collect()] == list(range(len(rows)))


def test_rounds_of_greedy_batches_do_not_grow_with_the_events(spark, monkeypatch):
    rounds = []
    staged = batches.staged
    monkeypatch.setattr(batches, "staged", lambda df, name: rounds.append(name) or staged(df, name))
    monkeypatch.setattr(batches, "BLOCKS", 4, raising=False)
    rng = random.Random(5)
    files = [(f"f{i:03d}", rng.choice([0, 1, 2, 5, 30])) for i in range(60)]
    got = batches.greedy_batches(spark.createDataFrame(files, "file string, events int"), "file", 7, 3, 2)
    assert [tuple(r)[1:] for r in got.orderBy("batch").collect()] == plain_batches(files, 7, 3)
    assert rounds.count("reached") <= 4  # blocks of two events take nine


def test_greedy_batches_of_nothing(spark):
    assert batches.greedy_batches(spark.createDataFrame([("a", 0)], "file string, events int"), "file", 5, 5).count() == 0


def test_overlapping_pairs_as_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        a = rng.randrange(500)
        rows.append((rng.choice("xy"), i, a, rng.choice([None, a, a + rng.randrange(9), a + rng.randrange(300), a - 1])))
    got = sorted(map(tuple, attribution.overlapping_pairs(spark.createDataFrame(rows, "k string, session int, a long, b long"), 7, ["k"]).collect()))
    good = [r for r in rows if r[3] is None or r[3] >= r[2]]
    want = []
    for (k, i, a, b), (k2, j, a2, b2) in itertools.permutations(good, 2):
        if k == k2 and (a, i) < (a2, j) and (b is None or b >= a2):
            want.append((k, i, j, "contains" if b is None or b2 is not None and b >= b2 else "runs_into"))
    assert got == sorted(want)


def test_pairs_need_no_cross_join(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 5, 9)], "session int, a long, b long")
    plan = attribution.overlapping_pairs(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_prefixes(spark):
    sessions = spark.createDataFrame([("a", "ABC-1", 5), ("b", "abc-2", 3), ("a", "abd_3", 1), ("a", "x%y", 9)], "source string, session string, start int")
    asked = spark.createDataFrame([("abc", None), ("abc", "a"), (" ABC-1 ", None), ("", None), (None, "a"), ("zz", None), ("abc", "c"), ("x%", None), ("ab_", None)], "prefix string, namespace string")
    got = sorted((tuple(r) for r in attribution.sessions_by_prefix(asked, sessions).collect()), key=repr)
    assert got == sorted(
        [
            ("abc", None, "ambiguous", 2, 1, "b", "abc-2", 3), ("abc", None, "ambiguous", 2, 2, "a", "ABC-1", 5), ("abc", "a", "one", 1, 1, "a", "ABC-1", 5), (" ABC-1 ", None, "one", 1, 1, "a", "ABC-1", 5),
            ("", None, "empty_prefix", 0, None, None, None, None), (None, "a", "empty_prefix", 0, None, None, None, None), ("zz", None, "none", 0, None, None, None, None), ("abc", "c", "none", 0, None, None, None, None),
            ("x%", None, "one", 1, 1, "a", "x%y", 9), ("ab_", None, "none", 0, None, None, None, None),
        ],
        key=repr,
    )


S = 1_000_000_000


def test_window_changes(spark):
    observations = spark.createDataFrame([("u", 1, 100 * S, "p", None), ("u", 2, 200 * S, "p", None), ("u", 3, 300 * S, "q", None), ("u", 4, 250 * S, "q", None), ("u", 5, 400 * S, "q", None)], "account string, observation int, at long, plan string, tier string")
    w = lambda o, key, scope, used, reset, at, name=None: ("u", o, key, scope, name, used, reset, at, 1000 * S, None)
    rows = [
        w(1, "five", "account", 50, "known", 500 * S), w(2, "five", "account", 40, "known", 500 * S), w(3, "five", "account", 10, "known", 500 * S), w(4, "five", "account", 5, "known", 500 * S), w(5, "five", "account", 6, "known", 900 * S),
        w(1, "m", "model", 1, "known", 500 * S, "x"), w(2, "week", "account", 1, "not_started", None), w(3, "week", "account", 1, "known", 1250 * S),
        w(4, "week", "account", 1, "not_started", None), w(5, "week", "account", 1, "known", 1350 * S), w(2, "g", "group", 1, "known", 1, "y"),
    ]
    windows = spark.createDataFrame(rows, "account string, observation int, key string, scope string, name string, used_ppm int, reset string, reset_at long, nominal long, precision long")
    got = sorted((r.observation, r.key, r.change) for r in meter.window_changes(observations, windows).collect())
    # 3 has another plan, 4 runs backwards; at 5 the reset moved before it was due, and the week began.
    assert got == [(2, "five", "percentage_decrease_without_reset"), (2, "m", "missing_model_specific_window"), (2, "week", "new_account_wide_window"), (5, "five", "unexpected_reset_timestamp_change")]
    assert "m" not in {r.key for r in meter.window_changes(observations, windows, subset=True).collect()}


def test_rejected_fits_have_a_reason(spark):
    points = spark.createDataFrame([("one", 1.0, 5.0), ("same", 2.0, 1.0), ("same", 2.0, 3.0), ("down", 0.0, 9.0), ("down", 1.0, 4.0), ("up", 0.0, 1.0), ("up", 1.0, 3.0)], "k string, x double, y double")
    got = {r.k: (r.slope, r.rejection) for r in calibration.theil_sen(points, ["k"]).collect()}
    assert got == {"one": (None, "underidentified"), "same": (None, "underidentified"), "down": (-5.0, "non_positive_slope"), "up": (2.0, None)}
    assert {r.k: r.rejection for r in calibration.scalar_fit(points, ["k"]).collect()} == {k: r for k, (_, r) in got.items()}
    wide = points.select("k", "x", (F.col("y") - 1).alias("lo"), (F.col("y") + 1).alias("hi"), F.lit(500.0).alias("resolution"))
    fits = {r.k: r for r in calibration.huber(wide, ["k"]).collect()}
    assert {k: r.rejection for k, r in fits.items()} == {k: r for k, (_, r) in got.items()}
    assert fits["down"].slope == -5.0 and fits["down"].loss is None and fits["up"].loss is not None


def test_unknown_maps_decide_collisions(spark):
    rows = spark.createDataFrame([("m", 1, 1, 5, {"a": 1, "b": 2}), ("m", 2, 1, 9, {"b": 2, "a": 1}), ("m", 3, 1, 9, {"a": 1})], "native_id string, ts int, input int, output int, unknown map<string,int>")
    (kept,) = dedup.dedup_identities(rows, same=("input", "unknown")).collect()
    assert (kept.ts, kept.replays, kept.collisions, kept.unknown) == (2, 1, 1, {"a": 1, "b": 2})
    assert {r.ts: (r["class"], r.is_kept) for r in dedup.classify_identities(rows, same=("input", "unknown")).collect()} == {1: ("new", False), 2: ("replay", True), 3: ("collision", False)}


def test_nodes_carry_what_qualifies_them(spark):
    events = [
        ("d1", "ann", 5, "reported", False, [], "s1"), ("d1", "ann", 7, "chars", False, ["output"], "s2"), ("d1", "unknown-account", 1, "reported", False, [], "s1"),
        ("d2", "ann", 2, "reported", True, None, "s1"), ("d2", "bob", 3, "ratio", None, [], "s3"),
    ]
    df = spark.createDataFrame(events, "day string, account string, output long, evidence string, heuristic boolean, missing array<string>, source string")
    got = {r.path: (r.depth, r.events, r.output, r.coverage, r.missing, r.quality, r.methods, r.sources) for r in qualified.qualified_rollup(df, ["day", "account"], ["output"]).collect()}
    assert got == {
        "": (0, 5, 18, "partial", ["output"], "estimated", ["chars", "ratio", "schedule-unresolved"], ["s1", "s2", "s3"]),
        "day=d1": (1, 3, 13, "partial", ["output"], "mixed", ["chars"], ["s1", "s2"]),
        "day=d2": (1, 2, 5, "complete", [], "estimated", ["ratio", "schedule-unresolved"], ["s1", "s3"]),
        "day=d1 / account=ann": (2, 2, 12, "partial", ["output"], "mixed", ["chars"], ["s1", "s2"]),
        "day=d1 / account=unknown-account": (2, 1, 1, "partial", ["account"], "measured", [], ["s1"]),
        "day=d2 / account=ann": (2, 1, 2, "complete", [], "estimated", ["schedule-unresolved"], ["s1"]),
        "day=d2 / account=bob": (2, 1, 3, "complete", [], "estimated", ["ratio"], ["s3"]),
    }
    many = spark.range(300).select(F.lit("d").alias("day"), F.lit("a").alias("account"), F.lit(1).cast("bigint").alias("output"), F.lit("reported").alias("evidence"), F.lit(False).alias("heuristic"), F.array().cast("array<string>").alias("missing"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    assert len(qualified.qualified_rollup(many, ["day", "account"], ["output"]).where("depth = 0").first().sources) == 300
    assert qualified.qualified_rollup(df.limit(0), ["day", "account"], ["output"]).count() == 0


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_nodes_of_one_sorted_pass_as_grouped_apart(spark, size):
    rng = random.Random(size)
    dims = ["a", "account", "c", "d"]
    rows = [(*(rng.choice(["x", "y", "unknown-account", None]) for _ in dims), rng.choice([None, rng.randrange(9)]), rng.choice(["reported", "chars", None]), rng.random() < 0.2, rng.choice([None, [], ["output"]]), rng.choice("pq")) for _ in range(90)]
    df = spark.createDataFrame(rows, ", ".join(f"{d} string" for d in dims) + ", n int, evidence string, heuristic boolean, missing array<string>, source string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        nodes = qualified.qualified_rollup(df, dims, ["n"])
        got = {(r.depth, *(r[d] for d in dims)): (r.path, r.events, r.n, r.coverage, r.missing, r.quality, r.methods, r.sources) for r in nodes.collect()}
        assert nodes.count() == len(got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for depth in range(len(dims) + 1):
        key = lambda r: (depth, *r[:depth], *[None] * (len(dims) - depth))  # noqa: B023, E731
        for k in {key(r) for r in rows}:
            mine = [r for r in rows if key(r) == k]
            missing = {x for r in mine for x in r[6 + 1] or []} | ({"account"} if k[2] == "unknown-account" else set())
            reported, guessed, known = sum(r[5] == "reported" for r in mine), any(r[6] for r in mine), [r[4] for r in mine if r[4] is not None]
            methods = {r[5] or "unknown" for r in mine if r[5] != "reported"} | ({"schedule-unresolved"} if guessed else set())
            path = " / ".join(f"{d}={v}" for d, v in zip(dims, k[1:], strict=True) if v is not None)
            quality = "estimated" if guessed or not reported else "measured" if reported == len(mine) else "mixed"
            want[k] = (path, len(mine), sum(known) if known else None, "partial" if missing else "complete", sorted(missing), quality, sorted(methods), sorted({r[8] for r in mine}))
    assert got == want
    # Depths share one pass: no exchange for each of them.
    plan = nodes.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange hashpartitioning") <= 3


def test_node_totals_beyond_a_long_are_an_error(spark):
    df = spark.range(4).select(F.lit("d").alias("day"), F.lit("a").alias("account"), F.when(F.col("id") < 2, F.lit(2**62)).otherwise(F.lit(-(2**62))).cast("bigint").alias("n"), F.when(F.col("id") < 2, "x").otherwise("y").alias("kind"), F.lit("reported").alias("evidence"), F.lit(False).alias("heuristic"), F.array().cast("array<string>").alias("missing"), F.lit("s").alias("source"))
    nodes = qualified.qualified_rollup(df, ["day", "account", "kind"], ["n"])
    with pytest.raises(Exception, match="Overflow|OVERFLOW|too large"):
        nodes.where("depth >= 2").collect()


def test_kept_messages_as_with_their_counts(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), rng.randrange(3), rng.randrange(4), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.randrange(2), rng.randrange(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, ts int, output int, input int, cache_read int, cache_write int").withColumn("id", F.concat_ws("-", "a", "b"))
    order = ["ts", "output", "input", "cache_read", "cache_write"]
    want = dedup.dedup_identities(df, "id", order).select(*df.columns)
    got = dedup.kept_identities(df, ["a", "b"], order).select(*df.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the sample tables")
def test_no_event_is_shuffled_on_the_way_to_its_nodes(spark):
    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    folder = Path(staging.shared_dir(spark))
    held, before, limit = set(folder.glob("*")), shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        nodes = QUERIES["AG-1_qualified_rollup"](spark, "/root/testdata/sf0.001").where("depth >= 2")
        events = nodes.where("depth = 2").agg(F.sum("events")).first()[0]
        assert nodes.count() > events
        assert shuffled() - before < events
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # What is staged on the way is gone, not only when the session ends.
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - held] == ["events"]
