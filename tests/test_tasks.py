"""Reports of tasks: coverage, quality, credits and their reasons on small cases."""

from pyspark.sql import functions as F

from meterlake.operators import attribution, tasks

KINDS = ("input", "output")
USAGE = "task string, session string, evidence string, input long, output long"
ROWS = [("t1", "s1", "reported", 1, 2), ("t1", "s1", "guess", None, 3), ("t1", "s2", "reported", 5, 0), ("t2", "s3", "reported", 7, 0), ("t3", None, None, 1, 1), (None, "s1", "reported", 100, 100)]


def reports(spark, bad, scope=(), rates=None):
    schema = "session string, class string"
    states = tasks.session_usage(spark.createDataFrame(ROWS, USAGE), KINDS, spark.createDataFrame(bad, schema), scope)
    return {r.task: r for r in tasks.qualify(tasks.task_usage(states, KINDS), KINDS, rates).collect()}


def test_one_quarantined_record_makes_all_partial_and_none_leaves_all_complete(spark):
    got = reports(spark, [("s9", "wrong_field_type"), ("s8", None)])
    assert {(r.coverage, tuple(r.missing), tuple(r.quarantined)) for r in got.values()} == {("partial", KINDS, ("unknown", "wrong_field_type"))}
    assert {(r.coverage, tuple(r.missing)) for r in reports(spark, []).values()} == {("complete", ())}


def test_a_scope_touches_its_own_sessions_only(spark):
    got = reports(spark, [("s2", "b"), ("s1", "a"), ("s1", "a"), (None, "c")], ["session"])
    assert {t: (r.coverage, r.quarantined) for t, r in got.items()} == {"t1": ("partial", ["a", "b"]), "t2": ("complete", []), "t3": ("partial", ["c"])}


def test_sums_quality_and_methods(spark):
    got = reports(spark, [])
    assert {t: (r.sessions, r.events, r.input, r.output, r.quality, r.methods) for t, r in got.items()} == {"t1": (2, 3, 6, 5, "mixed", ["guess"]), "t2": (1, 1, 7, 0, "measured", []), "t3": (1, 1, 1, 1, "estimated", ["unknown"])}


def test_credits_or_why_there_are_none(spark):
    assert {(r.credits, tuple(r.refused)) for r in reports(spark, []).values()} == {(None, ("active cost model",))}
    assert {t: (r.credits, r.refused) for t, r in reports(spark, [], rates={"input": 2}).items()} == {"t1": (None, ["rate of output"]), "t2": (14, []), "t3": (None, ["rate of output"])}
    assert reports(spark, [], rates={"input": 2, "output": 10})["t1"].credits == 62


def test_claims_are_counted_and_nothing_is_reported_of_nothing(spark):
    empty = spark.createDataFrame([], USAGE)
    quarantine = spark.createDataFrame([("s1", "a")], "session string, class string")
    assert tasks.qualify(tasks.task_usage(tasks.session_usage(empty, KINDS, quarantine), KINDS), KINDS, {}).count() == 0
    states = tasks.session_usage(spark.createDataFrame(ROWS, USAGE), KINDS, quarantine)
    resolved = spark.createDataFrame([(x,) for x in ("resolved", "ambiguous", "unresolved", "ambiguous")], "state string")
    assert {(r.unresolved_claims, r.ambiguous_claims) for r in tasks.with_claims(states, resolved).collect()} == {(1, 2)}
    assert {(r.unresolved_claims, r.ambiguous_claims) for r in tasks.with_claims(states, resolved.limit(0)).collect()} == {(0, 0)}


def test_shares_of_a_task_report_need_no_job_of_their_own(spark):
    rows = spark.createDataFrame([("task-1", "a", 3), ("contended", "b", 1)], "bucket string, session string, tokens long")
    assert {r.bucket: (r.is_task, r.share_ppm) for r in attribution.task_report(rows).collect()} == {"task-1": (True, 750_000), "contended": (False, 250_000)}
    assert attribution.task_report(rows.where(F.lit(False))).count() == 0
