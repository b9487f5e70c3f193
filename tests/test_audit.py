"""Drift of record shapes, trees of evidence and transcripts in parts, against plain code."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meterlake.functions import json_paths
from meterlake.operators import calibration, drift, evidence, meter, reconcile, segments


def test_shapes_hold_structure_only(spark):
    texts = ['{"type":"a","x":[1,{"y":2.5}]}', '{"x":[7,{"y":0.5}],"type":"b"}', '{"type":"event_msg","payload":{"type":"p"}}', '{"payload":{"type":"q"}}', "[18446744073709551616, 1]", "3", "{cut", " ", None]
    rows = spark.createDataFrame([("s", x) for x in texts], "source string, record string")
    got = {(r.kind, tuple(r.fields) if r.fields is not None else None): r.records for r in json_paths.record_shapes(rows, ["source"], "record").collect()}
    xs = ("type", "x", "x[]", "x[].y")
    assert got == {("a", xs): 1, ("b", xs): 1, ("p", ("payload", "payload.type", "type")): 1, ("q", ("payload", "payload.type")): 1, (None, ("[]",)): 1, (None, ()): 1, (None, None): 1}
    shapes = {r.shape for r in json_paths.record_shapes(rows, ["source"], "record").where("kind in ('a', 'b')").collect()}
    assert shapes == {hashlib.sha256(b"type:string\nx:array\nx[].y:float\nx[]:object\n").hexdigest()}


def test_drift_tells_new_from_missing(spark):
    shapes = lambda rows: json_paths.record_shapes(spark.createDataFrame(rows, "source string, record string"), ["source"], "record")
    live = shapes([("s", '{"type":"a","x":1}'), ("s", '{"type":"a","x":1}'), ("s", '{"type":"b"}'), ("calm", '{"type":"a"}'), ("s", "{")])
    corpus = shapes([("s", '{"type":"a","y":1}'), ("calm", '{"type":"a"}'), ("calm", '{"type":"gone"}'), ("unused", '{"k":1}')])
    found = drift.findings(live, corpus, "source")
    plain = {(r.source, r.what, r.name): (r.status, r.records) for r in found.where("what <> 'shape'").collect()}
    assert plain == {("s", "field", "type"): ("known", 3), ("s", "field", "x"): ("new", 2), ("s", "field", "y"): ("missing", 0), ("s", "kind", "a"): ("known", 2), ("s", "kind", "b"): ("new", 1), ("calm", "field", "type"): ("known", 1), ("calm", "kind", "a"): ("known", 1), ("calm", "kind", "gone"): ("missing", 0), ("unused", "field", "k"): ("missing", 0)}
    got = {r.source: r for r in drift.report(live, found, "source").collect()}
    assert (got["s"].records, got["s"].unreadable, got["s"].new_shapes, got["s"].drift) == (4, 1, 2, True)
    assert (got["calm"].missing, got["calm"].drift, got["unused"].records, got["unused"].drift) == (1, False, 0, False)
    refused = spark.createDataFrame([("calm", "bad", 2)], "source string, class string, n bigint")
    assert {r.source: r.drift for r in drift.report(live, found, "source", refused).collect()}["calm"]


def _members(spark, rows):
    return evidence.members(spark.createDataFrame(rows, "figure string, id string"), ["figure"], "id", 2)


def test_evidence_differences(spark):
    rng = random.Random(1)
    old = [(f, f"e{rng.randrange(5000)}") for f in ("x", "y") for _ in range(400)] + [(None, "n")]
    new = [r for r in old if r != ("x", old[0][1])] + [("x", "added"), ("z", "e1"), ("y", None)]
    a, b = _members(spark, old + old[:50]).cache(), _members(spark, new).cache()
    ta, tb = (evidence.tree(m, ["figure"], 2).cache() for m in (a, b))
    claims = ta.where("depth = 0").select("figure", "n", "digest")
    assert {r.figure: r.holds for r in evidence.verify(claims, tb, ["figure"]).collect()} == {"x": False, "y": True, "z": False, None: True}
    shards = evidence.differing(ta, tb, ["figure"], 2)
    want = {("x", hashlib.sha256(i.encode()).hexdigest()[:2]) for i in (old[0][1], "added")} | {("z", hashlib.sha256(b"e1").hexdigest()[:2])}
    assert {tuple(r) for r in shards.collect()} == want
    assert {tuple(r) for r in evidence.changed_members(a, b, shards, ["figure"]).collect()} == {("x", old[0][1], "removed"), ("x", "added", "added"), ("z", "e1", "added")}


def test_equal_shards_are_not_needed(spark):
    """With the members of all equal shards gone, the changed ones are named all the same."""
    old, new = [("x", f"e{i}") for i in range(300)], [("x", f"e{i}") for i in range(1, 300)]
    a, b = _members(spark, old), _members(spark, new)
    shards = evidence.differing(evidence.tree(a, ["figure"], 2), evidence.tree(b, ["figure"], 2), ["figure"], 2).cache()
    keep = lambda m: m.join(shards, ["figure", "shard"], "left_semi")
    assert [tuple(r) for r in evidence.changed_members(keep(a), keep(b), shards, ["figure"]).collect()] == [("x", "e0", "removed")]


def test_proofs_lead_to_the_root(spark):
    m = _members(spark, [("x", f"e{i}") for i in range(100)])
    nodes = evidence.tree(m, ["figure"], 2).cache()
    leaves = nodes.where("depth = 2").select("figure", F.col("prefix").alias("shard"), "digest")
    root = nodes.where("depth = 0").select("figure", F.col("digest").alias("root"))
    paths = evidence.proofs(nodes, leaves, ["figure"], 2).join(leaves, ["figure", "shard"]).join(root, "figure")
    check = lambda shard, digest: paths.select(evidence.proves(shard, digest, F.col("path"), F.col("root")).alias("ok"))
    assert {r.ok for r in check(F.col("shard"), F.col("digest")).collect()} == {True}
    assert {r.ok for r in check(F.col("shard"), F.sha2("digest", 256)).collect()} == {False}
    assert {r.ok for r in check(F.lit("zz"), F.col("digest")).collect()} == {False}


def test_arithmetic_labels():
    assert evidence.arithmetic("converted", "credits", "usd") == "converted from credits to usd"
    for bad in (("average",), ("converted", "credits")):
        with pytest.raises(ValueError):
            evidence.arithmetic(*bad)


@pytest.mark.parametrize(("part", "width"), [(1, 1), (7, 3), (64, 2), (100_000, 1000)])
def test_parts_in_order_give_the_whole(spark, part, width):
    rng = random.Random(part)
    turns = [("a", rng.choice([None, *range(12)]), "".join(rng.choice("xé😀\n ") for _ in range(rng.randrange(40))), i) for i in range(60)] + [("b", 0, None, 0), ("lost", 1, "no header", 0)]
    heads = {"a": "# a\n", "b": "# b\n", "c": "", "d": "only a header"}
    rows = spark.createDataFrame([t[:3] for t in turns], "conv string, turn bigint, line string")
    got = segments.parts(rows, spark.createDataFrame(list(heads.items()), "conv string, header string"), "conv", part, width).collect()
    for conv, head in heads.items():
        lines = sorted((t for t in turns if t[0] == conv and t[2] is not None), key=lambda t: (t[1] is not None, t[1] or 0, t[2].encode()))
        whole = head + "".join(t[2] for t in lines)
        mine = sorted((r for r in got if r.conv == conv), key=lambda r: r.part)
        assert "".join(r.text for r in mine) == whole
        assert all(len(r.text) == part for r in mine[:-1]) and [r.part for r in mine] == list(range(len(mine))) and {r.parts for r in mine} <= {len(mine)}
    assert not [r for r in got if r.conv == "lost"]


def test_messages_as_markdown(spark):
    rows = [
        ("user", " hi <system-reminder>x\ny</system-reminder>there　", None, None),
        ("assistant", "<skill>never closed", [("run", '{"a": 1}', "done"), ("look", None, "")], ["one\ntwo\n"]),
        ("assistant", "<skill>never closed", None, None),
        ("system", "secret", None, None),
        (None, "x", None, None),
    ]
    df = spark.createDataFrame(rows, "role string, text string, tools array<struct<name:string,input:string,result:string>>, thinking array<string>")
    line = lambda *more: [r[0] for r in df.select(segments.message_lines(F.col("role"), F.col("text"), *more)).collect()]
    assert line() == ["\n## User\nhi there\n", None, None, None, None]
    tools = '**Tool: run**\n```json\n{"a": 1}\n```\n**Tool result:**\ndone\n**Tool: look**\n```json\nnull\n```\n'
    assert line(F.col("tools"), F.col("thinking"))[1] == f"\n## Assistant\n{tools}> one\n> two\n"


MINUTE = 60_000_000_000


def _settle(spark, observations, started=0, covered=True, **criterion):
    rows = spark.createDataFrame([("a", m * MINUTE, ppm, r) for m, ppm, r in observations], "account string, ts bigint, used_ppm bigint, resolution bigint")
    series = spark.createDataFrame([("a", started * MINUTE, covered, 10_000)], "account string, started_at bigint, covered boolean, resolution bigint")
    (row,) = calibration.settlement(rows, series, ["account"], **criterion).collect()
    return row.reason or (row.settled_at // MINUTE, row.used_ppm)


@pytest.mark.parametrize(
    ("observations", "more", "want"),
    [
        ([(0, 5, 10_000), (5, 5, 10_000), (10, 5, 10_000)], {}, (10, 5)),
        ([(0, 0, 10_000), (5, 9_999, 10_000), (10, 0, 10_000)], {}, (10, 0)),  # less than one unit of the resolution
        ([(0, 0, 10_000), (5, 10_000, 10_000), (10, 0, 10_000)], {}, "no_plateau_within_window"),
        ([(0, 0, 10_000), (5, 10_000, 10_000), (10, 0, 10_000)], {"units": 1}, (10, 0)),
        ([(0, 5, 10_000), (5, 5, 10_000), (10, 5, 10_000)], {"covered": False}, "insufficient_meter_coverage"),
        ([(0, 5, 10_000), (5, 5, 10_000), (10, 5, 10_000)], {"covered": None}, "insufficient_meter_coverage"),
        ([(0, 5, 10_000), (5, 5, 10_000), (10, 5, 10_000), (15, 5, 10_000)], {"started": 5}, (15, 5)),  # what lies before the start doesn't count
        ([(0, 5, 10_000), (55, 5, 10_000), (61, 5, 10_000)], {}, "no_plateau_within_window"),  # beyond the deadline
        ([(0, 5, 10_000), (50, 5, 10_000), (60, 5, 10_000)], {}, (60, 5)),  # at it
        ([(0, 5, 5_000), (5, 5, 5_000), (10, 5, 5_000)], {}, "no_plateau_within_window"),  # another resolution
        ([(0, 5, 10_000), (4, 5, 10_000), (10, 5, 10_000)], {}, "no_plateau_within_window"),  # too close
        ([], {}, "no_plateau_within_window"),
    ],
)
def test_settlement_outcomes(spark, observations, more, want):
    assert _settle(spark, observations, **more) == want


def test_each_condition_fails_by_itself(spark):
    end = "struct<ts:bigint,used_ppm:bigint,account:string,window:string,resets_at:bigint>"
    good = ((10, 1, "a", "w", 99), (20, 2, "a", "w", 99), True, True, True)
    cases = {
        "fine": (good, None),
        "moved": (((10, 1, "b", "w", 99), *good[1:]), "same_account_and_window"),
        "other": ((good[0], (20, 2, "a", "v", 99), *good[2:]), "same_account_and_window"),
        "fell": ((good[0], (20, 0, "a", "w", 99), *good[2:]), "no_reset_inside"),
        "reset": ((good[0], (20, 2, "a", "w", 98), *good[2:]), "no_reset_inside"),
        "past": (((10, 1, "a", "w", 20), (20, 2, "a", "w", 20), *good[2:]), "no_reset_inside"),
        "thin": ((*good[:2], False, True, True), "acceptable_meter_coverage"),
        "unknown": ((*good[:2], None, True, True), "acceptable_meter_coverage"),
        "moving": ((*good[:2], True, False, True), "sufficient_settlement_and_lag_handling"),
        "lagging": ((*good[:2], True, True, False), "sufficient_settlement_and_lag_handling"),
    }
    rows = spark.createDataFrame([(k, "a", "w", *v[0]) for k, v in cases.items()], f"case string, account string, window string, start {end}, end {end}, acceptable boolean, settled boolean, lag_handled boolean")
    usage = lambda *u: spark.createDataFrame([("a", "w", *x) for x in u], "account string, window string, ts bigint, inexact boolean")
    resets = lambda *u: spark.createDataFrame([("a", "w", x) for x in u], "account string, window string, ts bigint")
    gaps = lambda *u: spark.createDataFrame([("a", "w", *x) for x in u], "account string, window string, a bigint, b bigint")
    health = lambda *u: spark.createDataFrame([("a", "w", x) for x in u], "account string, window string, health string")
    key = ["account", "window"]
    got = reconcile.eligibility(rows, key, usage((10, True), (15, False), (21, True)), resets(10, 21), gaps((5, 10), (20, 30)), health("current")).collect()
    assert {r.case: (r.failing, r.eligible) for r in got} == {k: ([v[1]] if v[1] else [], v[1] is None) for k, v in cases.items()}
    fine = rows.where("case = 'fine'")
    judge = lambda *facts: reconcile.eligibility(fine, key, *facts).collect()[0].failing
    assert judge(usage((20, True)), resets(), gaps(), health("current")) == ["exact_local_usage_where_required"]
    assert judge(usage((12, None)), resets(20), gaps((12, 13)), health("stale")) == ["no_reset_inside", "acceptable_meter_coverage", "applicable_current_calibration", "exact_local_usage_where_required"]
    assert judge(usage(), resets(), gaps(), health()) == ["applicable_current_calibration"]


def test_confidence_looks_at_the_limiting_window(spark):
    rows = [("early", 0, 50, 90, 100), ("early", 1, 40, 10, 100), ("old", 0, 50, 80, 100), ("tie", 1, 50, 10, 100), ("tie", 0, 50, 90, 100), ("none", 0, 50, None, 100), ("zero", 0, 50, 90, 0), ("skips", 0, 99, None, 100), ("skips", 1, 1, 95, 100), ("over", 0, 5, 300, 100)]
    df = spark.createDataFrame([r[:3] + (r[3], r[4]) for r in rows], "account string, idx int, used_ppm bigint, reset_at bigint, nominal bigint")
    got = dict(meter.confidence(df, 0).collect())
    assert got == {"early": "early", "old": "early", "tie": "early", "none": "established", "zero": "established", "skips": "early", "over": "early"}
    assert dict(meter.confidence(df.where("account = 'old'"), 1).collect()) == {"old": "established"}
