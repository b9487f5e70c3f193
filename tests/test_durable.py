"""Activations, retention, exports, archives, windows' bases and panels of checks, against plain code."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import activation, calibration, canrun, doctor, exports, imports, meter, retention
from meterlake.sources import databases

EVENTS = "scope string, event bigint, at bigint, model string, supersedes string"


def _plain_chain(rows):
    """{event: (accepted, active)}, event by event in (at, event)."""
    out = {}
    for scope in {r[0] for r in rows}:
        held = []  # (at, model) accepted so far
        for _, event, at, model, supersedes in sorted((r for r in rows if r[0] == scope), key=lambda r: (r[2], r[1])):
            before = [m for a, m in held if a < at]
            active, taken = (before[-1] if before else None), any(a == at for a, _ in held)
            ok = not taken and (active is None and supersedes is None or active is not None and supersedes == active and model != active)
            out[event] = (ok, active)
            if ok:
                held.append((at, model))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_activations_follow_the_chain(spark, seed):
    rng = random.Random(seed)
    models = ["a", "b", "c"]
    rows = [(rng.choice("xy"), i, rng.randrange(60), rng.choice(models), rng.choice([None, *models])) for i in range(200)]
    got = activation.activations(spark.createDataFrame(rows, EVENTS), ["scope"]).collect()
    assert {r.event: (r.accepted, r.active) for r in got} == _plain_chain(rows)
    assert all((r.reason is None) == r.accepted for r in got)
    assert {r.reason for r in got} >= {"another_is_active", "must_supersede_the_active", "supersedes_itself"}


def test_one_long_chain_and_incomplete_rows(spark):
    rows = [("s", i, i, f"m{i}", f"m{i - 1}" if i else None) for i in range(300)] + [(None, 1000, 5, "m", None), ("s", 1001, None, "m", "m3"), ("s", 1002, 7, None, "m3")]
    got = {r.event: r for r in activation.activations(spark.createDataFrame(rows, EVENTS), ["scope"]).collect()}
    assert all(got[i].accepted and got[i].until == (i + 1 if i < 299 else None) for i in range(300))
    assert {got[i].reason for i in (1000, 1001, 1002)} == {"incomplete"}
    assert activation.activations(spark.createDataFrame([], EVENTS), ["scope"]).count() == 0


def test_kept_classes_have_no_rule_that_drops():
    for bad in ({"group": "g"}, {"most": 1}, {"lease": 1}):
        for category in retention.KEPT:
            with pytest.raises(ValueError):
                retention.Rule(category, **bad)
    with pytest.raises(ValueError):
        retention.Rule("disposable", group="g")
    with pytest.raises(ValueError):
        retention.Rule("whatever")


def test_retained(spark):
    rules = {"built": retention.Rule("rebuildable", group="g"), "kept": retention.Rule("irreplaceable"), "ring": retention.Rule("disposable", most=2), "small": retention.Rule("disposable", most=1), "lease": retention.Rule("disposable", lease=10)}
    rows = [("built", 1, 1), ("kept", 1, 2), ("ring", 5, 3), ("ring", 5, 4), ("ring", None, 5), ("small", 1, 6), ("small", 2, 7), ("lease", 90, 8), ("lease", 91, 9), ("lease", None, 10), ("strange", 1, 11), (None, 1, 12)]
    df = spark.createDataFrame(rows, "kind string, at bigint, id bigint")
    ids = lambda rebuild: {r.id for r in retention.retained(df, "kind", "at", "id", rules, rebuild, 100).collect()}
    assert ids(["g"]) == {2, 3, 4, 7, 9, 10, 11, 12}
    assert ids([]) == {1, 2, 3, 4, 7, 9, 10, 11, 12}
    with pytest.raises(ValueError):
        ids(["nothing"])
    after = retention.retained(df, "kind", "at", "id", rules, ["g"], 100)
    got = {r.kind: (r.category, r.rows, r.kept) for r in retention.report(df, after, "kind", rules).collect()}
    assert got["built"] == ("rebuildable", 1, 0) and got["ring"] == ("disposable", 3, 2) and got[None] == ("untracked", 1, 1) and got["strange"] == ("untracked", 1, 1)


SESSIONS = "source string, native string, run string, project string, repository string, start bigint, end bigint"


def _export(spark, key, ids=True):
    sessions = spark.createDataFrame([("a", "1", "r", "p", "q", 5, None), ("b", "1", "r", "p2", "q", 3, 9), ("a", "2", "r", "p", "q", 4, 8), ("a", "3", None, "p", 'q"', 1, 2)], SESSIONS)
    usage = spark.createDataFrame([("1", 10, 1), ("2", 20, None), ("2", 2, None), ("3", 7, 7), ("9", 1, 1), (None, 1, 1)], "session string, input bigint, output bigint")
    return exports.usage_export(sessions, usage, ["input", "output"], key, ids)


def test_usage_goes_to_one_session_or_to_nobody(spark):
    rows, unresolved = _export(spark, "session")
    got = {r.key: (r.sessions, r.first_start, r.last_end, {u.kind: u.tokens for u in r.usage}) for r in rows.collect()}
    assert got == {"a:1": (1, 5, None, {}), "b:1": (1, 3, 9, {}), "a:2": (1, 4, 8, {"input": 22}), "a:3": (1, 1, 2, {"input": 7, "output": 7})}
    assert unresolved.first().unresolved_events == 4  # both kinds of the shared id and of the unknown one
    rows, _ = _export(spark, "run")
    (run,) = rows.collect()
    assert (run.key, run.sessions, run.first_start, run.last_end, run.project, run.repository) == ("r", 3, 3, 9, ["p", "p2"], ["q"])
    assert {u.kind: u.tokens for u in run.usage} == {"input": 22}
    with pytest.raises(ValueError):
        _export(spark, "account")


def test_lines_are_written_in_order(spark, tmp_path):
    rows, unresolved = _export(spark, "session", False)
    lines = exports.export_lines(rows, unresolved, "session", 2, 1, 99)
    exports.write_lines(lines, str(tmp_path / "out"))
    text = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    head, *body = map(json.loads, text)
    assert head == {"schema": 1, "key": "session-id", "ledger_generation": 2, "ingestion_generation": 1, "included_identifiers": [], "unresolved_events": {"value": 4, "unit": "events"}, "generated_at": 99}
    assert [b["key"] for b in body] == ["a:1", "a:2", "a:3", "b:1"]
    assert body[0]["usage"] == {} and body[0]["last_end"] is None and body[0]["project"] == []
    assert body[2]["usage"] == {"input": {"value": 7, "unit": "tokens"}, "output": {"value": 7, "unit": "tokens"}}


def _seed(at="2024-01-01T00:00:00Z", used=1, vendor="codex", **more):
    return json.dumps({"received_at": at, "reading": {"providers": [{"provider": vendor, "windows": [{"id": "w", "percentUsed": used}]}]}} | more)


def test_seed_records_refuse_whole_lines(spark):
    two = {"providers": [{"provider": "Anthropic", "windows": []}, {"provider": "x", "windows": [{"id": "w", "percentUsed": 101}]}]}
    texts = [_seed(), "{", json.dumps({"account": "x"}), _seed("noon"), json.dumps({"received_at": "2024-01-01T00:00:00Z"}), _seed(reading=None, account="Codex", failure="spawn_failed"), _seed(reading=None, account="c", failure="no"), _seed(reading=None, failure="spawn_failed"), _seed(reading=two), _seed(reading={"providers": []}), None, _seed(vendor="anthropic"), _seed(used=None)]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(texts)], "file string, line bigint, text string")
    got = {r.line: (r.vendor, r.failure, r.reason) for r in imports.seed_records(df).collect()}
    reasons = [None, "invalid_json", "missing_received_at", "invalid_received_at", "unrecognized_shape", None, "unknown_failure_class", "invalid_account", "invalid_percent_used", "no_provider_entries", "invalid_json", None, "invalid_percent_used"]
    assert [got[i][2] for i in range(len(texts))] == reasons
    assert got[0][:2] == ("codex", None) and got[5][:2] == ("codex", "spawn_failed") and got[11][0] == "claude"


def test_seed_import_twice_changes_nothing(spark):
    texts = [_seed(used=1), _seed(used=1), _seed(used=2), _seed("2024-01-02T00:00:00Z"), _seed("2024-01-03T00:00:00Z"), _seed(vendor="elsewhere"), _seed(reading=None, account="codex", failure="empty_output")]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(texts)], "file string, line bigint, text string")
    records = imports.seed_records(df)
    names = spark.createDataFrame([("codex", "c")], "vendor string, account string")
    day = 1_704_067_200_000_000_000
    native = spark.createDataFrame([("c", day + 2 * 86_400_000_000_000)], "account string, since bigint")
    stored = spark.createDataFrame([], f"account string, ts bigint, windows {imports.WINDOWS}")
    first = imports.seed_import(records, names, native, stored, {"codex": day + 1})
    assert [r.disposition for r in first.orderBy("line").collect()] == ["imported", "unchanged", "reinterpreted", "imported", "superseded_by_native", "discarded_unmapped_vendor", "unchanged"]
    assert [r.line for r in first.where("asserted").collect()] == [3]
    kept = first.where("disposition in ('imported', 'reinterpreted')").groupBy("account", "ts").agg(F.max_by("windows", "line").alias("windows"))
    again = imports.seed_import(records.where("line >= 2"), names, native, kept, {})
    assert {r.disposition for r in again.collect()} == {"unchanged", "superseded_by_native", "discarded_unmapped_vendor"}


def test_legacy_calibrations(spark):
    form = "f1"
    good = {"format": form, "calibration_id": "c", "provider": "p", "plan_tier": "t", "window": "w", "fitted_micros_per_point": 5, "fit_timestamp": "2024-01-01T00:00:00Z", "provenance": {"origin": "o"}, "experiment": {"experiment_id": "x", "evidence_ids": ["e", " "]}}
    texts = [json.dumps(good), json.dumps(good), json.dumps(good | {"plan_tier": "u"}), json.dumps(good | {"format": "f2"}), json.dumps(good | {"fitted_micros_per_point": 0}), json.dumps(good | {"experiment": None}), json.dumps(good | {"experiment": {"experiment_id": "x", "evidence_ids": [" "]}}), "", None, "[", json.dumps(good | {"provider": " "}), json.dumps(good | {"fitted_micros_per_point": 1.5})]
    df = spark.createDataFrame([(f"{i:02d}", x) for i, x in enumerate(texts)], "file string, text string")
    none = spark.createDataFrame([], "digest string")
    rows = imports.legacy_calibrations(df, none, form).orderBy("file").collect()
    assert [r.disposition for r in rows] == ["imported", "unchanged", "imported", "quarantined", "quarantined", "refused", "refused", "empty", "unchanged", "quarantined", "quarantined", "quarantined"]
    assert [r.file for r in rows if r.history] == ["00"] and not any(r.activatable for r in rows)
    assert (rows[0].micros_per_point, rows[0].evidence, rows[0].method) == (5, ["e"], "ordinary-least-squares")
    known = spark.createDataFrame([(r.digest,) for r in rows], "digest string")
    assert {r.disposition for r in imports.legacy_calibrations(df, known, form).collect()} == {"unchanged", "refused"}


def test_window_basis(spark):
    rows = [("a", "current", None, None, 1, 2, 9, 9), ("b", "suspect", "current", None, 1, 2, 9, 9), ("c", None, "current", None, 1, 2, 9, 9), ("d", None, "suspect", None, None, None, 9, 9), ("e", None, None, [], None, None, 9, 9), ("f", None, None, ["y", "x"], None, None, 9, 9), ("g", None, None, None, 1, 2, None, None)]
    df = spark.createDataFrame(rows, "w string, health string, kinds_health string, gaps array<string>, lo bigint, hi bigint, estimate_lo bigint, estimate_hi bigint")
    got = {r.w: (r.basis, r.reasons, r.lo) for r in canrun.window_basis(df).collect()}
    assert got == {
        "a": ("calibration", [], 1), "b": (None, ["calibration_suspect"], None), "c": (None, ["calibration_per_kind"], None), "d": (None, ["calibration_suspect"], None),
        "e": ("estimate", [], 9), "f": (None, ["x", "y"], None), "g": (None, ["no_calibration"], None),
    }


def test_panels(spark):
    df = spark.createDataFrame([(i, f"l{i:02d}", None if i == 9 else i % 2 == 0) for i in range(20)], "n bigint, label string, odd boolean")
    check = doctor.Finding
    checks = {"bad": check(F.col("odd"), F.col("label")), "soft": check(F.col("n") < 2, F.col("label"), severity="warn"), "none": check(F.lit(True), F.col("label"), F.col("n") > 99), "clean": check(F.col("n") > 99, F.col("label")), "same": check(F.lit(True), F.lit("one"))}
    got = {r.name: (r.status, r.found, r.about, r["sample"]) for r in doctor.panel(df, checks).collect()}
    assert got == {"bad": ("fail", 10, 20, [f"l{i:02d}" for i in range(0, 10, 2)]), "soft": ("warn", 2, 20, ["l00", "l01"]), "none": ("not_applicable", 0, 0, []), "clean": ("pass", 0, 20, []), "same": ("fail", 20, 20, ["one"])}
    assert {r.status for r in doctor.panel(df.limit(0), checks).collect()} == {"not_applicable"}


def test_reading_age(spark):
    rows = [("none", 100, None, "provider_observed"), ("late", 100, 10, "provider_observed"), ("skew", 100, 105, "locally_received"), ("ahead", 100, 106, "locally_received"), ("future", 201, None, "locally_received"), ("older", 201, 50, "older_of_the_two"), ("lead", 200, 203, "provider_observed")]
    df = spark.createDataFrame(rows, "name string, received bigint, provider bigint, basis string")
    age, anomaly = meter.reading_age(F.col("provider"), F.col("received"), F.col("basis"), 200, 5)
    got = {r.name: (r.age, r.anomaly) for r in df.select("name", age.alias("age"), anomaly.alias("anomaly")).collect()}
    assert got == {"none": (100, None), "late": (190, None), "skew": (100, None), "ahead": (None, "provider_ahead"), "future": (None, "future"), "older": (150, None), "lead": (None, "future")}


EXPERIMENT = "experiment bigint, account string, session string, plateau bigint, started bigint, ended bigint, evaluated bigint, meter_start bigint, meter_end bigint, credits bigint, pre_most bigint, post_most bigint, grace bigint, meter_least bigint, credits_most bigint"


def test_contamination_by_recorded_thresholds(spark):
    base = ("a", "own", 100, 200, 300, 900, 0, 0, 5, 10, 10, 50, 20, 0)
    change = lambda n, **kw: (n, *[kw.get(c.split()[0], v) for c, v in zip(EXPERIMENT.split(", ")[1:], base, strict=True)])
    rows = [change(1), change(2, pre_most=9), change(3, post_most=19), change(4, ended=None), change(5, meter_end=20), change(6, meter_end=20, credits=0), change(7, session="x"), change(8, account="b"), change(9, grace=600)]
    readings = [("a", 99, 500), ("a", 100, 0), ("a", 200, 10), ("a", 250, 900), ("a", 350, 700), ("a", 351, 10), ("a", 900, 30), ("a", 901, 800)]
    markers = [("x", "a", 200), ("own", "a", 250), ("x", "a", 300), ("y", "a", 301), ("y", "b", 199), (None, "a", 250)]
    got = calibration.experiment_contamination(spark.createDataFrame(rows, EXPERIMENT), spark.createDataFrame(readings, "account string, ts bigint, used_ppm bigint"), spark.createDataFrame(markers, "session string, account string, ts bigint"), 64)
    found = {r.experiment: (r.signals, r.pre_ppm, r.post_ppm, r.sessions) for r in got.collect()}
    drift, other, idle, flat = "extended_settlement_drift", "overlapping_session", "pre_burn_idle_movement", "flat_credits_with_meter_movement"
    assert found == {
        1: ([drift, other], 10, 20, 1), 2: ([idle, drift, other], 10, 20, 1), 3: ([drift, other], 10, 20, 1), 4: ([other], 10, None, 2), 5: ([drift, other], 10, 20, 1), 6: ([drift, flat, other], 10, 20, 1),
        7: ([drift, other], 10, 20, 1), 8: ([], None, None, 0), 9: ([other], 10, None, 1),
    }


def test_databases_are_packed_and_read(spark):
    rows = spark.createDataFrame([(i % 3, f"{i % 3}.db", f"m{i}", f"s{i % 3}", i, '{"role":"user"}', "/w") for i in range(9)], "g int, path string, message_id string, session_id string, time_created bigint, data string, directory string")
    files = databases.packed(rows, ["g"], "path").cache()
    got = {(r.file, r.line, r.message_id, r.time_created) for r in databases.sqlite_rows(files, databases.MESSAGES).collect()}
    assert got == {(f"{i % 3}.db", i // 3 + 1, f"m{i}", i) for i in range(9)}
    assert {tuple(r) for r in databases.sqlite_rows(files, databases.DIRECTORIES).select("file", "session_id").collect()} == {(f"{i}.db", f"s{i}") for i in range(3)}
