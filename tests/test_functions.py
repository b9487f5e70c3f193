"""Scalar rules: rounding, clocks, globs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterlake.functions import clock, exact, globs, json_paths


def _round_away(n, d):
    q, r = divmod(abs(n), d)
    return (1 if n >= 0 else -1) * (q + (2 * r >= d))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**9), 10**9), st.integers(1, 10**4)), min_size=50, max_size=50))
def test_division_rules(spark, pairs):
    rows = spark.createDataFrame(pairs, "n bigint, d bigint")
    n, d = F.col("n"), F.col("d")
    for r in rows.select("n", "d", exact.round_div(n, d).alias("r"), exact.trunc_div(n, d).alias("t"), exact.floor_div(n, d).alias("f"), exact.ceil_div(n, d).alias("c")).collect():
        assert r.r == _round_away(r.n, r.d)
        assert r.t == int(abs(r.n) // r.d) * (1 if r.n >= 0 else -1)
        assert r.f == r.n // r.d and r.c == -(-r.n // r.d)


def test_clock(spark):
    texts = ["2024-02-29T23:59:60Z", "2024-01-01T00:00:00.123456789123+02:00", "1969-12-31T23:59:59.5Z", "2024-13-01T00:00:00Z", "2024-01-01", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clock.parse_rfc3339(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [1709251200 * 10**9, 1704060000 * 10**9 + 123456789, -500_000_000, None, None, None]
    back = spark.createDataFrame([(-500_000_000,), (1709251200 * 10**9 + 1,)], "n bigint").select(clock.format_rfc3339(F.col("n")).alias("t"), clock.utc_date(F.col("n")).cast("string").alias("d"), clock.iso_weekday(clock.utc_date(F.col("n"))).alias("w")).collect()
    assert [(r.t, r.d, r.w) for r in back] == [("1969-12-31T23:59:59.500000000Z", "1969-12-31", 3), ("2024-03-01T00:00:00.000000001Z", "2024-03-01", 5)]


def test_globs(spark):
    rows = spark.createDataFrame([("a_b",), ("axb",), ("ab%",), ("",)], "m string")
    got = [r.v for r in rows.select(globs.resolve(F.col("m"), (("a_*", "u"), ("a?b", "q"), ("*%", "p")), "none").alias("v")).collect()]
    assert got == ["u", "q", "p", "none"]
    assert globs.shadowed((("gpt-*", "a"), ("gpt-4*", "b"), ("o1", "c"))) == [("gpt-4*", "gpt-*")]


def test_compact_counts(spark):
    rows = spark.createDataFrame([(999,), (1234,), (1_299_999,), (2_000_000_000,)], "n bigint")
    assert [r.t for r in rows.select(exact.compact_count(F.col("n")).alias("t")).collect()] == ["999", "1.2k", "1.2M", "2.0B"]


def test_schedule_texts(spark):
    rows = spark.createDataFrame([("Mon", "09:00-17:30", "48h"), (" sun ", "17:00-09:00", "1.5h"), ("monday", "09:00-09:00", "60"), ("", "9:00-10:00", "99999999999999999999d"), (None, None, None)], "d string, h string, t string")
    got = rows.select(clock.day_number(F.col("d")).alias("d"), clock.hours_window(F.col("h")).alias("h"), clock.duration_seconds(F.col("t")).alias("t")).collect()
    assert [r.d for r in got] == [1, 7, None, None, None]
    assert [r.h and tuple(r.h) for r in got] == [(540, 1050), None, None, None, None]
    assert [r.t for r in got] == [172_800, None, None, None, None]


def test_field_paths(spark):
    rows = spark.createDataFrame([('[{"a": 1}, {"a": 1.0}]',), ("no json",), (None,), ("7",), ("[" * 5000,)], "t string")
    assert {tuple(r) for r in json_paths.field_paths(rows, "t").collect()} == {("[]", "object", 1), ("[].a", "float", 1)}


def test_layout_names(spark):
    from meterlake.functions import layout

    roots = {"aliases": {"/r/odd": "even"}, "worktrees": "/r/.trees/", "repositories": "/r", "ignore": ["tmp"]}
    want = {
        "/r/a": "a", "/r/a/b": "a", "/r//a/": "a", "/r/./a": "a", "/r/.trees/a/task": "a", "/r/.trees": layout.UNKNOWN_REPOSITORY, "/r": layout.UNKNOWN_REPOSITORY,
        "/r/.git": layout.UNKNOWN_REPOSITORY, "/r/tmp/x": layout.UNKNOWN_REPOSITORY, "/rest/a": layout.UNKNOWN_REPOSITORY, "/r/odd": "even", "/r/odd/x": "odd", "": layout.UNKNOWN_REPOSITORY, None: layout.UNKNOWN_REPOSITORY,
    }
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.n for r in rows.select("p", layout.repository(F.col("p"), **roots).alias("n")).collect()} == want
    names = {r.p: r.n for r in rows.select("p", layout.project(F.col("p"), {"/rest/a": "other"}, **roots).alias("n")).collect()}
    assert names == {p: "other" if p == "/rest/a" else layout.UNKNOWN_PROJECT if n == layout.UNKNOWN_REPOSITORY else n for p, n in want.items()}
    alone = {r.p: r.n for r in rows.select("p", layout.project(F.col("p"), {"/r/a": "x"}, {"/r/odd": "even"}).alias("n")).collect()}
    assert alone == {p: "x" if p == "/r/a" else layout.UNKNOWN_PROJECT for p in want}
