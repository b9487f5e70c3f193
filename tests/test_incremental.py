"""Byte ranges, publication, ledgers in increments, threads that stage."""

import io
import random
import threading

import pytest
from pyspark.sql import functions as F

from meterlake.sources import published, ranges, staging
from meterlake.streaming import ledger
from meterlake.streaming.ingest import summarize


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_ranges_own_their_lines():
    rng = random.Random(1)
    for _ in range(300):
        body = b"".join(bytes(rng.choice(b"ab\n\n") for _ in range(rng.randrange(12))) for _ in range(5))
        want, at = [], 0
        for line in body.split(b"\n")[:-1]:
            want.append((at, at + len(line) + 1, line))
            at += len(line) + 1
        cuts = sorted({0, len(body), *[rng.randrange(len(body) + 1) for _ in range(3)]})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in ranges.lines_between(io.BytesIO(body), a, b, len(body))]
        assert got == want, (body, cuts)


def test_only_appended_bytes_are_read(monkeypatch):
    body = b"".join(b"line %d\n" % i for i in range(400_000))
    source = Counted(body)
    start = body.rindex(b"\n", 0, len(body) - 5000) + 1
    assert len(list(ranges.lines_between(source, start, len(body), len(body)))) == body[start:].count(b"\n")
    assert source.taken <= len(body) - start + 1
    middle = Counted(body)
    list(ranges.lines_between(middle, 1_000_000, 1_000_100, len(body)))
    assert middle.taken <= 2 * ranges._READ


def state_of(root):
    return [(f"file://{p}", str(p.stat().st_ino), p.stat().st_size, int(p.stat().st_mtime_ns)) for p in sorted(root.glob("*.jsonl"))]


def test_resume_by_offsets(spark, tmp_path):
    schema, marked = "path string, identity string, size bigint, mtime bigint", "path string, identity string, size bigint, mtime bigint, parser_version int, offset bigint"
    marks = spark.createDataFrame([], marked)
    big, small, gone = tmp_path / "big.jsonl", tmp_path / "small.jsonl", tmp_path / "gone.jsonl"
    big.write_bytes(b"".join(b"number %d\n" % i for i in range(3000)))
    small.write_bytes(b"one\ntwo")
    gone.write_bytes(b"old one\nold two\n")

    def step(marks, version=1):
        files = spark.createDataFrame(state_of(tmp_path), schema)
        wanted = ranges.ranges(files, marks, version, width=1000)
        lines = ranges.read_ranges(wanted)
        got = sorted((r.file.rpartition("/")[2], r.at, r.text) for r in lines.collect())
        new = spark.createDataFrame(ranges.advanced(files, marks, wanted, lines, version).collect(), marked)
        return got, new, wanted

    got, marks, wanted = step(marks)
    assert len([g for g in got if g[0] == "big.jsonl"]) == 3000 and wanted.where("file like '%big%'").count() == -(-big.stat().st_size // 1000)
    assert [g for g in got if g[0] == "small.jsonl"] == [("small.jsonl", 0, "one")]
    assert step(marks)[0] == []
    with small.open("ab") as f:
        f.write(b" more\nthree\nfo")
    gone.unlink()
    gone.write_bytes(b"new\n")
    got, marks, _ = step(marks)
    assert got == [("gone.jsonl", 0, "new"), ("small.jsonl", 4, "two more"), ("small.jsonl", 13, "three")]
    assert step(marks)[0] == []
    got, marks, _ = step(marks, version=2)
    assert len(got) == 3000 + 1 + 3
    assert {r.path.rpartition("/")[2]: r.offset for r in marks.collect()}["small.jsonl"] == 19


def test_appended_lines_stream(spark, tmp_path):
    spark.dataSource.register(ranges.AppendedLines)
    root, seen = tmp_path / "in", []
    root.mkdir()

    def run():
        rows = []
        stream = spark.readStream.format("appended_lines").option("path", f"file://{root}").option("pattern", "*.jsonl").option("width", 50).load()
        query = stream.writeStream.foreachBatch(lambda df, n: rows.extend((r.file.rpartition("/")[2], r.at, r.text) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
        seen.append(sorted(rows))

    (root / "a.jsonl").write_bytes(b"".join(b"row %d\n" % i for i in range(40)) + b"cut")
    run()
    with (root / "a.jsonl").open("ab") as f:
        f.write(b" line\nlast\n")
    (root / "b.jsonl").write_bytes(b"other\n")
    run()
    assert len(seen[0]) == 40 and [s[2] for s in seen[1]] == ["cut line", "last", "other"]


def test_publication(spark, tmp_path):
    root = str(tmp_path / "projection")
    df = lambda *rows: spark.createDataFrame(list(rows), "account int, used int")
    with pytest.raises(published.Unavailable) as e:
        published.read(spark, root)
    assert e.value.reason == "missing"
    published.publish(df((1, 10), (2, 20)), root, 5)
    old, generation = published.read(spark, root)
    assert generation == 5
    # The next state is made of the published one, and the reader of the old one keeps it.
    published.publish(old.withColumn("used", F.col("used") + 1), root, 6)
    assert sorted(old.collect()) == [(1, 10), (2, 20)] and sorted(published.read(spark, root)[0].collect()) == [(1, 11), (2, 21)]
    with pytest.raises(published.Refused):
        published.publish(df((9, 9)), root, 5)
    # A writer that dies names nothing.
    bad = spark.range(4).select(F.col("id").cast("int").alias("account"), F.raise_error(F.lit("boom")).cast("int").alias("used"))
    with pytest.raises(Exception, match="boom"):
        published.publish(bad, root, 7)
    assert published.read(spark, root)[1] == 6
    for g in range(7, 12):
        published.publish(df((1, g)), root, g)
    assert len(list((tmp_path / "projection").glob("generation-*"))) <= 5 and published.read(spark, root)[0].first().used == 11
    for text, reason in (("{", "malformed"), ('{"generation": 1}', "malformed"), ('{"schema_version": 9}', "unsupported_schema"), (" " * (published.MOST_BYTES + 1), "too_large")):
        (tmp_path / "projection" / "CURRENT").write_text(text)
        (tmp_path / "projection" / ".CURRENT.crc").unlink(missing_ok=True)
        with pytest.raises(published.Unavailable) as e:
            published.read(spark, root)
        assert e.value.reason == reason


def test_counters(spark, tmp_path):
    root = str(tmp_path)
    assert published.counters(spark, root) == {"ingest": 0, "ledger": 0}
    assert [published.raise_counter(spark, root, n) for n in ("ingest", "ingest", "ledger")] == [1, 2, 1]
    assert published.counters(spark, root) == {"ingest": 2, "ledger": 1}


@pytest.fixture(scope="module")
def usage(spark):
    rng = random.Random(3)
    rows = [(f"m{rng.randrange(60)}", rng.randrange(100), rng.randrange(100), rng.randrange(9), rng.randrange(9), rng.randrange(1000)) for _ in range(600)]
    return spark.createDataFrame(rows, "native_id string, input long, output long, cache_read long, cache_write long, ts long").withColumn("n", F.monotonically_increasing_id()).cache()


def test_ledger_takes_any_split(spark, usage, tmp_path):
    key = lambda df: sorted(map(tuple, df.select("native_id", "input", "output", "cache_read", "cache_write", "first_ts", "last_ts").collect()))
    want = key(summarize(usage))
    held = ledger.Ledger(spark, str(tmp_path / "one"), buckets=3)
    assert held.read() is None
    for i in range(5):
        batch = usage.where(F.pmod(F.hash("n"), F.lit(5)) == i).drop("n")
        held.add(batch, "w", i)
        held.add(batch, "w", i)  # the same again
        held.compact(3)
    held.add(usage.where(F.pmod(F.hash("n"), F.lit(5)) == 0).drop("n"), "w", 0)  # merged long ago
    assert key(held.read()) == want
    assert held.compact(1) and key(held.read()) == want and len(list((tmp_path / "one").glob("base-*"))) == 1


def test_ledger_stream_survives_a_new_checkpoint(spark, usage, tmp_path):
    usage.drop("n").repartition(4).write.parquet(str(tmp_path / "in"))
    schema = usage.drop("n").schema
    for checkpoint in ("cp1", "cp1", "cp2"):
        query = ledger.ledger_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "ledger"), str(tmp_path / checkpoint), files_per_batch=1, behind=3)
        query.awaitTermination()
    got = ledger.Ledger(spark, str(tmp_path / "ledger")).read()
    assert sorted(map(tuple, got.select(*summarize(usage).columns).collect())) == sorted(map(tuple, summarize(usage).collect()))


def test_threads_stage_apart(spark):
    """One thread's end deletes nothing of another that still works."""
    first, second, failed = threading.Event(), threading.Event(), []

    def early():
        with staging.scratch(spark):
            staging.staged(spark.range(3), "early")
            first.set()
            second.wait(60)

    def late():
        try:
            first.wait(60)
            with staging.scratch(spark):
                held = staging.staged(spark.range(5), "late")
                second.set()
                one.join()
                assert held.count() == 5
        except Exception as e:
            failed.append(e)

    one, two = threading.Thread(target=early), threading.Thread(target=late)
    one.start(), two.start()
    one.join(), two.join()
    assert not failed
