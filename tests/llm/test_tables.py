"""Mixing, archives, chats, fingerprints and embeddings against oracles and brute force."""

import hashlib
import json
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from meterlake.llm import toolcalls
from meterlake.llm.embeddings import cell_keys, decode, lattice, roots, similar_vectors
from meterlake.llm.fingerprints import BINS, fingerprint, fingerprint_report, likeness
from meterlake.llm.mixing import MIX_SQL, mix, mix_report, training_order
from meterlake.llm.toolcalls import CHAT_SQL, format_chat
from meterlake.llm.warc import ARCHIVE_SQL, archive_report, parse_record, read_archive, write_archive

from .conftest import DATA, ROWS, plain


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).df()


def same(got, want):
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def rows(pdf):
        clean = pdf[names].astype(object).where(pdf[names].notna(), None)
        return sorted(([round(float(x), 6) if isinstance(x, (int, float)) else x for x in r] for r in clean.itertuples(index=False)), key=repr)

    assert rows(got.toPandas()) == rows(want)


# Mixing


def test_mix_oracle(sample, edge, clashing):
    same(mix_report(sample), oracle(MIX_SQL, documents=sample))
    same(mix_report(edge), oracle(MIX_SQL, documents=edge))
    same(mix_report(clashing), oracle(MIX_SQL, documents=edge))


def test_mix_takes_what_it_should(sample, none):
    by = defaultdict(list)
    for r in mix(sample).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for rows in by.values() for r in rows)
    assert sum(rows[0]["target"] for rows in by.values()) == pytest.approx(total)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == pytest.approx(rows[0]["target"], abs=1)
    assert mix_report(none).count() == 0 and training_order(none).count() == 0


def test_training_order(edge, clashing):
    got = training_order(clashing)
    assert got.columns == clashing.columns
    assert plain(got.select(*edge.columns)) == plain(training_order(edge))
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in got.collect())


def test_curriculum(spark):
    """A source whose weight falls to nothing stands early, one whose weight rises stands late."""
    rows = [(i, " ".join(["w"] * 10), s) for s in ("a", "b") for i in range(s == "b", 2000, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = lambda rank: F.when(rank == 1, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    order = [r["source"] for r in training_order(df, weights).collect()]
    n = len(order)
    assert order[: n // 10].count("a") > 0.85 * (n // 10) and order[-n // 10 :].count("b") > 0.85 * (n // 10)
    assert order.count("a") == order.count("b") == 1000


def test_zero_weights(spark, sample):
    """Sources of weight zero are never taken; the others share all words, if any has weight."""
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a", "b", None] * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    only = lambda rank: F.when(rank == 2, F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    got = mix(df, only).collect()
    assert all((r["taken"] == 30) == (r["source"] == "b") and (r["taken"] == 0) == (r["source"] != "b") for r in got)
    assert {r["source"] for r in training_order(df, only).collect()} == {"b"}
    nothing = lambda rank: F.array(F.lit(0.0), F.lit(0.0))
    assert {r["taken"] for r in mix(df, nothing).collect()} == {0} and training_order(df, nothing).count() == 0


def test_positions_follow_the_schedule(sample):
    """What a source has given by a time is its integrated weight up to it."""
    at = {r["doc_id"]: r["position"] for r in mix_report(sample).collect()}
    rows = [r for r in mix(sample).collect() if r["taken"]]
    names = sorted({r["source"] for r in sample.select("source").collect()}, key=lambda s: (s is None, s))
    assert len({round(t, 2) for t in at.values() if t is not None}) > 20
    for r in rows:
        a, b = (1.5, 0.5) if names.index(r["source"]) % 2 == 0 else (0.5, 1.5)
        t = at[r["doc_id"]]
        assert a * t + (b - a) * t * t / 2 == pytest.approx(r["before"] / r["take"], abs=1e-5)


# WARC


PAGES = [
    (1, "http://a/", "x" * 100),
    (2, "http://b/\r\nq", "x" * 100),
    (2, "http://b/", "x" * 100),
    (3, None, "short"),
    (4, "http://c/", "short"),
    (5, "http://d/", None),
    (6, "http://e/", ""),
    (7, "http://f/", "é\r\n\r\n東" * 40),
    (8, "http://g/", "é\r\n\r\n東" * 40),
    (9, "http://h/", "y" * 99),
    (10, "http://i/", "y" * 99),
    (11, "http://j/", "long " * 400_000),
    (None, "http://k/", "x" * 100),
]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id bigint, url string, html string, digest string")
    same(archive_report(pages), oracle(ARCHIVE_SQL, pages=pages))
    write_archive(pages, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == len({p[2] or "" for p in PAGES})
    for r in read_archive(spark, f"{tmp_path}/a").collect():
        fields = parse_record(bytes(r["record"]))
        assert bytes(r["record"]).startswith(b"WARC/1.1\r\n") and fields["warc-type"] == r["record_type"]
        if r["record_type"] == "response":
            body = fields["block"].partition(b"\r\n\r\n")[2]
            assert hashlib.sha256(body).hexdigest() == r["payload_digest"] and body.decode() in {p[2] or "" for p in PAGES}
    nothing = pages.where("false")
    assert archive_report(nothing).count() == 0


def test_archive_ties(spark):
    """Of rows that tie for the smallest page_id one is the response, whatever their urls; short and nameless ones too."""
    long, short = "x" * 120, "y" * 99
    rows = [(1, "b", long)] * 3 + [(1, "a", long), (1, None, long), (2, "a", long), (None, "z", long)] + [(5, "a", short)] * 2 + [(6, "a", "z" * 100)] * 2 + [(None, "a", "w" * 100)] * 2 + [(7, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = archive_report(pages)
    same(got, oracle(ARCHIVE_SQL, pages=pages))
    facts = [(r["page_id"], r["record_type"], r["refers_to"]) for r in got.collect() if r["payload_bytes"] == 120]
    assert sorted(facts, key=repr) == sorted([(1, "response", None)] + [(1, "revisit", 1)] * 4 + [(2, "revisit", 1), (None, "revisit", 1)], key=repr)


def test_archive_spreads_runs(spark, monkeypatch):
    """Equal rows beyond one run are all there."""
    monkeypatch.setattr("meterlake.llm.warc.RUN", 3)
    pages = spark.createDataFrame([(1, "a", "x" * 120)] * 10 + [(2, "a", "s")] * 7, "page_id bigint, url string, html string")
    same(archive_report(pages), oracle(ARCHIVE_SQL, pages=pages))
    assert archive_report(pages).count() == 17


def test_archive_sample(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    same(archive_report(pages), oracle(ARCHIVE_SQL, pages=pages))


# Chats


def test_chat_oracle(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    same(format_chat(rows), oracle(CHAT_SQL, conversations=rows))


def test_explicit_calls(spark):
    call = lambda **k: f"<tool_call>{json.dumps(k)}</tool_call>"
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "assistant", call(id="b", name="add", arguments={"y": 2, "x": 1}, depends_on=["a", "gone"]) + call(id="a", name="add", arguments={"x": 1})),
        (1, 2, "tool", '<tool_result>{"id": "a", "content": {"z": 1, "b": 2}}</tool_result>'),
        (1, 3, "tool", '<tool_result>{"id": "a", "content": 5}</tool_result><tool_result>{"id": "q"}</tool_result>'),
        (1, 4, "assistant", call(id="c", name="add", arguments={"x": "one"}) + call(id="d", name="nope", arguments={}) + "<tool_call>not json</tool_call>"),
        (1, 5, "assistant", call(id="e", name="add", arguments={"x": 3}, depends_on=["f"]) + call(id="f", name="add", arguments={"x": 4}, depends_on=["e"])),
        (1, 6, "assistant", call(id="a", name="add", arguments={"x": 9})),
        (None, 0, "user", "hello"),
        (None, 1, "assistant", None),
        (2, 0, "user", None),
        (2, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn int, role string, text string, level string")
    schemas = {"add": {"x": ("integer", True), "y": ("integer", False)}, "reply": {"text": ("string", True)}}
    got = {(r["conv_id"], r["turn"], r["idx"]): r for r in format_chat(df, schemas).collect()}
    facts = {k: (r["kind"], r["level"], r["status"]) for k, r in got.items()}
    assert facts[1, 1, 0] == ("call", 1, "unanswered") and facts[1, 1, 1] == ("call", 0, "answered")
    assert facts[1, 2, 0] == ("result", 0, "linked") and facts[1, 3, 0] == ("result", 0, "late") and facts[1, 3, 1][2] == "orphan"
    assert [facts[1, 4, i][2] for i in range(3)] == ["invalid", "unanswered", "invalid"] and [got[1, 4, i]["known"] for i in range(3)] == [True, False, False]
    assert facts[1, 5, 0] == ("call", None, "cyclic") and facts[1, 6, 0][2] == "repeat"
    assert facts[None, 0, -1] == ("call", 0, "answered") and facts[None, 1, -1][2] == "linked"
    assert facts[2, 0, -1][2] == "invalid" and facts[2, None, -2] == ("message", None, "plain")
    assert got[1, 1, 0]["json"] == '{"arguments":{"x":1,"y":2},"id":"b","name":"add"}'
    assert got[1, 2, 0]["json"] == '{"content":{"b":2,"z":1},"id":"a"}'
    assert format_chat(df.where("false")).count() == 0


NUMBERS = {
    "100": "100", "1e2": "100", "100.0": "100", "1.00E+2": "100", "-0": "-0", "0.0": "0", "0e9": "0", "-12.50": "-12.5", "1e21": "1e+21", "12345678901234567890123456789012345678901234567890": "12345678901234567890123456789012345678901234567890",
    "0.000001": "0.000001", "1e-7": "1e-7", "123e-9": "1.23e-7", "0.1e1": "1", "1e400": "1e+400", "1e99999999999": "1e99999999999", "123456.789e3": "123456789", "1e20": "100000000000000000000",
}


def test_canonical_json(spark):
    """Numbers keep all digits and equal ones are written alike; keys are sorted at every depth; strings that look like numbers or marks stay."""
    rows = [(i, 0, "tool", f'<tool_result>{{"id": "a", "content": [{n}, {{"b": {n}, "a": "{n}"}}]}}</tool_result>') for i, n in enumerate(NUMBERS)]
    odd = ["\x01", "\x01\x01", "\x015", "a\x015", '"\x015', '\\"\x015"', "é\n\u2028", '{"a":1}', "-", "x" * 100_000, "\\n" * 50_000]
    rows += [(100 + i, 0, "tool", f"<tool_result>{json.dumps({'id': 'a', 'content': {t[:99]: [t, 1.0], '': {'z': 1, 'b': [True, None]}}})}</tool_result>") for i, t in enumerate(odd)]
    got = {r["conv_id"]: r["json"] for r in format_chat(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).where("kind = 'result'").collect()}
    for i, (n, want) in enumerate(NUMBERS.items()):
        want = "0" if n == "-0" else want
        assert got[i] == f'{{"content":[{want},{{"a":"{n}","b":{want}}}],"id":"a"}}'
    for i, t in enumerate(odd):
        assert json.loads(got[100 + i]) == {"content": {t[:99]: [t, 1], "": {"z": 1, "b": [True, None]}}, "id": "a"}
        assert '"":{"b":[true,null],"z":1}' in got[100 + i]


def brute_chat(rows, schemas):
    """(conv, turn, idx) to (kind, level, status) of explicit calls and results, one at a time."""
    calls, results = [], []
    for conv, turn, role, text in rows:
        if role == "assistant":
            calls += [(conv, turn, i, json.loads(x)) for i, x in enumerate(re.findall("(?s)<tool_call>(.*?)</tool_call>", text))]
        results += [(conv, turn, i, json.loads(x)) for i, x in enumerate(re.findall("(?s)<tool_result>(.*?)</tool_result>", text))]
    first, deps = {}, defaultdict(set)
    for conv, turn, i, c in calls:
        first[conv, c["id"]] = min(first.get((conv, c["id"]), (turn, i)), (turn, i))
        deps[conv, c["id"]] |= set(c.get("depends_on", []))
    level = {}
    for _ in range(len(first) + 1):
        for key in first:
            own = [(key[0], d) for d in deps[key] if (key[0], d) in first]
            if all(d in level for d in own):
                level[key] = 1 + max((level[d] for d in own), default=-1)
    answer = {}
    for conv, turn, i, r in results:
        key = conv, r["id"]
        if key in first and turn >= first[key][0]:
            answer[key] = min(answer.get(key, (turn, i)), (turn, i))
    out = {}
    for conv, turn, i, c in calls:
        key, args = (conv, c["id"]), c["arguments"]
        bad = c["name"] in schemas and (not isinstance(args.get("x"), int))
        status = "invalid" if bad else "repeat" if (turn, i) != first[key] else "cyclic" if key not in level else "answered" if key in answer else "unanswered"
        out[conv, turn, i, "call"] = (level.get(key), status)
    for conv, turn, i, r in results:
        key = conv, r["id"]
        status = "orphan" if key not in first else "early" if turn < first[key][0] else "linked" if answer[key] == (turn, i) else "late"
        out[conv, turn, i, "result"] = (level.get(key), status)
    return out


def test_explicit_calls_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(12):
        for turn in range(14):
            if rng.random() < 0.5:
                made = [{"id": f"c{rng.randrange(12)}", "name": rng.choice(("add", "other")), "arguments": rng.choice(({"x": 1}, {"x": "1"}, {})), "depends_on": [f"c{rng.randrange(14)}" for _ in range(rng.randrange(3))]} for _ in range(rng.randrange(1, 4))]
                rows.append((conv, turn, "assistant", " ".join(f"<tool_call>{json.dumps(c)}</tool_call>" for c in made)))
            else:
                rows.append((conv, turn, "tool", "".join(f'<tool_result>{{"id": "c{rng.randrange(14)}", "content": {rng.randrange(9)}}}</tool_result>' for _ in range(rng.randrange(1, 4)))))
    # A chain of calls, each on the one before.
    rows += [(99, t, "assistant", f'<tool_call>{{"id": "k{t}", "name": "add", "arguments": {{"x": 1}}, "depends_on": ["k{t - 1}"]}}</tool_call>') for t in range(6)]
    schemas = {"add": {"x": ("integer", True)}}
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"], r["idx"], r["kind"]): (r["level"], r["status"]) for r in format_chat(df, schemas).where("kind <> 'message'").collect()}
    assert got == brute_chat(rows, schemas)
    assert plain(format_chat(df.union(df.where("turn = 3")), schemas).where("turn = 3")) == sorted(plain(format_chat(df, schemas).where("turn = 3")) * 2, key=repr)


# Fingerprints


def brute_edits(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (d, t), (_, follows) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - third] + follows[:third]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edits(sample, edge, none, clashing):
    facts = ("doc_id", "n_chars", "edited_sha256")
    assert plain(fingerprint_report(sample).select(*facts)) == brute_edits([(r["doc_id"], r["text"]) for r in sample.collect()])
    assert plain(fingerprint_report(edge).select(*facts)) == plain(fingerprint_report(clashing).select(*facts)) == brute_edits([r[:2] for r in ROWS])
    assert fingerprint_report(none).count() == 0
    for r in fingerprint_report(sample).collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) in (0, BINS)


def plain_fingerprint(text):
    """One permutation, one bin after the other. xxhash's seed 42 and chaining are those of Spark's function."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return ""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for x in hashes[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        signed = h - (1 << 64) if h >> 63 else h
        least[h >> 57] = min(least.get(h >> 57, signed), signed)
    out = ""
    for i in range(BINS):
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)
        order = [i] + [((t ^ h & 127) * (h >> 7 & 127 | 1) + (h >> 14 & 127)) % BINS for t in range(BINS)]
        assert sorted(order[1:]) == list(range(BINS))
        out += f"{least[next(j for j in order if j in least)] & 15:x}"
    return out


def test_fingerprints_against_plain_code(spark, sample, edge):
    for df in (sample, edge):
        rows = df.select("text", fingerprint(F.coalesce("text", F.lit(""))).alias("fp")).collect()
        assert all(r["fp"] == plain_fingerprint(r["text"]) for r in rows)
    got = fingerprint_report(sample).collect()
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    ids = sorted(texts, reverse=True)
    follows = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for r in got:
        a, b = plain_fingerprint(texts[r["doc_id"]]), plain_fingerprint(texts[follows[r["doc_id"]]])
        same = sum(x == y for x, y in zip(a, b, strict=False)) / BINS
        want = 1.0 if a == b else 0.0 if "" in (a, b) else max(0.0, (same - 1 / 16) / (15 / 16))
        assert r["near_next"] == pytest.approx(want)


def test_likeness(spark):
    """Estimates lie near the exact similarity and average out to it."""
    rng = random.Random(3)
    rows, exact = [], []
    for k in range(200):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 40, 400)))]
        other = [w if rng.random() > k / 1000 else "z" + w for w in words]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other))
        rows.append((k, " ".join(words), " ".join(other)))
        exact.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = [r[0] for r in df.select("k", likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("v")).orderBy("k").select("v").collect()]
    error = np.array(got) - np.array(exact)
    assert abs(error.mean()) < 0.03 and np.sqrt((error**2).mean()) < 0.12


def test_equal_and_disjoint_texts(spark):
    df = spark.createDataFrame([("One two three four five six", "one two  three four five SIX"), ("a b c", "d e f"), ("", " "), ("", "x")], "a string, b string")
    got = [tuple(r) for r in df.select(fingerprint(F.col("a")), fingerprint(F.col("b")), likeness(fingerprint(F.col("a")), fingerprint(F.col("b")))).collect()]
    assert got[0][0] == got[0][1] and got[0][2] == 1.0 and got[1][2] < 0.2 and got[2] == ("", "", 1.0) and got[3][2] == 0.0


# Embeddings


def brute_vectors(rows):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for dim in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= 0.9):
            if a != b:
                links[own[a]].add(own[b])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, more in links.items():
        for b in more:
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(links[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_vectors_recall(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute_vectors([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in similar_vectors(df).collect()}
    assert set(got) == set(want) and all(got[d][0] <= want[d][0] for d in want)
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _ in got.values()) >= 0.9 * links
    assert sum(got[d][1] == want[d][1] for d in want) >= 0.95 * len(want)


def planted(n, seed, least=0.9, most=0.95):
    """n random vectors of 64 dimensions, and for each a partner at a cosine between least and most."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((n, 64))
    r -= (r * a).sum(axis=1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    cos = rng.uniform(least, most, (n, 1))
    return np.concatenate((a, cos * a + np.sqrt(1 - cos**2) * r))


def test_planted_vectors(spark):
    """Pairs at 0.90 to 0.95, the hardest to find, and a cluster over several blocks' worth of links."""
    rng = np.random.default_rng(9)
    x = planted(400, 5)
    near = x[:1] + 0.02 * rng.standard_normal((60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, near)))]
    want = brute_vectors(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in similar_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    pairs = [i for i in range(1, 400) if want[i][0]]
    assert len(pairs) > 390 and sum(got[i][0] > 0 for i in pairs) >= 0.93 * len(pairs)
    assert all(got[d][0] <= want[d][0] for d in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_share_of_pairs_falls():
    """Twice the root of the number, half the share of random pairs that meet; planted pairs are found all the same."""
    shares = []
    for n in (2_000, 32_000):
        x = planted(3_000, n)
        scale, tables = lattice(n)
        keys = cell_keys(x, scale, tables)
        meet = lambda a, b: ((keys[a][:, :, :1] == keys[b]).any(axis=(1, 2)) | (keys[b][:, :, :1] == keys[a]).any(axis=(1, 2))).mean()  # noqa: B023, E731
        at = np.arange(3_000)
        assert meet(at, at + 3_000) >= 0.95
        shares.append(np.mean([meet(at, np.roll(at, k)) for k in range(1, 30)]))
    assert shares[1] < shares[0] / 2


def test_vector_edges(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16).tolist()
    rows = [(1, v), (2, v), (3, [2 * x for x in v]), (4, [-x for x in v]), (5, None), (6, []), (7, [0.0] * 16), (8, [float("nan")] + v[1:]), (9, [None] + v[1:]), (10, v[:8]), (11, [float("inf")] + v[1:]), (12, [1e-30 * x for x in v]), (2, v), (None, [9.0 + x for x in range(16)]), (13, [9.0 + x for x in range(16)])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, 0) for r in rows], f"vec_id bigint, embedding array<{kind}>, node int")
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in similar_vectors(df).collect()}
        assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[12] == (3, 1, False)
        assert got[None] == (1, 13, False) and got[13] == (1, 13, True)
        assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))
        assert similar_vectors(df).count() == len(rows) and similar_vectors(df.where("false")).count() == 0


def test_lattice():
    """The decoder finds the nearest point: none of its 240 neighbours is nearer."""
    x = np.random.default_rng(2).uniform(-3, 3, (500, 8))
    home = decode(x)
    assert np.allclose(home * 2, np.rint(home * 2)) and np.allclose(home.sum(axis=1) % 2, 0) and len(roots()) == 240
    own = ((x - home) ** 2).sum(axis=1)
    assert all(own[i] <= ((x[i] - home[i] - roots()) ** 2).sum(axis=1).min() + 1e-9 for i in range(len(x)))


def test_nested_schemas(spark):
    inner = toolcalls.Fields({"unit": (toolcalls.OneOf(("m", "km")), True), "n": ("number", False)}, closed=True)
    schemas = {"go": {"legs": (toolcalls.Items(inner), True), "how": (toolcalls.OneOf(("foot", "car")), False), "note": (toolcalls.Fields({"by": ("string", True)}), False)}}
    good = [
        {"legs": []}, {"legs": [{"unit": "m"}]}, {"legs": [{"unit": "km", "n": 1.5}, {"unit": "m", "n": None}]}, {"legs": [], "how": "car"}, {"legs": [], "how": None},
        {"legs": [], "note": {"by": "x", "more": 1}}, {"legs": [], "other": 1},
    ]
    bad = [
        {}, {"legs": {}}, {"legs": [3]}, {"legs": [None]}, {"legs": [{"n": 1}]}, {"legs": [{"unit": "mile"}]}, {"legs": [{"unit": "m"}, {"unit": 1}]}, {"legs": [{"unit": "m", "n": "1"}]}, {"legs": [{"unit": "m", "x": 1}]},
        {"legs": [], "how": "boat"}, {"legs": [], "how": 1}, {"legs": [], "note": {"by": 1}}, {"legs": [], "note": {}}, {"legs": [], "note": []},
    ]
    calls = [json.dumps({"id": f"c{i}", "name": "go", "arguments": a}) for i, a in enumerate(good + bad)]
    df = spark.createDataFrame([(1, i, "assistant", f"<tool_call>{c}</tool_call>") for i, c in enumerate(calls)], "conv_id bigint, turn bigint, role string, text string")
    got = {r["turn"]: r["status"] for r in format_chat(df, schemas).where("kind = 'call'").collect()}
    assert [got[i] for i in range(len(calls))] == ["unanswered"] * len(good) + ["invalid"] * len(bad)
