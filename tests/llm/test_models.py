"""Clusters, personal data and repaired conversations against brute force and DuckDB."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm.centroids import CLUSTERS_SQL, TOO_LARGE, _clusters_sql, assign, build, clusters, nearest
from meterlake.llm.personal import KINDS, LABELS, SCANNED, _ALLOWED, _FIRST, _rows, _scan, base_spans, label_words, learn, luhn, personal_report, train, viterbi, words
from meterlake.llm.repair import REPAIR_SQL, Repair, damaged, repaired

from .conftest import CLASHES, ROWS, plain

SF = "/root/testdata/sf0.001"


def duck(sql, **views):
    con = duckdb.connect()
    for name, rows in views.items():
        con.execute(f"create view {name} as select * from '{rows}'") if isinstance(rows, str) else con.register(name, rows)
    return sorted(con.execute(sql).fetchall(), key=repr)


# Clusters


@pytest.mark.parametrize("spread", [1, 40, 1 << 27])
def test_balls_give_the_nearest_centroid(spread):
    rng = np.random.default_rng(spread)
    x = np.concatenate([rng.integers(-spread, spread, (900, 6)), np.repeat(rng.integers(-spread, spread, (1, 6)), 300, axis=0), rng.integers(-2, 2, (400, 6)) + spread // 2])
    c = np.concatenate([x[:7], x[:3], rng.integers(-spread, spread, (4, 6)), x[-2:]])  # equal centroids too
    order, tree = build(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (tree.points == x[order]).all()
    labels, counts, sums, balls = assign(tree, c)
    want = np.array([min(range(len(c)), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(p, c[k], strict=True)), k)) for p in tree.points])
    assert (labels == want).all() and (nearest(tree.points, c) == want).all() and (balls > 0 or spread == 1)
    assert counts.tolist() == np.bincount(want, minlength=len(c)).tolist()
    assert all((sums[k] == tree.points[want == k].sum(axis=0)).all() for k in range(len(c)))


def test_nodes_hold_their_points():
    x = np.random.default_rng(3).integers(-99, 99, (700, 5))
    _, tree = build(x, leaf=9)
    for a, b, r, s in zip(tree.start, tree.end, tree.radius, tree.sums, strict=True):
        part = tree.points[a:b]
        assert (part.sum(axis=0) == s).all()
        assert np.sqrt(((part - s / (b - a)) ** 2).sum(axis=1)).max() <= r + 1e-9
    leaves = sorted((a, b) for a, b, right in zip(tree.start, tree.end, tree.right, strict=True) if not right)
    assert leaves[0][0] == 0 and leaves[-1][1] == len(x) and all(p[1] == q[0] for p, q in itertools.pairwise(leaves))


def test_clusters_as_duckdb(spark):
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    got = clusters(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert ", ".join(got.columns) == columns
    assert plain(got) == duck(f"select {columns} from ({CLUSTERS_SQL})", embeddings=f"{SF}/embeddings.parquet")


def test_clusters_edges(spark):
    rng = random.Random(1)
    rows = [(i % 40, [rng.choice([-1.5, 0.25, 0.0, 3.0]) for _ in range(4)]) for i in range(60)]
    rows += [(5, [1.0] * 4)] * 30 + [(None, [0.5] * 4), (7, None), (8, []), (9, [1.0] * 3), (10, [1.0, None, 1.0, 1.0]), (11, [float("nan")] * 4), (12, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = clusters(df.select("*", *[F.lit("x").alias(c) for c in (*CLASHES, "x", "cluster", "distance", "name")]), k=6, rounds=3, dim=4)
    assert got.count() == 91 and got.where("vec_id is null").count() == 1
    assert plain(got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) == duck(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({_clusters_sql(6, 3, 4)})", embeddings=df.toArrow())
    few = clusters(df.where("vec_id = 5").limit(2), k=6, rounds=2, dim=4)
    assert few.count() == 2 and {r["cluster"] for r in few.collect()} <= {0, 1}
    assert clusters(df.limit(0)).count() == 0 and clusters(df.where("vec_id = 7")).columns == got.columns
    large = spark.createDataFrame([("a", [TOO_LARGE] * 4), ("b", [TOO_LARGE - 1] * 4), ("c", [-TOO_LARGE + 1] * 4)], "vec_id string, embedding array<double>")
    assert [r["vec_id"] for r in clusters(large, k=2, dim=4).orderBy("vec_id").collect()] == ["b", "c"]


# Personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_personal(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits.encode()), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((KINDS.index(kind), m.start(), m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_rules_as_re():
    rng = random.Random(2)
    alphabets = ["0123456789", "12345 -.+()@", "ab@.c1-_", "+1 (23", "é東 \n.@", "4111 ", "0.25"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 45)))
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        points = np.append(np.cumsum((buf & 0xC0) != 0x80) - 1, len(text))
        got = base_spans(raw, buf)
        assert sorted((k, int(points[a]), int(points[b])) for k, kind in enumerate(KINDS) for a, b in got[kind]) == brute_personal(text), text
        words(raw, buf)


def test_rules_cost_the_length():
    """Runs that a regular expression would try again from each place."""
    for text in (b"a" * 2_000_000, b"1" * 2_000_000, b"1 " * 1_000_000, b"a@" * 500_000, b"+1 " * 500_000, b"1.2.3." * 300_000):
        base_spans(text, np.frombuffer(text, np.uint8))


def test_words_and_labels():
    raw = "see (743) 555-3824, or ann@x.org! now 12 a ##@## \nTel. +1 22 333 4444.".encode()
    buf = np.frombuffer(raw, np.uint8)
    found = words(raw, buf)
    assert [raw[a:b] for a, b in zip(found.start, found.end, strict=True)] == [b"(743", b"555-3824", b"ann@x.org", b"12", b"##@##", b"+1", b"22", b"333", b"4444"]
    assert found.begins.tolist() == [True, False, True, True, True, True, False, False, False]
    assert found.before == [b"see", b"or", b"now", b"a", b"tel"]
    assert [LABELS[y] for y in label_words(found, base_spans(raw, buf))] == ["O", "O", "B-email", "O", "O", "B-phone", "I-phone", "I-phone", "I-phone"]


@pytest.fixture(scope="module")
def field():
    table = [([b"a1", b"b2"], b"x", [1, 2]), ([b"77"], b"y", [0]), ([b"4111", b"4111", b"1"], b"", [5, 6, 0])] * 5
    return train(table, rounds=30)


def test_viterbi_takes_the_best_path(field):
    rng = random.Random(4)
    for _ in range(60):
        sequences = [[rng.choice([b"a1", b"b2", b"77", b"4111", b"1", b"?9"]) for _ in range(rng.randint(1, 3))] for _ in range(4)]
        rows = np.array([r for s in sequences for r in _rows(field.names, s, b"x")])
        begins = np.array([i == 0 for s in sequences for i in range(len(s))])
        labels, at = viterbi(field, rows, begins), 0
        for s in sequences:
            scores = field.weights[rows[at : at + len(s)]].sum(axis=1)

            def weight(path, scores=scores):
                return field.starts[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(field.steps[a, b] for a, b in itertools.pairwise(path))

            best = max(weight(p) for p in itertools.product(range(len(LABELS)), repeat=len(s)))
            own = labels[at : at + len(s)].tolist()
            assert weight(own) == pytest.approx(best)
            assert _FIRST[own[0]] and all(_ALLOWED[a, b] for a, b in itertools.pairwise(own))
            at += len(s)


def test_field_learns(spark, sample):
    scanned = sample.select("doc_id", "text").mapInArrow(_scan, f"doc_id bigint, {SCANNED}")
    texts = ["call 743 555 3824 soon", "fax (212) 555-0199", "visa 3782 822463 10005 ok", "write to ops@[10.0.0.1] or", "host 2001:db8::7 down", "on 2024-05-17 at 12:30", "order 1234567 of 3.4.5", "see v1.20 for $12.50"]
    found = {r["doc_id"]: r["spans"] for r in personal_report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").union(sample.select(F.col("doc_id") + 100, "text"))).where("doc_id < 100").collect()}
    assert found[0] == "phone:5:17" and found[1] == "phone:4:18" and found[2] == "card:5:22" and found[4] == "ip:5:16" and found[3] == "ip:14:22"
    assert found[5] == found[6] == found[7] == ""
    one, two = learn(scanned), learn(scanned.repartition(7))
    assert one.names == two.names and np.allclose(one.weights, two.weights)


def test_personal_as_brute_force(sample):
    got = {r["doc_id"]: r for r in personal_report(sample).collect()}
    added = 0
    for r in sample.collect():
        base, row = brute_personal(r["text"]), got[r["doc_id"]]
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[0] == i for s in base) for i in range(len(KINDS))]
        assert row["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        every = row["spans"].split(",") if row["spans"] else []
        order = [(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in every)]
        assert set(base) <= set(order) and order == sorted(order)
        more = sorted(set(order) - set(base))
        assert all(b <= x or y <= a for _, a, b in more for _, x, y in [*base, *more] if (a, b) != (x, y))
        added += len(more)
    assert added < 0.1 * sum(len(brute_personal(r["text"])) for r in sample.collect()) + 5


def test_personal_edges(spark, edge, none, clashing):
    assert personal_report(none).count() == 0
    got = personal_report(clashing)
    assert got.count() == len(ROWS)
    assert plain(got) == plain(personal_report(edge))
    assert all(r["spans"] == "" and r["n_email"] == 0 for r in got.where("doc_id in (4, 5, 6)").collect())
    digits = "12 3 " * 300_000
    long = spark.createDataFrame([(1, "é " + "x" * 5_000_000 + " a@b.org"), (1, "é " + "x" * 5_000_000 + " a@b.org"), (2, digits), (None, "4111 1111 1111 1111")], "doc_id bigint, text string")
    rows = sorted(personal_report(long).collect(), key=repr)
    assert [r["spans"] for r in rows if r["doc_id"] == 1] == ["email:5000003:5000010"] * 2 and sum(r["n_card"] for r in rows if r["doc_id"] is None) == 1


# Conversations


def brute_repair(rows):
    """All edits of a short conversation, one by one."""
    best = None

    def go(i, roles, lines, cost, audit):
        nonlocal best
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best, (cost, audit, "\n".join(lines))) if best else (cost, audit, "\n".join(lines))
        if audit[-3:] != "III":
            for role in ("user", "assistant"):
                go(i, roles + role[0], [*lines, f"{role}:"], cost + 5, audit + "I")
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, lines, cost + 2, audit + "D")
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, roles + role[0], [*lines, f"{role}:{text}"], cost + extra, audit + "K")
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], [*lines, f"{r}:{text}"], cost + 1 + extra, audit + "R")

    go(0, "", [], 0, "")
    return best


def test_repair_is_the_cheapest():
    rng = random.Random(6)
    for n in range(500):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", "stage", " "]), f"t{i}.", rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(n % 5)]
        one = Repair()
        for r in rows:
            one.turn(*r)
        cost, audit, text = brute_repair(rows)
        assert one.end() == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(12)] + [(None, 1, None, None), (3, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if hit == 4 else role or " ", text or " "
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        want += [(c, t, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    assert plain(damaged(df)) == sorted(want, key=repr)


def test_repair_as_duckdb(spark):
    columns = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    got = repaired(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert ", ".join(got.columns) == columns
    assert plain(got) == duck(f"select {columns} from ({REPAIR_SQL})", conversations=f"{SF}/conversations.parquet")


def test_repair_edges(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n\v\f\r", "Fine.", "Fine.", "no end", "Ends! \n", " ", "é?", "tail. x"]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, 1, 2, 3, 5, 9, 40]), rng.choice(["user", "assistant", "system", None, "tool", "User"]), rng.choice(texts)) for _ in range(160)]
    rows += [(50 + c, 0, "user", "Only one.") for c in range(60)]  # some lose all their rows
    rows += [(7, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    clash = df.select("*", *[F.lit("x").alias(c) for c in (*CLASHES, "fault", "digest", "hit", "c", "d", "least", "gaps")])
    got = repaired(clash)
    assert plain(got) == duck(f"select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 from ({REPAIR_SQL})", conversations=df.toArrow())
    lost = got.where("audit = '' and conv_id >= 50").collect()
    assert lost and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["cost"] == 0 for r in lost)
    assert repaired(df.limit(0)).count() == 0


def test_repair_of_long_conversations(spark):
    df = spark.range(200_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), "id", F.lit(".")).alias("text"))
    row = repaired(df).first()
    assert len(row["audit"]) >= row["duplicate"] and row["duplicate"] > 5000 and set(row["audit"]) <= set("DIKR")
