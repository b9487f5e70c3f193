"""Near-duplicates against brute force over all pairs."""

import pathlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterlake.llm.common import shared_dir
from meterlake.llm.components import components
from meterlake.llm import neardup
from meterlake.llm.neardup import _permute, exact_sets, near_duplicate_report, shingle_sets, similar

from .conftest import ROWS, SCHEMA, plain

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) for each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=repr)


def test_sample(sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]
    assert plain(near_duplicate_report(sample)) == brute(rows)


def test_edges(edge, none, clashing):
    want = brute([r[:2] for r in ROWS])
    assert plain(near_duplicate_report(edge)) == want
    assert plain(near_duplicate_report(clashing)) == want
    assert plain(near_duplicate_report(none)) == []


def test_chains_and_thresholds(spark):
    """Chains of edits, whose ends are unlike, and pairs at both sides of the threshold."""
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((6, 30, 80)))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(4000)}"
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert plain(near_duplicate_report(df)) == brute(rows)


def test_large_group(spark):
    """One group of 1,500 near copies, over several blocks of a bucket."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(1500):
        words = list(base)
        words[rng.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert {r["component_id"] for r in near_duplicate_report(df).collect()} == {0}


def test_components(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    other = [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    edges = chain + other + [(5, 5), (1, 0)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rng.shuffle(edges)
    assert plain(components(spark.createDataFrame(edges, "a bigint, b bigint"))) == sorted(root.items(), key=repr)
    assert plain(components(spark.createDataFrame([], "a bigint, b bigint"))) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té\x0b", max_size=60), min_size=1, max_size=4))
def test_shingle_sets(texts):
    assert [s.shape[1] for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    sets, want = exact_sets([neardup._words(t) for t in texts]), [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            both = len(want[i] & want[j])
            assert len(np.intersect1d(sets[i], sets[j])) == both
            assert similar(sets[i], sets[j]) == (both > 0 and 100 * both >= 75 * len(want[i] | want[j]))


def test_words_of_one_polynomial_hash(spark):
    """Thue-Morse words, which every polynomial modulo 2**64 confuses, and texts made of them."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x {word} y z"), (4, f"x {other} y z"), (5, word.upper())]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert plain(near_duplicate_report(df)) == brute(rows)


def test_classes_of_one_digest_are_confirmed(spark):
    """Links hold on the words themselves, whatever their hashes."""
    a, b = exact_sets([[b"p", b"q", b"r", b"s", b"t"], [b"p", b"q", b"r", b"s", b"u"]])
    assert not similar(a, b)


@pytest.mark.parametrize("block", [(500, 2_000_000), (7, 2_000_000), (500, 900)])
def test_long_common_bucket(spark, monkeypatch, block):
    """Long unlike texts with one passage, which meet in buckets, and near copies of each; blocks by rows and by shingles."""
    monkeypatch.setattr(neardup, "BLOCK", block[0])
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block[1])
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(300)]
    for g in range(12):
        own = [f"g{g}w{rng.randrange(10_000)}" for _ in range(170)]
        for _ in range(5):
            words = passage + own
            words[rng.randrange(len(words))] = f"x{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    assert plain(near_duplicate_report(df)) == brute(rows)


def test_staged_folders_go(spark, edge):
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    near_duplicate_report(edge).count()
    before = set(folder.iterdir())
    assert near_duplicate_report(edge).count() == len(ROWS)
    assert len(set(folder.iterdir()) - before) == 1


def test_permutation():
    x = np.random.default_rng(1).integers(0, 1 << 32, 100_000, dtype=np.uint32)
    assert len(np.unique(_permute(x, 0x7FEB352D, 0x846CA68B))) == len(np.unique(x))


@pytest.mark.parametrize("common, a, b", [(3, 1, 0), (6, 1, 1), (30, 5, 5)])
def test_planted_pairs_pass_the_bits_and_the_bands(common, a, b):
    """Pairs at exactly 0.75: signatures differ as independent bits would, none by more than the filter lets through."""
    rng, pairs = np.random.default_rng(common), 10_000
    sets = []
    for row in rng.integers(0, 2**63, (pairs, common + a + b)).astype(np.uint64):
        for x in (row[: common + a], np.concatenate((row[:common], row[common + a :]))):
            sets.append(np.stack((np.sort(x), np.sort(x))))
    sig = neardup.signatures(sets)
    sketch, bands = neardup._sketch(sig), neardup._band_keys(sig)
    bits = np.bitwise_count(sketch[0::2] ^ sketch[1::2]).sum(1)
    assert abs(bits.mean() - 16) < 0.2 and abs(bits.std() - (128 * 0.125 * 0.875) ** 0.5) < 0.15
    assert bits.max() <= neardup.MOST_BITS
    assert (~(bands[0::2] == bands[1::2]).any(1)).sum() <= 2
