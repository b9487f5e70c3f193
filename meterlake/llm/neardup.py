"""MinHash near-duplicates: circulant MinHash, banding, exact Jaccard.

A document is the set of its distinct 5-word shingles. Documents with one set
form a class, so exact copies count once from then on. A class's signature
comes from two permutations of 32-bit numbers: the first is applied once to
its shingles, the second, shifted circularly by k, gives coordinate k. Four
coordinates make a band, 32 bands a signature; at a similarity of 0.75 all
bands miss once in 190,000 pairs.

Classes that share a band's bucket are linked in two passes, neither of which
makes all pairs of a bucket. First each class is compared with its bucket's
least and greatest class. Then, in buckets whose classes aren't yet in one
component, tasks compare classes of different components, as long as they are
different, and give only the links. What is left uncompared is already
connected, so no component is missed.

A set's shingles are 128-bit hashes of their words' BLAKE2b digests, and a class
is the sets with one 128-bit digest; both are used to find candidates and equal
sets. Links between classes are confirmed on the texts' own words, numbered
without hashes. A class's number is drawn when the table of classes is written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, dealt_in_blocks, groups, slices, staged, text_key, whole
from .components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Of 128 signature bits, classes of similarity 0.75 differ in 16 on average; chances that they differ in more than these are 3 in 10**9, far below those that all bands miss.
MOST_BITS = 40
#: Texts that one task compares with the same pivot, about, and the numbers by which a pivot's pairs are spread before that.
PIVOT_TEXTS, SALTS = 256, 64
#: Classes of a bucket that make a block of the second pass, and the shingles in them, at most about.
BLOCK, BLOCK_SHINGLES = 500, 2_000_000
MAX_CHARS = 1_000_000
#: Bytes of the words whose digests a task remembers.
WORD_BYTES = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LANES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


class _Digests(dict):
    """Words to their numbers in data, which holds 16 bytes of BLAKE2b for each."""

    def __init__(self):
        self.data, self.held = bytearray(), 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.data) // 16
        self.data += hashlib.blake2b(word, digest_size=16).digest()
        self.held += len(word) + 100
        return n


_digests = _Digests()


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct shingles as 128-bit hashes: two rows of 64-bit numbers, sorted by the first, then the second."""
    global _digests
    if _digests.held > WORD_BYTES:
        _digests = _Digests()
    words = [_words(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return [np.zeros((2, 0), np.uint64) for _ in texts]
    numbers = np.fromiter((n for w in words for n in map(_digests.__getitem__, w)), np.int64, int(counts.sum()))
    digests = np.frombuffer(bytes(_digests.data), np.uint64).reshape(-1, 2)
    per = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(per)))
    at = np.arange(bounds[-1]) + np.repeat(np.cumsum(counts) - counts - bounds[:-1], per)
    width = np.repeat(np.minimum(counts, SHINGLE), per)
    short = np.flatnonzero(width < SHINGLE)
    lanes = []
    for lane, odd in enumerate(_LANES):
        of_word = digests[:, lane][numbers]
        h = width.astype(np.uint64) * _BASE
        for k in range(SHINGLE):
            more = h ^ of_word[np.minimum(at + k, len(of_word) - 1)]
            more *= odd
            more ^= more >> np.uint64(29)
            more *= _BASE
            more ^= more >> np.uint64(32)
            over = short[width[short] <= k]
            more[over] = h[over]
            h = more
        lanes.append(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x, y = lanes[0][a:b], lanes[1][a:b]
        order = np.argsort(x)
        x, y = x[order], y[order]
        same = x[1:] == x[:-1]
        if (y[1:][same] != y[:-1][same]).any():
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        keep = np.concatenate(([True], ~same)) if b > a else np.zeros(0, bool)
        out.append(np.stack((x[keep], y[keep])))
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """For each number how many distinct ones are smaller."""
    order = np.argsort(x)
    out = np.empty(len(x), np.uint64)
    s = x[order]
    out[order] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s[1:] != s[:-1], dtype=np.uint64))) if len(x) else x
    return out


def exact_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Each word list's distinct shingles as sorted numbers, equal across the lists exactly where the words are: words are numbered, then pairs of words, pairs of pairs, and those with a fifth."""
    number: dict[bytes, int] = {}
    wide, bounds = [], [0]
    for words in texts:
        w = np.fromiter((number.setdefault(x, len(number) + 1) for x in words), np.uint64, len(words))
        if 0 < len(w) < SHINGLE:
            w = np.concatenate((w, np.zeros(SHINGLE - len(w), np.uint64)))
        wide.append(w)
        bounds.append(bounds[-1] + max(0, len(w) - SHINGLE + 1))
    at = [np.concatenate([w[k : len(w) - SHINGLE + 1 + k] for w in wide if len(w)] or [np.zeros(0, np.uint64)]) for k in range(SHINGLE)]
    half = np.uint64(32)
    pairs = [_ranks(at[k] << half | at[k + 1]) for k in (0, 2)]
    keys = _ranks(pairs[0] << half | pairs[1]) << half | at[4]
    return [_distinct(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _permute(x: np.ndarray, odd1: int, odd2: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: odd multipliers and shifts, each of which can be undone."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(odd1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(odd2)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The circulant MinHash coordinates of non-empty sets, a row for each set."""
    sizes = np.array([s.shape[1] for s in sets])
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    once = _permute((np.concatenate([s[0] for s in sets]) >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    for k in range(BANDS * ROWS):
        out[k] = np.minimum.reduceat(_permute(once - np.uint32(k), 0x2C1B3C6D, 0x297A2D39), offsets)
    return out.T


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which also tells bands apart."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE, rows.shape[:2]).copy()
    for r in range(ROWS):
        h ^= rows[:, :, r]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h


def _sketch(sig: np.ndarray) -> np.ndarray:
    """The lowest bits of 128 coordinates as two 64-bit words."""
    return np.ascontiguousarray(np.packbits((sig & np.uint32(1)).astype(np.uint8), axis=1)).view(np.uint64)


def _signed(batches):
    for batch in batches:
        for part, texts in slices(batch, "text", MAX_CHARS):
            sets = shingle_sets(texts)
            sizes = np.array([s.shape[1] for s in sets], np.int64)
            some = [s for s in sets if s.shape[1]]
            bands, sketch = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), 2), np.uint64)
            if some:
                sig = signatures(some)
                bands[sizes > 0], sketch[sizes > 0] = _band_keys(sig), _sketch(sig)
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("rk"),
                    pa.array(sizes),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.array(sketch[:, 0].view(np.int64)),
                    pa.array(sketch[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                ["doc_id", "rk", "n", "d0", "d1", "s0", "s1", "bands"],
            )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of distinct numbers have a Jaccard similarity of PERCENT or more."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0


def _confirm(batches):
    """Rows come sorted by (pivot, part, not the pivot itself); keeps the links that hold on the full sets. One pivot's words are held at a time."""
    now, held = None, []
    for batch in batches:
        pivots, parts, nodes = (batch.column(c).to_pylist() for c in ("pivot", "part", "node"))
        at, good = 0, []
        for part, texts in slices(batch, "text", MAX_CHARS):
            words = [_words(t) for t in texts]
            lead, *sets = exact_sets([held, *words])
            for i, s in enumerate(sets, at):
                if nodes[i] == pivots[i]:
                    now, held, lead = (pivots[i], parts[i]), words[i - at], s
                elif now != (pivots[i], parts[i]):
                    raise ValueError("a pivot's text doesn't precede those compared with it")
                elif similar(lead, s):
                    good.append(i)
            at += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in good], pa.int64()), pa.array([pivots[i] for i in good], pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(node, pivot) whose texts are similar, as (a, b). texts has (node, text), one for each node.

    The pairs of a pivot that has more than PIVOT_TEXTS are dealt out in parts
    of about so many, each of which gets a copy of the pivot's text; a task
    keeps one pivot's words at a time. How many parts there are is looked up by
    pivot and one of SALTS numbers, so that a pivot's pairs don't meet for it.
    """
    salt = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")
    full = pairs.groupBy("pivot").count().where(F.col("count") > PIVOT_TEXTS).select("pivot", F.ceil(F.col("count") / PIVOT_TEXTS).cast("int").alias("parts"))
    spread = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = pairs.withColumn("salt", salt).join(spread, ["pivot", "salt"], "left").select("node", "pivot", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    sized = pairs.select("pivot").distinct().join(full, "pivot", "left")
    leads = sized.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    rows = members.union(leads).join(texts, "node")
    dealt = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("node") != F.col("pivot"))
    return dealt.select("pivot", "part", "node", "text").mapInArrow(_confirm, "a bigint, b bigint")


def _alike(a: str, b: str) -> Column:
    """What similar sets always have: sizes within 75%; and, but for chances under 1e-9, signatures' bits in common."""
    sizes = 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= PERCENT * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    bits = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s0", "s1")), F.lit(0))
    return sizes & (bits <= MOST_BITS)


def _open_pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits) of a group's rows that may be similar and aren't connected yet."""
    n, s0, s1, component, mine = (group.column(c).to_numpy() for c in ("n", "s0", "s1", "component", "mine"))
    if (component == component[0]).all():
        return (np.zeros(0, np.int64),) * 3
    bits = np.bitwise_count(s0[:, None] ^ s0[None, :]) + np.bitwise_count(s1[:, None] ^ s1[None, :])
    ok = (bits <= MOST_BITS) & (component[:, None] != component[None, :])
    ok &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
    if group.column("p")[0] != group.column("q")[0]:
        ok &= mine[:, None] != mine[None, :]
    a, b = np.nonzero(np.triu(ok, 1))
    return a, b, bits[a, b]


def _needed(batches):
    """(band, p, q, mine, node) of the rows that have a partner to be compared with."""
    for group in groups(batches, ["band", "p", "q"]):
        a, b, _ = _open_pairs(group)
        if len(a):
            yield from group.select(["band", "p", "q", "mine", "node"]).take(pa.array(np.union1d(a, b))).to_batches()


def _settle(batches):
    """Links between a group's components. A pair is looked at in the first bucket that it shares, and only while nothing has connected it."""
    for group in groups(batches, ["band", "p", "q"]):
        a, b, bits = _open_pairs(group)
        if not len(a):
            continue
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        equal = bands[a] == bands[b]
        first = bands[a, equal.argmax(axis=1)] == group.column("band")[0].as_py()
        order = np.argsort(bits[first], kind="stable")
        a, b = a[first][order], b[first][order]
        texts, component, node = group.column("text").to_pylist(), group.column("component").to_pylist(), group.column("node").to_pylist()
        used = np.union1d(a, b).tolist()
        sets = dict(zip(used, exact_sets([_words(texts[i]) for i in used]), strict=True))
        root = {c: c for c in component}

        def find(c, root=root):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(component[i]), find(component[j])
            if x != y and similar(sets[i], sets[j]):
                root[max(x, y)] = min(x, y)
                links.append((node[i], node[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


@whole
def near_duplicates(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, n_shingles, component, component_id, kept, copies) for each distinct row of docs (doc_id, text).

    rk is the text's SHA-256, component a component's own number. Null texts and
    texts without words have no shingles, are their own component (component is
    null) and are linked with nothing. Fewer than five words make one shingle.
    Rows with a null id take part but never name a component that has other
    ids. Repeated rows share a component, and all are kept if one is; copies
    counts them. An empty table gives an empty one. Texts may be of any length:
    a task holds one of them beside a bounded run of others. Other columns are
    ignored, whatever their names.
    """
    keyed = docs.select("doc_id", text_key().alias("rk"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = staged(keyed.mapInArrow(_signed, f"doc_id {kind}, rk binary, n bigint, d0 bigint, d1 bigint, s0 bigint, s1 bigint, bands array<bigint>"), "signed")
    # A class of equal sets, by their digest; node is its number from here on.
    facts = [F.min("doc_id").alias("least"), F.min("rk").alias("rk"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "bands")]]
    classes = staged(signed.where("n > 0").groupBy("d0", "d1").agg(*facts).withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "n", "s0", "s1", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = staged(banded.join(ends, "band").select("band", "node", "n", "s0", "s1", "lo", "hi"), "buckets")
    facts = classes.select("node", "n", "s0", "s1")
    stars = shared.select("node", "n", "s0", "s1", F.explode(F.array("lo", "hi")).alias("pivot")).where("node <> pivot").distinct()
    first = stars.alias("x").join(facts.withColumnRenamed("node", "pivot").alias("y"), "pivot").where(_alike("x", "y")).select(F.col("x.node").alias("node"), "pivot")
    first = staged(first, "pairs")
    # The texts of all classes that share a bucket, fetched once.
    wanted = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "rk")
    texts = staged(keyed.select("rk", "text").join(wanted.hint("shuffle_hash"), "rk").dropDuplicates(["node"]).select("node", "text"), "texts")
    links = staged(verified(first, texts), "links")
    found = staged(components(links), "components")
    # Second pass: buckets that hold more than one component yet.
    labelled = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("band")
    open_ = labelled.join(mixed, "band", "left_semi").select("band", "node", "n", "s0", "s1", "component")
    needed = staged(dealt_in_blocks(open_, "band", "node", BLOCK, "n", BLOCK_SHINGLES).mapInArrow(_needed, "band bigint, p int, q int, mine int, node bigint"), "needed")
    about = classes.select("node", "n", "s0", "s1", "bands").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(texts, "node")
    again = needed.join(about, "node").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    more = staged(again.mapInArrow(_settle, "a bigint, b bigint"), "more")
    # The second pass' links join components of the first, so its labels are a good start.
    found = staged(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")
    grouped = classes.select("d0", "d1", "node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "component").select("d0", "d1", "component", "component_id")
    rows = signed.groupBy("rk", "doc_id", "n", "d0", "d1").agg(F.count("*").alias("copies"))
    out = rows.join(named, ["d0", "d1"], "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("rk", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "copies")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    found = near_duplicates(docs)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_shingles", "component_id", "kept")
