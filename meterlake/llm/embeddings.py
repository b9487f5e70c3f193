"""Embedding near-duplicates by lattice hashing.

A table projects unit vectors to eight dimensions at random and decodes them
to points of the E8 lattice. A vector lies in its own point's cell and probes
the neighbouring points that its residual leans to most. Vectors that meet in
a cell of any table are compared by cosine in double precision.

Equal vectors are one class, with a weight. Links are counted where they are
found: a pair that meets in several cells counts in the first of them only, so
no pairs are written; a cell's connected classes leave as one label each.
Cells of many entries are cut in blocks, and each pair of blocks is a group.

Cells get finer as vectors get more, so that the share of random pairs that meet
in a table falls with the square root of their number; tables are added until a
pair at the threshold is found as often as RECALL says.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, staged, whole
from .components import components

PROBES = 4
#: Chance that a pair of the least cosine meets in some table, by the rate at which simulated ones meet in one.
RECALL = 0.97
#: Length of the lattice's unit at SCALE_ROWS vectors, against projections whose coordinates have the vectors' lengths as deviation. A cell's volume falls with the eighth power of the length, hence the root.
SCALE, SCALE_ROWS, SCALE_ROOT = 1.4, 50_000, 1 / 16
SIMULATED = 8_000
LEAST_COSINE = 0.9
#: Entries of a cell that make a block.
BLOCK = 2048
SEED = 20240229


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    for m in range(256):
        v = np.array([0.5 - (m >> k & 1) for k in range(8)])
        if m.bit_count() % 2 == 0:
            out.append(v)
    return np.array(out)


@lru_cache(maxsize=64)
def _projection(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, table, dim))
    return rng.standard_normal((dim, 8)), rng.uniform(0, 2, 8)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    r = np.rint(x)
    off = x - r
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    r[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: even-sum integer points, or those moved by a half in all coordinates."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def cells(x: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """(vector, 1 + probes, 8): the points nearest to x, then those that it leans to most."""
    home = decode(x)
    lean = (x - home) @ roots().T
    near = np.argpartition(-lean, probes, axis=1)[:, :probes]
    return np.concatenate((home[:, None, :], home[:, None, :] + roots()[near]), axis=1)


@lru_cache(maxsize=64)
def lattice(n: int) -> tuple[float, int]:
    """(scale, tables) for n vectors.

    Projections of two unit vectors are normal with their cosine as correlation,
    whatever their length, so the rate of meeting is that of simulated ones.
    """
    scale = SCALE * (SCALE_ROWS / max(n, 1)) ** SCALE_ROOT
    rng = np.random.default_rng(SEED)
    a, b = rng.standard_normal((2, SIMULATED, 8))
    b = LEAST_COSINE * a + (1 - LEAST_COSINE**2) ** 0.5 * b
    shift = rng.uniform(0, 2, (SIMULATED, 8))
    x, y = cells(a / scale + shift), cells(b / scale + shift)
    met = (x[:, :1] == y).all(axis=2).any(axis=1) | (y[:, :1] == x).all(axis=2).any(axis=1)
    return scale, max(1, int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(met.mean(), 0.999)))))


def cell_keys(unit: np.ndarray, scale: float, tables: int) -> np.ndarray:
    """int64 keys (vector, table, 1 + PROBES) of unit vectors' own cells, which come first, and of the cells that they probe."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + PROBES), np.uint64)
    for t in range(tables):
        p, shift = _projection(t, dim)
        points = cells(unit @ p / scale + shift)
        h = np.full(points.shape[:2], (t + 1) * 1000003 + dim, np.uint64)
        for k in range(8):
            h ^= np.rint(2 * points[:, :, k]).astype(np.int64).view(np.uint64)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = h
    return out.view(np.int64)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return np.asarray(pc.list_flatten(vectors), np.float64).reshape(len(vectors), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(scale: float, tables: int):
    """(key, t, home, node): a row for each cell that a class lies in or probes."""

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
            for dim in np.unique(sizes):
                of_dim = np.flatnonzero(sizes == dim)
                for start in range(0, len(of_dim), 500):
                    part = batch.take(pa.array(of_dim[start : start + 500]))
                    keys = cell_keys(_units(_matrix(part.column("embedding"))), scale, tables)
                    n, _, each = keys.shape
                    rows = pa.array(np.repeat(np.arange(n), tables * each))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.reshape(-1)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)), pa.array(np.tile(np.arange(each) == 0, n * tables)), part.column("node").take(rows)],
                        ["key", "t", "home", "node"],
                    )

    return run


def first_meeting(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table and the cell where each pair counts: its first table in which one lies where the other lies or probes, and of two such cells the lesser."""
    x, y = keys[a], keys[b]
    at_x, at_y = (x[:, :, :1] == y).any(axis=2), (y[:, :, :1] == x).any(axis=2)
    t = (at_x | at_y).argmax(axis=1)
    i = np.arange(len(a))
    most = np.iinfo(np.int64).max
    return t, np.minimum(np.where(at_x[i, t], x[i, t, 0], most), np.where(at_y[i, t], y[i, t, 0], most))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least item that pairs (a, b) connect it with."""
    label = np.arange(n)
    while True:
        now = label.copy()
        np.minimum.at(now, a, label[b])
        np.minimum.at(now, b, label[a])
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _group(key: int, t: int, p: int, q: int, home: np.ndarray, block: np.ndarray, node: np.ndarray, weight: np.ndarray, vectors: np.ndarray, scale: float, tables: int) -> list[tuple]:
    """(node, links, root) of the classes of one group that have a partner in it."""
    order = np.lexsort((~home, node))  # a class may both lie in the cell and probe nothing else there: one row for each
    keep = order[np.concatenate(([True], node[order][1:] != node[order][:-1]))]
    home, block, node, weight = home[keep], block[keep], node[keep], weight[keep]
    x = _units(vectors[keep])
    pairs_a, pairs_b = [], []
    for i in np.array_split(np.flatnonzero(home), max(1, len(x) * int(home.sum()) // 2_000_000)):
        r, c = np.nonzero(x[i] @ x.T >= LEAST_COSINE)
        r = i[r]
        ok = (r != c) & (~home[c] | (r < c)) & ((block[r] != block[c]) if p != q else True)
        pairs_a.append(r[ok])
        pairs_b.append(c[ok])
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    if not len(a):
        return []
    used, spot = np.unique(np.concatenate((a, b)), return_inverse=True)
    ua, ub = spot[: len(a)], spot[len(a) :]
    keys = np.concatenate([cell_keys(x[used[s : s + 500]], scale, tables) for s in range(0, len(used), 500)])
    links = np.zeros(len(used), np.int64)
    for s in range(0, len(a), 100_000):
        pa_, pb = ua[s : s + 100_000], ub[s : s + 100_000]
        table, cell = first_meeting(keys, pa_, pb)
        here = (table == t) & (cell == key)
        np.add.at(links, pa_[here], weight[used[pb[here]]])
        np.add.at(links, pb[here], weight[used[pa_[here]]])
    root = _labels(len(used), ua, ub)
    return [(int(node[u]), int(n), int(node[used[r]])) for u, n, r in zip(used, links, root, strict=True)]


def _compare(scale: float, tables: int):
    """Rows come sorted by (key, p, q); a group's rows are held until the next begins."""
    names = ("key", "t", "p", "q", "home", "block", "node", "weight")

    def run(batches):
        for group in groups(batches, ["key", "p", "q"]):
            if group.num_rows < 2 or not pc.any(group.column("home")).as_py():
                continue
            key, t, p, q, home, block, node, weight = (group.column(c).to_numpy() for c in names)
            found = _group(int(key[0]), int(t[0]), int(p[0]), int(q[0]), home.astype(bool), block, node, weight, _matrix(group.column("embedding")), scale, tables)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["node", "links", "root"])

    return run


@whole
def similar_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding: array of floats or doubles).

    Vectors that are null, empty or zero, or that hold null or non-finite
    components, link with nothing, and vectors of different lengths don't link.
    Rows with equal id and vector are one vector and each get its result. A
    null id never names a component that has other ids. An empty table gives an
    empty one; other columns are ignored, whatever their names.
    """
    rows = vectors.select("vec_id", "embedding")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0), F.lit(False))
    digest = F.when(F.col("good"), F.unhex(F.sha2(F.to_json(F.struct("embedding")), 256)))
    keyed = rows.withColumn("good", good).withColumn("digest", digest)
    fine = keyed.where("good").groupBy("digest", "vec_id").agg(F.first("embedding").alias("embedding"))
    # A class of equal vectors, by the SHA-256 of their components as written; node is its number from here on.
    classes = fine.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    scale, tables = lattice(classes.count())
    entries = staged(classes.select("node", "embedding").mapInArrow(_entries(scale, tables), "key bigint, t int, home boolean, node bigint"), "entries")
    # Cells in which something can meet, with their blocks.
    met = entries.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("home").alias("lived")).where("n > 1 and lived").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(met, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "t", "home", "block", "node").join(classes.select("node", "weight", "embedding"), "node")
    found = staged(dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_compare(scale, tables), "node bigint, links bigint, root bigint"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = classes.select("digest", "node", "least", "weight").join(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = grouped.join(names, "component").join(links, "node", "left").select("digest", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = keyed.select("vec_id", "digest").join(facts, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
