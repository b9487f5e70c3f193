"""Centroid clustering by ball-tree filtering.

Vectors of whole numbers are cut into metric trees, each inside one partition.
A tree's node is a ball: radius, count and exact sum of its vectors. In every
round a tree is walked from its root with the centroids that may still own
something in it: where the distances to a ball's middle and its radius leave
one centroid by the triangle inequality, the whole ball goes to it by its count
and sum; else its halves are looked at, and leaves compare exactly.

No vector is shuffled. A task sends one row for each cluster it met, and the
centroids (K of DIM numbers) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, whole

DIM, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
#: Vectors of a tree, and of a leaf at most.
TREE, LEAF = 2048, 32
#: Components of this size or more aren't kept: squared distances might not fit in a long.
TOO_LARGE = 2.0**19
#: Up to this size, sums of DIM products are exact in doubles.
EXACT = 1 << 20


class Tree(NamedTuple):
    """points: n x dim whole numbers, in the order of the leaves. Nodes in preorder: a node's first half follows it, `right` is the second half's number (0: a leaf)."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
    """A tree over the rows of x (whole numbers), and the order that it puts them in."""
    order = np.arange(len(x))
    start, end, right, radius, sums = [], [], [], [], []
    todo = [(0, len(x), -1)]
    while todo:
        a, b, parent = todo.pop()
        if parent >= 0:
            right[parent] = len(start)
        part = x[order[a:b]]
        total = part.sum(axis=0)
        away = np.sqrt(((part - total / (b - a)) ** 2).sum(axis=1))
        node = len(start)
        for column, value in ((start, a), (end, b), (right, 0), (radius, away.max()), (sums, total)):
            column.append(value)
        far = part[away.argmax()]
        off = ((part - far).astype(np.float64) ** 2).sum(axis=1)
        if b - a <= leaf or not off.any():
            continue
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition((part - far) @ (part[off.argmax()] - far).astype(np.float64), half)]
        todo += [(a + half, b, node), (a, a + half, -1)]
    return order, Tree(x[order], *(np.array(c) for c in (start, end, right, radius, sums)))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, the smallest of equals: exact for whole numbers."""
    if not len(x):
        return np.zeros(0, np.int64)
    small = max(np.abs(x).max(), np.abs(centroids).max()) <= EXACT
    x, c = (v.astype(np.float64 if small else np.int64) for v in (x, centroids))
    if small:
        return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1).argmin(axis=1)


def assign(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(label of each point, count and sum of each centroid's points, points that were assigned with their ball)."""
    labels = np.empty(len(tree.points), np.int64)
    counts, sums, balls = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
    middle = tree.sums / (tree.end - tree.start)[:, None]
    gaps = np.stack([np.sqrt(((middle - c) ** 2).sum(axis=1)) for c in centroids], axis=1)
    slack = 1e-9 * (1 + np.abs(tree.points).max() + np.abs(centroids).max() + gaps.max())  # of rounding
    # Of equal centroids only the first can own anything.
    todo = [(0, np.sort(np.unique(centroids, axis=0, return_index=True)[1]))]
    while todo:
        i, some = todo.pop()
        gap = gaps[i, some]
        some = some[gap - tree.radius[i] <= gap.min() + tree.radius[i] + slack]
        here = slice(tree.start[i], tree.end[i])
        if len(some) == 1:
            labels[here] = some[0]
            counts[some[0]] += tree.end[i] - tree.start[i]
            sums[some[0]] += tree.sums[i]
            balls += tree.end[i] - tree.start[i]
        elif tree.right[i]:
            todo += [(tree.right[i], some), (i + 1, some)]
        else:
            labels[here] = own = some[nearest(tree.points[here], centroids[some])]
            np.add.at(counts, own, 1)
            np.add.at(sums, own, tree.points[here])
    return labels, counts, sums, balls


_KINDS = {"points": np.int32, "start": np.int32, "end": np.int32, "right": np.int32, "radius": np.float64, "sums": np.int64}


def _grow(dim: int):
    """A row for each tree, of up to TREE vectors that follow each other in a partition."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                x = np.asarray(pc.list_flatten(part.column("x")), np.float64).reshape(-1, dim)
                order, tree = build(np.floor(SCALE * x).astype(np.int64))
                ids = part.column("vec_id").take(pa.array(order))
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                columns = [pa.array([v.astype(_KINDS[k]).tobytes()], pa.binary()) for k, v in tree._asdict().items()]
                yield pa.RecordBatch.from_arrays([held, *columns], ["ids", *Tree._fields])

    return run


def _trees(batch: pa.RecordBatch, dim: int):
    for i in range(batch.num_rows):
        raw = {k: np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in _KINDS.items()}
        yield batch.column("ids")[i].values, Tree(raw["points"].reshape(-1, dim).astype(np.int64), raw["start"], raw["end"], raw["right"], raw["radius"], raw["sums"].reshape(-1, dim))


def _sums(centroids: np.ndarray):
    """(cluster, n, sums) of a partition's vectors: one row for each cluster met."""

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, tree in _trees(batch, centroids.shape[1]):
                _, n, s, _ = assign(tree, centroids)
                counts += n
                sums += s
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _labelled(centroids: np.ndarray):
    """(vec_id, cluster, distance) of each vector."""

    def run(batches):
        for batch in batches:
            for ids, tree in _trees(batch, centroids.shape[1]):
                labels = assign(tree, centroids)[0]
                off = tree.points - centroids[labels]
                yield pa.RecordBatch.from_arrays([ids, pa.array(labels, pa.int32()), pa.array((off * off).sum(axis=1))], ["vec_id", "cluster", "distance"])

    return run


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x array<double>): the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < TOO_LARGE))
    return vectors.where(F.coalesce(good, F.lit(False))).select("vec_id", x.alias("x"))


@whole
def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of vectors (vec_id, embedding).

    Vectors of another length, or with null, non-finite or too large (TOO_LARGE)
    components, are left out. Of equal hashes of ids the least vector starts as
    the smaller number; null ids start last. With fewer than k vectors there are
    as many centroids as vectors. Repeated rows count as often as they stand
    there. A sum of distances beyond a long is null. An empty table gives an
    empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = kept(vectors.select("vec_id", "embedding"), dim)
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    whole_x = F.transform("x", lambda v: F.floor(v * SCALE).cast("bigint"))
    first = rows.select(name.alias("name"), whole_x.alias("v")).orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    kind = rows.schema["vec_id"].dataType
    found = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    facts = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], found).join(spark.createDataFrame([], facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    tree = T.StructType([T.StructField("ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in Tree._fields]])
    trees = staged(rows.mapInArrow(_grow(dim), tree), "trees")
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        part = trees.mapInArrow(_sums(centroids), "cluster int, n bigint, sums array<bigint>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
        of = part.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k x dim rows
        moved = centroids.copy()
        for r in of:
            moved[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
        centroids = moved
    out = staged(trees.mapInArrow(_labelled(centroids), found), "labelled")
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}  # k rows
    total = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    each = spark.createDataFrame([(c, d, total, digests[c]) for c, d in inertia.items()], facts)
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast


def _clusters_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> str:
    nearest = """a{i} as materialized (select r, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'k': k}}) as best from kept, c{i} group by r)"""
    moved = """c{j} as materialized (
  select c{i}.k, coalesce(m.c, c{i}.c) as c from c{i} left join (
    select k, list((s - ((s % n) + n) % n) // n order by p)::bigint[] as c from (
      select best.k as k, p, sum(v[p]) as s, count(*) as n from a{i} join kept using (r), range(1, {dim} + 1) t(p) group by 1, 2) group by k) m using (k))"""
    steps = ",\n".join(f"{nearest.format(i=i)},\n{moved.format(i=i, j=i + 1, dim=dim)}" for i in range(rounds))
    return f"""with kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (select n - 1 as k, v as c from (select row_number() over (order by sha256('2:' || vec_id) nulls last, v) as n, v from kept) where n <= {k}),
{steps},
{nearest.format(i=rounds)},
sums as (select best.k as k, sum(best.d)::bigint as t from a{rounds} group by 1)
select vec_id, best.k::int as cluster, best.d as distance, t as cluster_inertia, (select sum(t)::bigint from sums) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join kept using (r) join sums on sums.k = best.k join c{rounds} on c{rounds}.k = best.k"""


CLUSTERS_SQL = _clusters_sql()
