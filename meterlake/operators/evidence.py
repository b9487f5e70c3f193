"""Evidence behind figures as trees of digests: verification, proofs of membership and differences between two states.

A member is an evidence id of a figure. Members fall into shards by the first
hex digits of their SHA-256; a shard's digest is over its sorted members, an
inner node's over those of its children, at most 16. No node holds more than
one shard's members, whatever the figure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth of the shards: 16^4 for each figure. More members need more digits.
DIGITS = 4


def arithmetic(name: str, of: str | None = None, to: str | None = None) -> str:
    """How a figure comes from its members: direct, sum, count, or converted from one unit to another."""
    if name == "converted":
        if not of or not to:
            raise ValueError("a conversion names both units")
        return f"converted from {of} to {to}"
    if name not in ("direct", "sum", "count"):
        raise ValueError(f"no arithmetic: {name}")
    return name


def members(rows: DataFrame, by: Sequence[str], evidence: str, digits: int = DIGITS) -> DataFrame:
    """(by, shard, member): distinct non-null members, as text, with their shard."""
    text = F.col(evidence).cast("string")
    return rows.where(F.col(evidence).isNotNull()).select(*by, F.left(F.sha2(text, 256), F.lit(digits)).alias("shard"), text.alias("member")).distinct()


def _over(texts: Column) -> Column:
    """A digest of an array of texts in order. Each is preceded by its length, so that no two arrays read alike."""
    return F.sha2(F.array_join(F.transform(texts, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ""), 256)


def tree(found: DataFrame, by: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """members -> (by, depth, prefix, n, digest, children): all nodes; the root has depth 0 and the prefix ''.

    children are structs of the children's prefixes and digests in order, empty
    for a shard. Each level is an aggregate of the one below it.
    """
    kids = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
    none = F.array().cast("array<struct<prefix:string,digest:string>>")
    level = found.groupBy(*by, F.col("shard").alias("prefix")).agg(F.count("*").alias("n"), _over(F.array_sort(F.collect_list("member"))).alias("digest"))
    out = level.select(*by, F.lit(digits).alias("depth"), "prefix", "n", "digest", none.alias("children"))
    for depth in range(digits - 1, -1, -1):
        level = level.groupBy(*by, F.left("prefix", F.lit(depth)).alias("up")).agg(F.sum("n").alias("n"), kids.alias("children"))
        level = level.select(*by, F.col("up").alias("prefix"), "n", node_digest(F.col("children")).alias("digest"), "children")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out


def node_digest(children: Column) -> Column:
    """An inner node's digest, from its children's (prefix, digest) in order."""
    return _over(F.transform(children, lambda c: F.concat(c["prefix"], c["digest"])))


def _same(a: str, b: str, by: Sequence[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]


def verify(claims: DataFrame, nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """claims(by, n, digest) against a tree -> (by, holds): whether a figure's members are exactly those that its claim was made of. A figure on one side only doesn't hold."""
    root = nodes.where("depth = 0").alias("r")
    both = claims.alias("c").join(root, _same("c", "r", by), "full")
    holds = F.col("c.digest").eqNullSafe(F.col("r.digest")) & F.col("c.n").eqNullSafe(F.col("r.n"))
    return both.select(*[F.coalesce(f"c.{k}", f"r.{k}").alias(k) for k in by], F.coalesce(holds, F.lit(False)).alias("holds"))


def differing(old: DataFrame, new: DataFrame, by: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """(by, shard): the shards that differ between two trees, found from the roots down: a level's nodes are compared only below nodes that differ.

    The trees should be stored tables: each level reads them again.
    """
    sides = [nodes.select(*by, "depth", "prefix", "digest", F.lit(side).alias("side")) for side, nodes in enumerate((old, new))]
    both = sides[0].unionByName(sides[1])
    open_ = None
    for depth in range(digits + 1):
        level = both.where(F.col("depth") == depth)
        if open_ is not None:
            below = [*_same("x", "o", by), F.left("x.prefix", F.lit(depth - 1)) == F.col("o.prefix")]
            level = level.alias("x").join(open_.alias("o"), below, "left_semi")
        # One digest on both sides is two rows of one value.
        found = level.groupBy(*by, "prefix").agg(F.count("*").alias("sides"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        open_ = found.where("sides < 2 or lo <> hi").select(*by, "prefix")
    return open_.withColumnRenamed("prefix", "shard")


def changed_members(old: DataFrame, new: DataFrame, shards: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, member, change): members of differing shards that were added or removed. Where both tables are stored by shard, equal shards aren't read."""
    pick = lambda x: x.alias("x").join(shards.alias("s"), [*_same("x", "s", by), F.col("x.shard") == F.col("s.shard")], "left_semi")
    both = pick(old).withColumn("side", F.lit("removed")).unionByName(pick(new).withColumn("side", F.lit("added")))
    return both.groupBy(*by, "member").agg(F.count("*").alias("sides"), F.first("side").alias("change")).where("sides = 1").drop("sides")


def proofs(nodes: DataFrame, wanted: DataFrame, by: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """wanted(by, shard) -> (by, shard, path): for each level above the shard, from the bottom, the children of its node: what someone without the tree needs to recompute the root."""
    out = wanted.select(*by, "shard").withColumn("path", F.array().cast("array<array<struct<prefix:string,digest:string>>>"))
    for depth in range(digits - 1, -1, -1):
        n = nodes.where(F.col("depth") == depth).select(*by, "prefix", "children").alias("n")
        out = out.alias("w").join(n, [*_same("w", "n", by), F.left("w.shard", F.lit(depth)) == F.col("n.prefix")]).select("w.*", "n.children")
        out = out.withColumn("path", F.concat("path", F.array("children"))).drop("children")
    return out


def proves(shard: Column, digest: Column, path: Column, root: Column) -> Column:
    """Whether a path leads from a shard's digest to a root: each level lists the digest below it under its prefix."""
    start = F.struct(shard.alias("prefix"), digest.alias("digest"), F.lit(True).alias("ok"))
    up = lambda at, kids: F.struct(F.left(at["prefix"], F.length(at["prefix"]) - 1).alias("prefix"), node_digest(kids).alias("digest"), (at["ok"] & F.exists(kids, lambda c: (c["prefix"] == at["prefix"]) & (c["digest"] == at["digest"]))).alias("ok"))
    return F.aggregate(path, start, up, lambda at: at["ok"] & (at["prefix"] == "") & (at["digest"] == root))
