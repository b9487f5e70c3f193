"""Document fingerprints: one-permutation MinHash with optimal densification.

A text's distinct 5-word shingles are hashed once. A hash's high bits name its
bin, and each bin keeps its least hash. An empty bin tries the others in an
order of its own, a permutation drawn from a hash of its number, and copies
from the first filled one. Of each bin the low 4 bits are kept, as one
hexadecimal digit; likeness corrects for digits that agree by chance.

All of it is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_text

BIN_BITS, LOW_BITS, SHINGLE = 7, 4, 5
BINS = 1 << BIN_BITS
#: Quantiles of the ids at most, between which ranges are cut evenly.
QUANTILES = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def _shingles(hashes: Column) -> Column:
    n = F.size(hashes)
    five = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, five).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def _pack(firsts: Column) -> Column:
    """The least hash of each filled bin, to one digit for each of BINS bins."""
    low = lambda x, bits: F.shiftright(x, bits).bitwiseAND(F.lit(BINS - 1))
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    digits = F.map_from_arrays(F.transform(firsts, lambda h: _bin(h).cast("int")), F.transform(firsts, lambda h: F.substring(F.lit("0123456789abcdef"), (h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)) + 1).cast("int"), F.lit(1))))
    # Exclusive or, an odd factor and a shift each permute the numbers below BINS.
    tried = lambda t, h: F.pmod(t.bitwiseXOR(low(h, 0)) * low(h, BIN_BITS).bitwiseOR(F.lit(1)) + low(h, 2 * BIN_BITS), F.lit(BINS)).cast("int")
    borrowed = lambda slots, i: let(F.xxhash64(i), lambda h: F.aggregate(every, F.lit(None).cast("string"), lambda found, t: F.coalesce(found, F.get(slots, tried(t.cast("bigint"), h)))))
    filled = lambda slots: F.array_join(F.transform(every, lambda i: F.coalesce(F.get(slots, i), borrowed(slots, i))), "")
    return let(let(digits, lambda m: F.transform(every, lambda i: F.try_element_at(m, i))), filled)


def fingerprint(text: Column) -> Column:
    """A text's fingerprint; '' where it has no word.

    Words are runs of characters other than white space, with A-Z lower-cased.
    Fewer than five words make one shingle.
    """
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    firsts = lambda s: F.filter(s, lambda h, i: F.coalesce(_bin(h) != _bin(F.get(s, i - 1)), F.lit(True)))
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: let(
            F.sort_array(_shingles(hashes)),
            lambda s: let(firsts(s), lambda f: F.when(F.size(f) > 0, _pack(f)).otherwise(F.lit(""))),
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts behind two fingerprints, 0 to 1. Two empty ones are alike; an empty one is like no other."""
    chance = 1.0 / (1 << LOW_BITS)
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))) / float(BINS)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def id_ranges(docs: DataFrame, ranges: int) -> Column:
    """A column that numbers ranges of doc_id in ascending order; null ids come first, as -1.

    Quantiles of the ids (QUANTILES at most, sent to the driver) are cut evenly
    until there are about `ranges`.
    """
    n = max(1, min(QUANTILES, ranges))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 10_000)).first()[0]
    cuts = sorted(set(cuts or [0]))
    parts = max(1, -(-ranges // max(1, len(cuts) - 1)))

    def pick(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            if hi == len(cuts):
                return F.lit(lo * parts)
            x = (F.col("doc_id").cast("double") - cuts[lo]) * (parts / max(1, cuts[hi] - cuts[lo]))
            return F.lit(lo * parts) + F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(parts - 1)).cast("int")
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], pick(lo, mid)).otherwise(pick(mid, hi))

    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(pick(0, len(cuts)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each row with its neighbour by descending doc_id; the first follows the last.

    Null text counts as empty; null ids come last; rows with equal ids stand in
    the order of their texts. Texts are shuffled once: rows go to ranges of ids,
    and each range also gets a copy of the row that follows its last.
    """
    spark = docs.sparkSession
    place = id_ranges(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", doc_text().alias("text")).withColumn("range", place)
    # The greatest id of each range that has rows: as many as there are ranges.
    heads = {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    ids = [h for h in heads.values() if h is not None]
    after = rows.where(F.col("doc_id").isin(ids)) if ids else rows.where("false")
    if -1 in heads:
        after = after.union(rows.where("doc_id is null").groupBy("doc_id", "range").agg(F.min("text").alias("text")).select("doc_id", "text", "range"))
    if order:
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        after = after.withColumn("range", F.element_at(to, F.col("range")))
    every = rows.withColumn("copy", F.lit(False)).union(after.withColumn("copy", F.lit(True))).withColumn("fp", fingerprint(F.col("text")))
    w = Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return every.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("not copy").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fp")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )
