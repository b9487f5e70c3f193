"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a filter over the n-grams that are at home in it. The
filters lie side by side: a slot holds one bit for each language, so ANDing an
n-gram's slots gives all languages that contain it at once. A language scores
the share of a text's n-grams that have its bit, less what the filter's false
positives add to it; the greatest score decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

#: Lengths of the n-grams.
SIZES = (3, 4)
#: Slots that an n-gram sets, and slots for each n-gram of the fullest filter.
PROBES, ROOM = 2, 32
#: Hash ranges of a language's ids that are counted: 2**RANGE_BITS.
RANGE_BITS = 12
#: Distinct labelled rows of a language that are learned from, at most about: those whose hashes of id and text are smallest.
MOST_ROWS = 3000
#: An n-gram is at home in a language if it was met so often there (or as often as any, where a language's none was), at this part of its highest rate in any language.
LEAST_COUNT, AT_HOME = 3, 0.25
#: Characters that are worked on at once.
MAX_CHARS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PROBE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _pieces(text: str, most: int) -> Iterator[str]:
    """A text in pieces that end at blanks, as far as it has any; no n-gram goes across a blank."""
    while len(text) > most:
        cut = text.rfind(" ", 0, most) + 1 or most
        yield text[:cut]
        text = text[cut:]
    yield text


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text numbers) of the n-grams of each size: those of runs of letters, lower-cased, with a blank at both ends of a run."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1] | (owner[1:] != owner[:-1])
    if len(keep):
        keep[0] = True
    codes, owner, blank = codes[keep].astype(np.uint64), owner[keep], blank[keep]
    for n in SIZES:
        m = max(0, len(codes) - n + 1)
        ok = owner[:m] == owner[n - 1 : n - 1 + m]
        for k in range(1, n - 1):
            ok &= ~blank[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h ^= codes[at + k]
            h *= _MIX
            h ^= h >> np.uint64(31)
        yield h, owner[at]


@dataclass
class Model:
    """langs: the learned ones, the most frequent first. slots: one array for each 64 of them. wrong: each filter's rate of false positives."""

    langs: list[str]
    slots: list[np.ndarray]
    bits: int
    wrong: np.ndarray

    def contained(self, h: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bitmask of all languages whose filters hold it, a word for each 64 languages."""
        shift = np.uint64(64 - self.bits)
        at = [(h * p) >> shift for p in _PROBE[:PROBES]]
        out = []
        for words in self.slots:
            mask = words[at[0]]
            for a in at[1:]:
                mask = mask & words[a]
            out.append(mask)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            for p in _pieces(t, MAX_CHARS):
                parts.append(p)
                owner.append(i)
        total = np.zeros(len(texts))
        hits = np.zeros((len(self.langs), len(texts)))
        owner = np.array(owner, np.int64)
        start = 0
        while start < len(parts):
            end, held = start, 0
            while end < len(parts) and (end == start or held + len(parts[end]) <= MAX_CHARS):
                held += len(parts[end])
                end += 1
            for h, piece in grams(parts[start:end]):
                who = owner[start:end][piece]
                total += np.bincount(who, minlength=len(texts))
                for w, mask in enumerate(self.contained(h)):
                    for k in range(min(64, len(self.langs) - 64 * w)):
                        hits[64 * w + k] += np.bincount(who, weights=(mask >> mask.dtype.type(k)) & mask.dtype.type(1), minlength=len(texts))
            start = end
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        share = hits / np.maximum(total, 1)
        share = np.clip((share - self.wrong[:, None]) / (1 - self.wrong[:, None]), 0, 1)
        best = share.argmax(axis=0)
        return [self.langs[b] if n else "und" for b, n in zip(best, total, strict=True)], np.where(total > 0, share.max(axis=0), 0.0)


def _counted(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        at = 0
        for part, texts in slices(batch, "text", MAX_CHARS):
            own = langs[at : at + part.num_rows]
            at += part.num_rows
            names = sorted(set(own))
            code = np.array([names.index(x) for x in own])
            for h, who in grams(texts):
                for k, name in enumerate(names):
                    values, counts = np.unique(h[code[who] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "h", "n"])


def learn(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model from the rows of docs (doc_id, text, lang) with text and lang.

    Of each language about most_rows distinct rows at most are learned from, so
    the n-grams that reach the driver are bounded too; which rows those are
    follows hashes of id and text, so neither null nor repeated ids matter. A
    language is learned however rare it is, if its texts hold any n-gram.
    """
    rank = F.xxhash64("doc_id", "text")
    named = docs.where("lang is not null and text is not null").select("lang", rank.alias("r"), F.shiftright(rank, 64 - RANGE_BITS).alias("range"))
    # Counts of hash ranges show which ranges hold the smallest hashes, so that only those ranges' rows are ranked, however many a language has.
    before = F.sum("rows").over(Window.partitionBy("lang").orderBy("range")) - F.col("rows")
    least = named.groupBy("lang", "range").agg(F.approx_count_distinct("r").alias("rows")).withColumn("before", before).where(F.col("before") < most_rows)
    last = {r["lang"]: r["last"] for r in least.groupBy("lang").agg(F.max("range").alias("last")).collect()}
    if not last:
        return Model([], [], 1, np.zeros(0))
    of_lang = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))
    near = named.where(F.col("range") <= of_lang(last)).select("lang", "r").distinct()
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("r"))).where(F.col("n") <= most_rows)
    cuts = {r["lang"]: r["cut"] for r in ranked.groupBy("lang").agg(F.max("r").alias("cut")).collect()}
    sample = docs.where("lang is not null and text is not null").where(rank <= of_lang(cuts)).groupBy("lang", rank.alias("r")).agg(F.first("text").alias("text")).select("lang", "text")
    counts = sample.mapInArrow(_counted, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("lang")
    enough = F.col("n") >= F.least(F.lit(LEAST_COUNT), F.max("n").over(of))
    rates = counts.select("lang", "h", "n", F.sum("n").over(of).alias("all"), enough.alias("enough")).where("enough").withColumn("rate", F.col("n") / F.col("all"))
    home = rates.withColumn("most", F.max("rate").over(Window.partitionBy("h"))).withColumn("best", F.max(F.col("rate") / F.col("most")).over(of))
    home = home.where(F.col("rate") / F.col("most") >= F.least(F.lit(AT_HOME), F.col("best"))).select("lang", "h", "all").toPandas()
    met = home.groupby("lang")["all"].first()
    langs = sorted(met.index, key=lambda x: (-met[x], x)) or sorted(cuts)
    most = int(home.groupby("lang").size().max()) if len(home) else 1
    bits = max(10, int(np.ceil(np.log2(most * ROOM))))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= min(64, len(langs)))
    slots = [np.zeros(1 << bits, kind) for _ in range(-(-len(langs) // 64))]
    wrong = np.zeros(len(langs))
    for i, lang in enumerate(langs):
        h = home.loc[home["lang"] == lang, "h"].to_numpy().view(np.uint64)
        words, bit = slots[i // 64], kind(1 << (i % 64))
        for p in _PROBE[:PROBES]:
            words[(h * p) >> np.uint64(64 - bits)] |= bit
        wrong[i] = ((words & bit) != 0).mean() ** PROBES
    return Model(langs, slots, bits, wrong)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred (und where text is null or has no letter) and score (0 to 1); columns of these names are replaced.

    A text whose n-grams no language holds gets the most frequent language at
    score 0. Of languages with one score the more frequent wins, then the first
    by name. Only the text is looked at, whatever its length, a bounded piece at
    a time; repeated rows and ids each get their result. An empty table gives an
    empty one, and without any labelled row all are und at score 0.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", 4 * MAX_CHARS):
                lang, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out():
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
