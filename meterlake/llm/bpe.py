"""Byte-level BPE: a global shuffle of distinct words, and decoding by a join with the token-byte table.

Encoding cuts texts into pre-tokens. A chunk of texts keeps, for each text,
the numbers of its pre-tokens, in order, in the chunk's own list of distinct
words. The lists are cut in buckets by a hash of the word and shuffled by
bucket, so that each distinct word of the corpus is encoded once. The ids go
back to their chunks, where the positions put them in order.

A frequent word meets once for each chunk, not once for each place, so no word
is hot. Words, numbers and ids travel packed and compressed, as they are many
and small. A chunk's size is bounded, and so is everything a task holds.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged

#: Pre-tokens of a chunk, about.
CHUNK_TOKENS = 6_000_000
MAX_CHARS = 1_000_000


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, as the rank file lists them."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes by id. Its size is the vocabulary's, which is fixed."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    return regex.compile(pattern)


def _chunked(fields: list[str], pattern: str, buckets: int):
    """Documents to rows of packs (kind 0: documents, their token counts, their word numbers) and of words (kind 1: numbers, lengths, bytes of a bucket's words)."""

    def run(batches):
        split, task, made = _splitter(pattern), TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3).compress
        number: dict[str, int] = {}
        held: list[tuple] = []
        tokens = 0

        def close():
            """A chunk's rows. Frequent words get the low numbers, which take the fewest bytes."""
            nonlocal number, held, tokens, made
            chunk = task << 24 | made
            counts = np.zeros(len(number), np.int64)
            for _, _, at in held:
                counts += np.bincount(at, minlength=len(number))
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(number), np.uint32)
            rank[order] = np.arange(len(number), dtype=np.uint32)
            for part, sizes, at in held:
                rows = pa.StructArray.from_arrays([part.column(f) for f in fields], fields)
                yield _row(rows.type, chunk, 0, 0, rows, b"", squeeze(_squeeze(sizes)), squeeze(_squeeze(rank[at])))
            words = [w.encode("utf-8", "surrogatepass") for w in number]
            of = np.array([crc32(w) % buckets for w in words], np.int64)[order]
            by = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[by], np.arange(buckets + 1))
            kind = held[0][0].schema if held else None
            nothing = pa.StructArray.from_arrays([pa.array([], kind.field(f).type) for f in fields], fields)
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                ranks = by[cuts[bucket] : cuts[bucket + 1]]
                own = [words[i] for i in order[ranks].tolist()]
                sizes = np.array([len(w) for w in own], np.uint32)
                yield _row(nothing.type, chunk, 1, bucket, nothing, squeeze(_squeeze(np.diff(ranks, prepend=0).astype(np.uint32))), squeeze(_squeeze(sizes)), squeeze(b"".join(own)))
            number, held, tokens, made = {}, [], 0, made + 1

        for batch in batches:
            for part, texts in slices(batch, "text", MAX_CHARS):
                at = [np.array([number.setdefault(w, len(number)) for w in split.findall(t)], np.uint32) for t in texts]
                sizes = np.array([len(x) for x in at], np.uint32)
                held.append((part.select(fields), sizes, np.concatenate(at)))
                tokens += int(sizes.sum())
                if tokens >= CHUNK_TOKENS:
                    yield from close()
                    pa.default_memory_pool().release_unused()
        if held:
            yield from close()

    return run


def _row(kind: pa.DataType, chunk: int, what: int, bucket: int, docs: pa.StructArray, *data: bytes) -> pa.RecordBatch:
    rows = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([what], pa.int32()), pa.array([bucket], pa.int32()), rows, *[pa.array([d], pa.binary()) for d in data]], ["chunk", "kind", "bucket", "docs", "ranks", "sizes", "data"])


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers in one, two or four bytes each: the low bytes, then a plane of the next, so far as any is needed."""
    low = (x & np.uint32(0x7F)).astype(np.uint8)
    more = x > 0x7F
    rest = x[more] >> np.uint32(7)
    low[more] |= 0x80
    mid = (rest & np.uint32(0x7F)).astype(np.uint8)
    top = rest > 0x7F
    mid[top] |= 0x80
    high = (rest[top] >> np.uint32(7)).astype("<u2")
    return np.array([len(x), len(mid)], "<u4").tobytes() + low.tobytes() + mid.tobytes() + high.tobytes()


def _stretch(data: bytes) -> np.ndarray:
    """What _squeeze was given."""
    n, m = np.frombuffer(data, "<u4", 2)
    low, mid = np.frombuffer(data, np.uint8, n, 8), np.frombuffer(data, np.uint8, m, 8 + n)
    high = np.frombuffer(data, "<u2", -1, 8 + n + m) if len(data) > 8 + n + m else np.zeros(0, np.uint16)
    rest = (mid & 0x7F).astype(np.uint32)
    rest[mid > 0x7F] |= high.astype(np.uint32) << np.uint32(7)
    out = (low & 0x7F).astype(np.uint32)
    out[low > 0x7F] |= rest << np.uint32(7)
    return out


def _encode_words(path: str, pattern: str):
    """Rows sorted by bucket: words to ids, each distinct word of a bucket encoded once."""

    def run(batches):
        enc, now, known = encoder(path, pattern), None, {}
        squeeze, loose = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column("bucket")[i].as_py()
                if bucket != now:
                    now, known = bucket, {}
                sizes, data = _stretch(loose(batch.column("sizes")[i].as_py())), loose(batch.column("data")[i].as_py())
                ends = np.cumsum(sizes).tolist()
                ids = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    word = data[a:b]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = enc.encode_ordinary(word.decode("utf-8", "surrogatepass"))
                    ids.append(found)
                out = [squeeze(_squeeze(np.array([len(x) for x in ids], np.uint32))), squeeze(np.array([y for x in ids for y in x], _kind(enc)).tobytes())]
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), batch.column("ranks").slice(i, 1), *[pa.array([x], pa.binary()) for x in out]], ["chunk", "ranks", "sizes", "data"])

    return run


def _kind(enc: tiktoken.Encoding) -> str:
    return "<u2" if enc.n_vocab <= 1 << 16 else "<u4"


def _word_ids(coded: list[tuple[bytes, bytes, bytes]], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words' ids, and for the word of each number where they start and how many they are."""
    loose = zstandard.ZstdDecompressor().decompress
    parts = [[loose(x) for x in column] for column in zip(*coded, strict=True)] or [[], [], []]
    ranks = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(_stretch(x).astype(np.int64)) for x in parts[0]]])
    lengths = np.concatenate([np.zeros(0, np.int64), *[_stretch(x).astype(np.int64) for x in parts[1]]])
    starts, sizes = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
    starts[ranks], sizes[ranks] = np.cumsum(lengths) - lengths, lengths
    return np.frombuffer(b"".join(parts[2]), kind), starts, sizes


def _reassemble(fields: list[str], path: str, pattern: str):
    """Rows sorted by chunk, its words' ids before its packs, to documents with ids in order. One chunk's ids and one pack are held at a time."""

    def run(batches):
        loose = zstandard.ZstdDecompressor().decompress
        now, coded, found = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind, rows, ranks, counts, data = (batch.column(c)[i] for c in ("chunk", "kind", "docs", "ranks", "sizes", "data"))
                if chunk.as_py() != now:
                    now, coded, found = chunk.as_py(), [], None
                if kind.as_py() == 1:
                    coded.append((ranks.as_py(), counts.as_py(), data.as_py()))
                    continue
                if found is None:
                    coded, found = [], _word_ids(coded, _kind(encoder(path, pattern)))
                ids, starts, sizes = found
                at = _stretch(loose(data.as_py()))
                n = sizes[at]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                flat = ids[np.repeat(starts[at] - ends + n, n) + np.arange(total)].astype("<u4").tobytes()
                stops = np.cumsum(_stretch(loose(counts.as_py())).astype(np.int64))
                stops = (4 * np.concatenate(([0], ends))[stops]).tolist()
                out = pa.array([flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.values.flatten(), out], [*fields, "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs without text, plus ids binary: the tokens as little-endian unsigned 32-bit integers.

    Null text counts as empty and has no ids. Special tokens' strings are
    ordinary text. Every row is encoded, repeated ones too. A column called ids
    is replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rest = [f for f in docs.schema.fields if f.name not in ("text", "ids")]
    fields = [f.name for f in rest]
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("docs", T.ArrayType(T.StructType(rest)))])
    for c in ("ranks", "sizes", "data"):
        schema = schema.add(c, T.BinaryType())
    chunks = staged(docs.select(*fields, "text").mapInArrow(_chunked(fields, pattern, buckets), schema), "chunks")
    words = chunks.where("kind = 1").select("chunk", "bucket", "ranks", "sizes", "data")
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(path, pattern), "chunk bigint, ranks binary, sizes binary, data binary")
    packs = chunks.where("kind = 0").drop("bucket")
    both = packs.unionByName(coded.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = T.StructType([*rest, T.StructField("ids", T.BinaryType())])
    return both.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind")).mapInArrow(_reassemble(fields, path, pattern), out)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded plus decoded binary: each row's ids joined with the token-byte table, which every task holds whole. A column called decoded is replaced."""
    coded = coded.drop("decoded")
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                part = batch.slice(at, 64)
                out = [b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])
                at += 64

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def token_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for each document."""
    done = decode(encode(docs.select("doc_id", "text")))
    return done.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
