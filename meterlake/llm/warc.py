"""Content-addressed WARC archive.

An archive is a folder with two tables. `payloads` holds every distinct payload
once, compressed, under its SHA-256. `headers` holds the exact bytes of each
record's WARC and HTTP headers and, where the record has a payload block, its
digest. Joining the two gives the original records byte for byte; each payload
is hashed again when it is read.

Payloads shorter than 100 bytes always make a response. Of longer equal
payloads the record with the smallest page_id is the response and the others
revisit it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, whole

#: Shorter payloads are never revisited.
LEAST_REVISIT = 100
#: Rows of an array that equal rows are spread from.
RUN = 10_000
DATE = "2024-01-01T00:00:00Z"


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("size"), pa.array((squeeze.compress(x.as_buffer()) for x in batch.column("payload")), pa.binary())],
            ["digest", "size", "packed"],
        )


def _header(pages: DataFrame) -> DataFrame:
    """(digest, header): the exact header bytes of each page's record; digest is null where the record has no payload block.

    Equal rows are counted before they are joined with the first of their
    payload, and spread again behind the join, RUN at a time.
    """
    # Digests are shuffled as bytes, half as long as their digits.
    counted = pages.withColumn("digest", F.unhex("digest")).groupBy("digest", "size", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("url").isNull().alias("homeless"), "url", "n")
    first = counted.groupBy("digest").agg(F.min(F.when(F.col("size") >= LEAST_REVISIT, order)).alias("first")).where("first is not null")
    joined = counted.join(first, "digest", "left").withColumns({"first_id": F.col("first.page_id"), "digest": F.lower(F.hex("digest"))})
    runs = joined.withColumn("run", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("n") - 1, F.lit(RUN)))))
    known = runs.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN)))).withColumn("nth", F.col("run") * RUN + F.col("nth"))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("nth") == 1)
    revisit = F.col("first").isNotNull() & ~is_first
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    warc = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("first_id")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
    )
    return known.select(F.when(~revisit, F.col("digest")).alias("digest"), F.encode(F.concat(warc, http), "UTF-8").alias("header"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as an archive folder.

    Null html is an empty payload, a null url leaves out the target URI, a null
    page_id leaves the record's name empty and counts as larger than any. Of
    rows that tie for the smallest page_id of a payload the one with the
    smallest url is the response (null last; of equal rows, any one), the others
    revisit it. page_id is an integer. Other columns are ignored.
    """
    facts = pages.select("page_id", "url", F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("bigint").alias("size"))
    _header(facts).write.option("compression", "zstd").parquet(f"{path}/headers")
    packed = pages.select(F.sha2(_payload(), 256).alias("digest"), F.octet_length(_payload()).cast("bigint").alias("size"), _payload().alias("payload"))
    packed = packed.mapInArrow(_pack, "digest string, size bigint, packed binary")
    once = packed.groupBy("digest").agg(F.min("size").alias("size"), F.max("size").alias("size2"), F.first("packed").alias("packed"))
    safe = once.withColumn("size", F.when(F.col("size") == F.col("size2"), F.col("size")).otherwise(F.raise_error(F.lit("payloads of one digest differ in length")).cast("bigint")))
    safe.drop("size2").write.option("compression", "uncompressed").parquet(f"{path}/payloads")


def parse_record(record: bytes) -> dict:
    """The named fields and the block of one WARC record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
    fields["block"] = block[: int(fields["content-length"])]
    if block[len(fields["block"]) :] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where its Content-Length says")
    return fields


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _restore(batches):
    loose = zstandard.ZstdDecompressor()
    for batch in batches:
        out = {"record": [], "page_id": [], "url": [], "record_type": [], "refers_to": [], "payload_digest": [], "payload_bytes": []}
        for digest, header, packed, size in zip(*(batch.column(c).to_pylist() for c in ("digest", "header", "packed", "size")), strict=True):
            payload = b""
            if digest is not None:
                if packed is None:
                    raise ValueError(f"no payload for {digest}")
                payload = loose.decompress(packed, max_output_size=size or 1)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload stored for {digest} has another digest")
            record = header + payload + b"\r\n\r\n"
            fields = parse_record(record)
            body = fields["block"].partition(b"\r\n\r\n")[2]
            full = fields["warc-type"] == "response"
            out["record"].append(record)
            out["page_id"].append(_page(fields["warc-record-id"]))
            out["url"].append(fields.get("warc-target-uri"))
            out["record_type"].append(fields["warc-type"])
            out["refers_to"].append(_page(fields.get("warc-refers-to")))
            out["payload_digest"].append(hashlib.sha256(body).hexdigest() if full else fields["warc-payload-digest"].removeprefix("sha256:"))
            out["payload_bytes"].append(len(body) if full else None)
        types = {"record": pa.binary(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in out.items()], list(out))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record binary, page_id, url, record_type, refers_to, payload_digest, payload_bytes) of an archive folder.

    record is the original record, rebuilt by a join and parsed again. A
    revisit's payload_bytes is null: its payload is in the record it refers to.
    Payloads travel compressed.
    """
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, size bigint, packed binary").parquet(f"{path}/payloads")
    joined = headers.where("digest is not null").join(payloads, "digest", "left").select("digest", "header", "packed", "size")
    revisits = headers.where("digest is null").select("digest", "header", F.lit(None).cast("binary").alias("packed"), F.lit(None).cast("bigint").alias("size"))
    return joined.union(revisits).mapInArrow(_restore, "record binary, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint")


@whole
def archive_report(pages: DataFrame) -> DataFrame:
    """Writes an archive of pages to the shared folder, reads it back and gives the contract's columns. The archive is deleted once they are written."""
    spark = pages.sparkSession
    path = new_folder(spark, "archive")
    write_archive(pages, path)
    facts = read_archive(spark, path).drop("record", "url")
    whole = facts.where("record_type = 'response'")
    sizes = whole.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    again = facts.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left")
    return whole.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, payload_bytes >= 100 AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS first_id
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM f
"""
