"""A content-addressed web archive.

Two Parquet tables in one folder: ``payloads`` holds the bytes of every different payload once, compressed, under
their SHA-256; ``records`` holds every record's exact WARC header and the digest that its payload has. Reading
joins the two to the original WARC records, byte by byte, and checks every payload against its digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, join_spread, scratch_dir

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, payloads = batch.columns
        data = payloads.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [ids, urls, pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), pa.array([sha1_of(x) for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64())],
            names=["page_id", "url", "digest", "sha1", "payload_bytes"],
        )


def sha1_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), pa.array([zlib.compress(x, 1) for x in data], pa.binary())], names=["owner", "digest", "payload"])


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _header(refers: Column) -> Column:
    """The record's header block, from WARC/1.1 to the empty line; a url's line breaks are percent-encoded."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = refers.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _uri(refers)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def _payloads(pages: DataFrame) -> DataFrame:
    return pages.withColumn("payload", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).withColumn("page_id", F.col("page_id").cast("long"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archive every row of ``pages`` (page_id, url, html) in folder ``path``.

    Null html is an empty payload. Of records with equal payloads of at least ``min_bytes`` the one with the
    largest page_id is the response and the others revisit it; smaller payloads are all responses. A page_id
    that occurs again with the same payload is archived once more as a response of its own. Rows with a null
    page_id revisit as well; where no row of a payload has one they are all responses, with the record id "none".
    Payload bytes are written once for each digest, compressed; an empty table gives an empty archive; further
    columns are not read.
    """
    pages = _payloads(pages)
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), "payload").mapInArrow(_digests, "page_id long, url string, digest binary, sha1 string, payload_bytes long")
    staged = Staged(pages.sparkSession, "warc")
    narrow = staged.put(narrow, "digests")
    owners = staged.put(narrow.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("_rows")), "owners")
    refers = F.when((F.col("payload_bytes") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    join_spread(narrow, owners, "digest").select("digest", _header(refers).cast("binary").alias("header")).write.parquet(f"{path}/records")
    # the owner's row brings the bytes; join and deduplication share their keys, so that the bytes are dealt out once
    named = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    keep = owners.select(named(F.col("owner")).alias("owner"), "digest")
    bodies = pages.select(named(F.col("page_id")).alias("owner"), "payload").mapInArrow(_packed, "owner string, digest binary, payload binary")
    bodies.join(keep, ["owner", "digest"]).dropDuplicates(["owner", "digest"]).select("digest", "payload").write.parquet(f"{path}/payloads")
    staged.drop()


def parse_record(record: bytes) -> dict:
    """Header, header fields and block of a record."""
    end = record.index(b"\r\n\r\n") + 4
    lines = [x.partition(b": ") for x in record[: end - 4].split(b"\r\n")[1:]]
    field = {name.decode(): value.decode("utf-8", "replace") for name, _, value in lines}
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    size = int(field["Content-Length"])
    return {
        "header": record[:end], "block": record[end : end + size], "whole": record[end + size :] == (CRLF * 2).encode(), "record_type": field["WARC-Type"], "url": field["WARC-Target-URI"],
        "page_id": number(field["WARC-Record-ID"]), "refers_to": number(field.get("WARC-Refers-To")), "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of headers, with payloads where they are responses."""
    for batch in batches:
        header, payload = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        records = [h + (zlib.decompress(p) if p is not None else b"") + (CRLF * 2).encode() for h, p in zip(header, payload, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(records, pa.binary())], names=["digest", "record"])


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The original WARC records: digest, record (header, block of responses, two line ends)."""
    records = spark.read.parquet(f"{path}/records")
    full = F.col("header").cast("string").contains(f"{CRLF}WARC-Type: response{CRLF}")
    payloads = spark.read.parquet(f"{path}/payloads")
    whole = records.filter(full).join(payloads, "digest", "left").select("digest", "header", F.coalesce("payload", F.lit(zlib.compress(b""))).alias("payload"))
    every = whole.unionByName(records.filter(~full).withColumn("payload", F.lit(None).cast("binary")))
    return every.mapInArrow(_rebuilt, "digest binary, record binary")


ROW = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, verified boolean, digest binary, header binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each record says; a response is checked against both digests."""
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "verified": pa.bool_(), "digest": pa.binary(), "header": pa.binary()}
    for batch in batches:
        out = []
        for digest, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r = parse_record(record)
            ok = r["whole"] and (r["record_type"] != "response" or (hashlib.sha256(r["block"]).digest() == digest and sha1_of(r["block"]) == r["payload_digest"]))
            out.append(r | {"digest": digest, "payload_bytes": len(r["block"]), "verified": ok})
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds.get(n, pa.string())) for n in names], names=names)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record as it is rebuilt from its header and payload: page_id, url, record_type, refers_to, payload_digest, payload_bytes, verified, digest, header.

    A revisit has the size of its payload, and is verified if a response with that payload is and their digests agree.
    """
    staged = Staged(spark, "warc")
    rows = staged.put(warc_records(spark, path).mapInArrow(_read, ROW), "rows")
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type <> 'response'")
    counts = revisits.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows"))
    facts = responses.groupBy("digest").agg(F.max("payload_bytes").alias("_bytes"), F.min("payload_digest").alias("_sha1"), F.bool_and("verified").alias("_ok")).join(counts, "digest")
    again = join_spread(revisits, staged.put(facts, "facts"), "digest")
    again = again.withColumns({"payload_bytes": F.col("_bytes"), "verified": F.col("verified") & F.col("_ok") & (F.col("_sha1") == F.col("payload_digest"))})
    return responses.unionByName(again.select(*responses.columns))


def archive_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/quill-{uuid.uuid4().hex}/archive"


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT html, max(page_id) AS owner FROM p GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o USING (html)
"""
