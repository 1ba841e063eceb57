"""WARC archives without repeated payloads: revisit records instead of copies.

Only headers meet by payload digest: equal payloads are counted per digest with
map-side combination, so a payload that a third of all records share is one row
per task.  Archives are written by Spark's text writer, one record per row: a
WARC record ends with an empty line pair, which is the writer's separator, and
its payload is UTF-8.  The writer commits whole tasks, so a lost executor leaves
no half archive.  Each file holds at most ``FILE_RECORDS`` records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import plain_text, shared_path, stored

MIN_BYTES = 1000
FILE_RECORDS = 5000
DATE = "2024-01-01T00:00:00Z"
#: What the WARC format prescribes.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def page_headers(pages: DataFrame) -> DataFrame:
    """(page_id, uri, payload, payload_digest, payload_bytes); a null html is an empty payload."""
    payload = plain_text("html")
    return pages.select(
        "page_id", F.regexp_replace("url", r"[\r\n]+", " ").alias("uri"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )


def resolve_copies(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``original_id`` and ``original_uri`` to records that repeat a payload; null for those that keep theirs.

    Of equal payloads of at least ``min_bytes`` the record with the largest id
    keeps it (all rows that repeat this id do).  A group whose ids are all null
    has no original and keeps every payload.
    """
    groups = (
        records.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("original_id"), F.max_by("uri", "page_id").alias("original_uri"))
        .filter("n > 1 AND original_id IS NOT NULL").drop("n")
    )
    originals = stored(groups, "warc-originals")  # read back, so that its size decides how it is joined
    joined = records.join(originals, ["payload_digest", "payload_bytes"], "left")
    own = F.col("page_id").eqNullSafe(F.col("original_id"))
    return joined.withColumn("original_uri", F.when(~own, F.col("original_uri"))).withColumn(
        "original_id", F.when(~own, F.col("original_id"))
    )


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.lit(">"))


def record_text(date: str = DATE) -> Column:
    """A whole WARC record, but for the empty lines that end it."""
    revisit = F.col("original_id").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn("page_id")), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _line("WARC-Refers-To", F.when(revisit, _urn("original_id"))),
        _line("WARC-Refers-To-Target-URI", F.col("original_uri")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """Gzip-compressed archives in the folder ``path``."""
    (
        resolved.select(record_text(date).alias("value")).write
        .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )


def parse_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record in a stream of bytes."""
    held = bytearray()

    def more() -> bool:
        data = next(blocks, None)
        held.extend(data or b"")
        return data is not None

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = held[:cut].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start, size = cut + 4, int(headers["Content-Length"])
        while len(held) < start + size + len(END):
            if not more():
                raise ValueError("truncated WARC record")
        yield headers, bytes(held[start : start + size])
        del held[: start + size + len(END)]


def _unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    while data:
        stream = zlib.decompressobj(wbits=31)
        while data and not stream.eof:
            yield stream.decompress(data, step)
            data = stream.unconsumed_tail
        data = stream.unused_data


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: record_id, record_type, uri, digest, refers_to, payload_digest, payload_bytes, payload.

    ``digest`` is what the header says; ``payload_digest`` and ``payload_bytes``
    are taken from the payload itself, and null for revisits.  ``payload`` is
    null for them and where ``payloads`` is false.
    """
    columns = ["record_id", "record_type", "uri", "digest", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for headers, block in parse_records(_unzipped(content)):
                    payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                    rows.append((
                        headers["WARC-Record-ID"], headers["WARC-Type"], headers.get("WARC-Target-URI"),
                        headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers.get("WARC-Refers-To"),
                        None if payload is None else hashlib.sha1(payload).hexdigest(), None if payload is None else len(payload),
                        payload if payloads else None,
                    ))
                    held += len(block) if payloads else 200
                    if held > 1 << 23:
                        yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(
        parse,
        "record_id string, record_type string, uri string, digest string, refers_to string, payload_digest string, payload_bytes long, payload binary",
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Gives revisit records the payload digest and length of the response they refer to, joined by digest and id."""
    originals = (
        records.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("digest"))
        .agg(F.max("payload_bytes").alias("original_bytes"))
    )
    plain = ["record_id", "record_type", "uri", "refers_to", "payload_digest", "payload_bytes"]
    revisits = records.filter("record_type = 'revisit'").join(originals, ["refers_to", "digest"], "left")
    return records.filter("record_type = 'response'").select(plain).unionByName(
        revisits.select("record_id", "record_type", "uri", "refers_to", F.col("digest").alias("payload_digest"), F.col("original_bytes").alias("payload_bytes"))
    )


def _page_id(urn: str) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as deduplicated archives below ``path``, read them back and return a row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to.
    Needs ``page_id``, ``url`` and ``html``.  A null html is empty, a null url
    leaves its header out, line breaks in urls become a space, a null id comes
    back as null.  Rows that repeat an id are records of their own.  No page, no
    record and no row.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(resolve_copies(page_headers(pages), min_bytes), path)
    records = resolve_revisits(stored(read_archives(spark, path, payloads=False).drop("payload"), "warc-headers"))
    return records.select(
        _page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page_id("refers_to").alias("refers_to")
    )
