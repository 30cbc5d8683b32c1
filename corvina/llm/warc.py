"""WARC archives: written from pages, read back, and assembled to one nested row a capture.

Each page gives a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata name the
response in WARC-Concurrent-To. Records are text, so Spark's text writer makes the archives with the records' separator
as its line end: distributed, committed by Spark's protocol, to any store, of files bounded by the pages' mean size. The reader takes the files whole
through Spark, unpacks each in a worker and goes from record to record by Content-Length, so a payload may hold anything.
Assembly joins the records on their identifiers; a revisit's original is looked up by WARC-Refers-To, many to one, as a plain
equi-join whose skewed side adaptive execution splits. Equal payloads are found by digest and length, counted before the
shuffle, and bodies never move: only the ids of revisits are joined to the pages.

Defined cases: a null html is an empty payload; a null url is empty; CR and LF in a url are percent-encoded; with a null page_id a
page is a response by itself; pages that repeat a page_id are captures of their own (identifiers carry the payload's digest, and exact
repeats of page and payload give equal rows); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm._base import Scratch, small

END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "id string, type string, concurrent_to string, refers_to string, uri string, date string, payload_digest string, payload_bytes long, page_id long, payload string, whole boolean"


def sha1_base32(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the UTF-8 bytes: each 20 bits, five hexadecimal digits, make four characters."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(text.cast("binary")), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, DIGITS, BASE32)


def urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [x for name, value in fields for x in (F.lit(f"\r\n{name}: "), value)]
    return F.concat(F.lit("WARC/1.0"), *lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", file_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    """Archives of the pages (page_id, url, html). Among equal payloads of at least min_bytes the largest page_id is the response.

    A file has as many records as make about ``file_bytes`` at the pages' mean size, before it is packed.
    """
    p = pages.select(
        F.col("page_id").cast("long"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"digest": sha1_base32(F.col("html")), "n": F.octet_length("html")})
    made = scratch.save(p.select("page_id", "digest", "n"))
    records_per_file = 3 * max(1, file_bytes // (int(made.agg(F.avg("n")).first()[0] or 0) + 1200))  # a page's headers have some 1,200 bytes
    keys = made.where(f"page_id is not null and n >= {min_bytes}")
    equal = scratch.save(keys.groupBy("digest", "n").agg(F.max("page_id").alias("original"), F.min("page_id").alias("first")).where("first < original"))
    again = scratch.save(keys.join(equal, ["digest", "n"]).where("page_id < original").select("page_id", F.col("digest").alias("same"), "original").distinct())
    rows = p.join(small(again, 250_000), (p["page_id"] == again["page_id"]) & (p["digest"] == again["same"]), "left").drop(again["page_id"])
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rid, original = urn(F.lit("response"), page, "digest"), F.col("original").cast("string")
    common = lambda kind, own: [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    to, digest = [("WARC-Concurrent-To", rid)], [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))]
    kind = lambda x: [("Content-Type", F.lit(x))]
    request = record(common(F.lit("request"), urn(F.lit("request"), page, "digest")) + to + kind("application/http;msgtype=request"), F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1" + END)))
    response = record(common(F.lit("response"), rid) + digest + kind("application/http;msgtype=response"), F.concat(http, "html"))
    revisit = record(common(F.lit("revisit"), rid) + digest + [("WARC-Profile", F.lit(REVISIT)), ("WARC-Refers-To", urn(F.lit("response"), original, "digest"))] + kind("application/http;msgtype=response"), http)
    metadata = record(common(F.lit("metadata"), urn(F.lit("metadata"), page, "digest")) + to + kind("application/warc-fields"), F.concat(F.lit("page-id: "), page, F.lit("\r\n")))
    out = rows.select(F.explode(F.array(request, F.when(F.col("original").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, packed or not. Damage raises."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    stream = io.BufferedReader(stream, 1 << 16)
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        if len(block := stream.read(n)) != n:
            raise ValueError("a WARC record ends early")
        yield fields, block


def parsed(bodies: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for n, x in zip(names, RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out: list[tuple] = []
                held = 0
                for f, block in records(content.as_py()):
                    kind, page, digest, n, body, whole = f["warc-type"], None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, None, None, None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        n = int(head.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        if kind == "response":
                            whole = len(body) == n and base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                    elif kind == "metadata":
                        given = block.decode().partition("page-id:")[2].strip()
                        page = int(given) if given else None
                    body = body.decode() if bodies and kind == "response" else None
                    out.append((f["warc-record-id"], kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), digest, n, page, body, whole))
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def read(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """One row for each record (RECORD); whole: a response's payload has the length and digest that are declared."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed(bodies), RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, page_id, request, response, metadata, refers_to (page of the original)."""
    captured = recs.where("type in ('response', 'revisit')").select("id", F.struct("type", "uri", "date", "payload_digest", "payload_bytes", "payload", "whole", "refers_to").alias("response"))
    request = recs.where("type = 'request'").select(F.col("concurrent_to").alias("id"), F.struct(F.col("id"), "uri", "date").alias("request"))
    metadata = recs.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct(F.col("id"), "page_id", "date").alias("metadata"))
    request, metadata = request.dropDuplicates(["id"]), metadata.dropDuplicates(["id"])  # captures of equal page and payload share them
    joined = captured.join(request, "id", "left").join(metadata, "id", "left")
    joined = joined.withColumn("target", F.coalesce("response.refers_to", F.concat(F.lit("none "), "id")))  # without a null key that would bring all others together
    named = joined.join(metadata.select(F.col("id").alias("target"), F.col("metadata.page_id").alias("original")), "target", "left")
    return named.select(F.col("id").alias("capture_id"), F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata", F.col("original").alias("refers_to"))
