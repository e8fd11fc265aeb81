r"""WARC archives: writing, reading, and resolving repeated payloads by revisit records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm._spark import Tables

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1000
READ = "record_id string, record_type string, uri string, page_id string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def field(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Control characters would end the line, so they are percent-encoded or dropped."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_archive(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = 8192) -> None:
    """Writes records (id, uri, payload, digest, refers_to; refers_to null: a response) as gzip-compressed WARC 1.1 files.

    Spark's text writer puts the blank lines that end a WARC record as its line separator, so files are committed as
    any other output, and a lost executor leaves no half archive. A revisit has the HTTP header only.
    """
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload")))
    key = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.coalesce(key(F.col("id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("uri")),
        field("Page-ID", F.col("id")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        field("WARC-Refers-To", key(F.col("refers_to"))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("block")),
    )
    records.withColumn("block", block).select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def inflated(content: bytes) -> Iterator[bytes]:
    """Chunks of what a gzip file of one or more members holds; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view = memoryview(content)
    while len(view):
        stream = zlib.decompressobj(31)
        at = 0
        while not stream.eof and at < len(view):
            yield stream.decompress(view[at : at + (1 << 20)])
            at += 1 << 20
        view = view[max(0, min(at, len(view)) - len(stream.unused_data)) :] if stream.eof else view[len(view) :]


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, framed by Content-Length."""
    chunks, held = inflated(content), bytearray()
    need = 0
    while True:
        while (end := held.find(b"\r\n\r\n", 4 if held[:4] == b"\r\n\r\n" else 0)) < 0 or len(held) < need:
            if (chunk := next(chunks, None)) is None:
                break
            held += chunk
        start = 4 if held[:4] == b"\r\n\r\n" else 0
        if end < 0 or not held[start : start + 5] == b"WARC/":
            return
        lines = held[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        need = end + 4 + int(head["content-length"])
        while len(held) < need:
            if (chunk := next(chunks, None)) is None:
                raise ValueError("a record ends before its Content-Length")
            held += chunk
        yield head, bytes(held[end + 4 : need])
        del held[:need]
        need = 0


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of WARC files: digests and lengths are taken from the payloads as read, for revisits the digest from the header."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.binary() if x.endswith("binary") else pa.int64() if x.endswith("long") else pa.string() for x in READ.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                size = 0
                for head, block in parsed(content.as_py()):
                    revisit = head["warc-type"] == "revisit"
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    told = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest = told if revisit else hashlib.sha1(payload).hexdigest()
                    if digest != told:
                        raise ValueError(f"{head['warc-record-id']}: its payload has the digest {digest}, its header {told}")
                    out.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("page-id"), digest, None if revisit else len(payload), head.get("warc-refers-to"), payload if payloads else None))
                    size += len(block) if payloads else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, READ)


def originals(heads: DataFrame, least: int) -> DataFrame:
    """Of headers (id, digest, bytes), the digests of at least `least` bytes that several records share, with the largest id."""
    return heads.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").drop("n")


def archive_pages(pages: DataFrame, path: str, least: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a deduplicated archive of pages and returns its records as read back, revisits resolved.

    Only headers (id, digest, length) are shuffled to find, among equal payloads of `least` bytes or more, the record
    of the largest id; it stays a response and the others become revisits of it. The table of shared digests is
    written, so that Spark knows its size when it joins it to the pages. Reading back, the revisits are joined to the
    headers of their responses to get the payload's length. Returns id, uri, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload. A record without id is never referred to, but may be a revisit. Rows that repeat
    the largest id are all responses. Extra columns are not read.
    """
    spark = pages.sparkSession
    tables = Tables(spark, "warc")
    kind = pages.schema[id_col].dataType
    payload = F.coalesce(F.col(html_col), F.lit(""))
    records = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    shared = tables.write(originals(records.select("id", "digest", "bytes"), least), "shared")
    typed = records.join(shared, ["digest", "bytes"], "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("original")), F.col("original")))
    write_archive(typed, path)
    tables.drop("shared")
    read = read_archives(spark, path).drop("payload")
    revisits = read.filter("record_type = 'revisit'")
    responses = read.filter("record_type = 'response'")
    lengths = responses.filter(F.col("payload_bytes") >= least).groupBy("record_id").agg(F.max("payload_bytes").alias("full")).withColumnRenamed("record_id", "of")
    resolved = revisits.join(lengths, F.col("refers_to") == F.col("of"), "left").withColumn("payload_bytes", F.col("full")).drop("of", "full")
    number = lambda c: c.cast(kind)
    return responses.unionByName(resolved).select(
        number(F.col("page_id")).alias(id_col), "uri", "payload_bytes", "payload_digest", "record_type", number(F.nullif(F.regexp_extract(F.coalesce("refers_to", F.lit("")), "^<urn:page:(.*)>$", 1), F.lit(""))).alias("refers_to")
    )


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
o as (select *, max(page_id) over (partition by payload_digest) as original from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id is distinct from original and original is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id is distinct from original then original end as refers_to from o
"""
