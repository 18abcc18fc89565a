"""A content-addressed WARC archive.

Every page is a WARC record. Its payload (the html in UTF-8) is stored once under its SHA-256 digest,
gzipped; its exact header is stored apart, with that digest. Of the records with equal payloads of at
least ``least_bytes`` bytes, the one with the smallest page id (nulls last, then url) is the
``response`` and the others are ``revisit`` records that refer to it; smaller payloads are
all ``response``. Reading joins headers to payloads, verifies length, SHA-256 and SHA-1 of each
payload, and gives back the records byte for byte; a digest that does not hold stops the job.

Payloads that very many records share are dealt out in copies while reading, so that no task gets
them all. Null html is an empty payload, a null url gives a header without ``WARC-Target-URI``, rows
that repeat one another entirely are records of their own (one of them the response), an empty table
gives an empty archive, other columns are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import evenly_joined, pieces, scratch

DATE = "2000-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Records that share one payload and are read in the same task, about.
TOGETHER = 2000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of ``payload``: 20 bits of the digest are 4 letters."""
    digest = F.sha1(payload)
    part = lambda i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda v, k: F.substring(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(part(i), k) for i in range(8) for k in range(4)))


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def headers(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, digest, shares, header``: a row for each record; ``shares`` records have its payload."""
    facts = pages.select("page_id", "url", F.sha2(_payload(), 256).alias("digest"), base32_sha1(_payload()).alias("sha1"), F.octet_length(_payload()).cast("long").alias("bytes"))
    facts = facts.groupBy("page_id", "url", "digest", "sha1", "bytes").agg(F.count("*").alias("n"))
    total = pages.count()
    place = F.struct(F.col("page_id").isNull().alias("no"), "page_id", F.col("url").isNull().alias("none"), "url")
    first = facts.groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("shares"))
    sizes = first.select("digest", F.col("shares").alias("n"))
    rows = evenly_joined(facts, first, "digest", sizes, F.xxhash64("page_id", "url"), rows=total).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    is_first = place.eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    record_id = lambda page, url, copy: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.to_json(F.struct(page.alias("p"), url.alias("u"), copy.alias("c")))), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    kind = F.when((F.col("bytes") < least_bytes) | is_first, "response").otherwise("revisit")
    revisit = F.col("kind") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))  # noqa: E731  null if the value is
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("first.page_id"), F.col("first.url"), F.lit(1)))).otherwise(""),
        F.when(revisit, F.coalesce(line("X-Refers-To-Page", F.col("first.page_id")), F.lit(""))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("X-Payload-Length", F.col("bytes")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
    )
    return rows.withColumn("kind", kind).select("page_id", "digest", "shares", header.alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """``digest, gz``: each distinct payload once."""

    def pack(batches):
        for b in pieces(batches):
            gz = [gzip.compress(v, 5, mtime=0) for v in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(gz, pa.binary())], ["digest", "gz"])

    rows = pages.select(F.sha2(_payload(), 256).alias("digest"), _payload().alias("payload"))
    return rows.mapInArrow(pack, "digest string, gz binary").groupBy("digest").agg(F.first("gz").alias("gz"))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> str:
    """Writes the archive; the folder it is in (by default one that goes when the application ends)."""
    folder = folder or scratch(pages.sparkSession, "warc")
    payloads(pages).write.option("compression", "none").parquet(f"{folder}/payloads")
    headers(pages, least_bytes).write.parquet(f"{folder}/headers")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, header, payload`` of every record, verified; header and payload are exact bytes."""
    heads, stored = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    parts = F.ceil(F.col("shares") / TOGETHER).cast("int")
    heads = heads.withColumn("part", F.pmod(F.xxhash64("header"), parts).cast("int"))
    shared = heads.where(F.col("shares") > TOGETHER).groupBy("digest").agg(F.max(parts).alias("parts"))
    stored = stored.join(shared, "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    def unpack(batches):
        for b in pieces(batches):
            known, out = {}, []
            for digest, gz, header in zip(*(b.column(c).to_pylist() for c in ("digest", "gz", "header"))):
                if digest not in known:
                    payload = gzip.decompress(gz)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload stored as {digest} is another")
                    known = {digest: (payload, base64.b32encode(hashlib.sha1(payload).digest()).decode())}
                payload, sha1 = known[digest]
                if f"sha1:{sha1}\r\n" not in header or f"X-Payload-Length: {len(payload)}\r\n" not in header:
                    raise ValueError(f"a header does not fit the payload {digest}")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("header").cast(pa.binary()), pa.array(out, pa.binary())], ["page_id", "header", "payload"])

    rows = heads.join(stored, ["digest", "part"]).select("page_id", "digest", "gz", "header")
    kind = heads.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(unpack, f"page_id {kind}, header binary, payload binary")


def described(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, from the records' bytes."""
    head = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(head, f"\\n{name}: ([^\\r]*)\\r\\n", 1), F.lit(""))
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page").cast(records.schema["page_id"].dataType).alias("refers_to"),
    )


def export(records: DataFrame, folder: str, file_records: int = 10_000) -> None:
    """Standard .warc text files: Spark's text writer puts the record's end after each value.

    A file has at most ``file_records`` records: ``load`` reads a file as one row, so it must stay
    below 2 GB (the default allows records of 200 KB on average).
    """
    revisit = F.decode("header", "UTF-8").contains("WARC-Type: revisit\r\n")
    body = F.when(revisit, F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat(F.decode("header", "UTF-8"), F.lit("\r\n"), body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """``header, payload`` of every record in exported files, each file (below 2 GB) parsed by content lengths."""

    def parse(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                at, heads, bodies = 0, [], []
                while at < len(data):
                    stop = data.index(END.encode(), at) + 2
                    head = data[at:stop]
                    n = int(head.rpartition(b"Content-Length: ")[2].split(b"\r")[0])
                    heads.append(head)
                    bodies.append(data[stop + 2 : stop + 2 + n])
                    at = stop + 2 + n + len(END)
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["header", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(parse, "header binary, payload binary")


def _sql() -> str:
    letters = " || ".join(f"substr('{ALPHABET}', ((('0x' || substr(x, {5 * i + 1}, 5))::INTEGER >> {15 - 5 * k}) & 31) + 1, 1)" for i in range(8) for k in range(4))
    return f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS x, octet_length(encode(coalesce(html, ''))) AS bytes,
                  row_number() OVER w AS turn, first(page_id) OVER w AS first_page
           FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, bytes::BIGINT AS payload_bytes, {letters} AS payload_digest,
       CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN first_page END AS refers_to
FROM p
"""


ORACLE_SQL = _sql()
