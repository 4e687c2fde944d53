"""Content-addressed WARC archive (operator 6).

A distinct payload is stored once under its SHA-256; the exact header block of
every record is kept apart; archives and original records come from joining
the two.  Archives are WARC/1.1 files: Spark's text writer puts the blank lines
that end a record between records, so any Hadoop file system will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .worker import released

#: Smaller payloads are never revisits.
LEAST_BYTES = 1000
#: Payload bytes that one archive file should hold before compression.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
#: Records of one payload that meet it in one place; those of a hot payload are dealt to several.
SALT_ROWS = 1000
#: Names the page that a payload is stored from: page_id with null told apart, and the SHA-256.
KEY = ["id", "no_id", "strong"]


def with_key(df: DataFrame) -> DataFrame:
    """``df`` (page_id, strong, ...) with the columns of KEY, none of them null."""
    return df.withColumn("id", F.coalesce("page_id", F.lit(0))).withColumn("no_id", F.col("page_id").isNull())


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha1(payload.cast("binary")))


def _strong(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def header(kind: Column, page_id: Column, url: Column, length: Column, digest: Column, refers_to: Column) -> Column:
    """Header block of a record, without the blank line that ends it.

    Line ends in a URL are percent-encoded; a null URL or id leaves its line out.
    """
    clean = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat_ws("\r\n", *lines)


def store(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of ``pages`` (page_id, url, html), both written.

    headers: page_id, strong, digest, bytes, record_type, refers_to, header, salts,
    one row a page.  payloads: strong, salts, payload, each distinct payload of
    response records once; salts is how many places they meet it in.  Of equal
    payloads of LEAST_BYTES or more the row with the largest page_id is the
    response; if that id is repeated, the rows with it all are.  Equal means
    equal SHA-256 and length; the SHA-1 is what the WARC digest field shows.
    A null payload counts as empty, a null page_id as smaller than any.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(
        "page_id", "url", _strong(payload).alias("strong"), _digest(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")
    )
    keyed = scratch.table(keyed, "keyed")
    large = F.col("bytes") >= LEAST_BYTES
    newest = keyed.groupBy("strong", "bytes").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).withColumnRenamed("strong", "_strong").withColumnRenamed("bytes", "_bytes")
    on = (F.col("strong") == F.col("_strong")) & (F.col("bytes") == F.col("_bytes"))
    revisit = large & F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    copies = F.when(large & F.col("newest").isNotNull(), 1).otherwise(F.col("n"))
    kinds = keyed.join(newest, on, "left").select(
        "page_id", "url", "strong", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to"), F.ceil(copies / SALT_ROWS).cast("int").alias("salts")
    )
    length = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("bytes"))
    head = header(F.col("record_type"), F.col("page_id"), F.col("url"), length, F.lower(F.hex("digest")), F.col("refers_to"))
    headers = scratch.table(kinds.select("page_id", "strong", "digest", "bytes", "record_type", "refers_to", head.alias("header"), "salts"), "headers")
    # One page of those with a payload carries it, so that a common payload meets in no task.
    carriers = with_key(headers.filter("record_type = 'response'").groupBy("strong").agg(F.max("page_id").alias("page_id"), F.max("salts").alias("salts"))).select(*KEY, "salts")
    kept = with_key(pages.select("page_id", _strong(payload).alias("strong"), payload.alias("payload"))).select(*KEY, "payload")
    scratch.drop("keyed")
    return headers, scratch.table(kept.join(carriers, KEY).dropDuplicates(KEY).select("strong", "salts", "payload"), "payloads", compression="zstd")


def write_archives(headers: DataFrame, payloads: DataFrame, path: str) -> None:
    """Reconstruct every record by a join and write gzipped archive files."""
    spark = headers.sparkSession
    size = headers.filter("record_type = 'response'").agg(F.sum("bytes")).first()[0] or 0
    files = max(1, -(-int(size) // FILE_BYTES))
    # Both sides are dealt to the files by key: the join needs no other exchange, and a
    # recomputed task writes the same rows again.  Revisits ask for no payload.
    by = ["strong", "salt"]
    found = payloads.select("strong", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "payload").repartition(files, *by)
    response = F.col("record_type") == "response"
    salt = F.pmod(F.monotonically_increasing_id(), F.when(response, F.col("salts")).otherwise(1 << 16)).cast("int")
    heads = headers.select(F.when(response, F.col("strong")).alias("strong"), salt.alias("salt"), "header").repartition(files, *by)
    records = heads.join(found, by, "left").select(F.concat(F.col("header"), F.lit(END), F.coalesce("payload", F.lit(""))).alias("value"))
    records.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archive files below ``path``: page_id, record_type, digest, refers_to, bytes, sha1, header, payload.

    A file is parsed by Content-Length, so payloads may hold any bytes.
    """

    def field(lines: dict[bytes, bytes], name: bytes) -> str | None:
        return lines[name].decode() if name in lines else None

    def number(value: str | None) -> int | None:
        return int(value.removeprefix("<urn:page:").removesuffix(">")) if value else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, at = zlib.decompress(content.as_py(), 47), 0
                rows: list[tuple] = []
                size = 0
                while at < len(data):
                    stop = data.index(b"\r\n\r\n", at)
                    head = data[at:stop]
                    lines = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
                    start = stop + 4
                    payload = data[start : start + int(lines[b"Content-Length"])]
                    at = start + len(payload)
                    if data[at : at + 4] != b"\r\n\r\n":
                        raise ValueError("a record doesn't end where its length says")
                    at += 4
                    digest = (field(lines, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
                    rows.append((number(field(lines, b"WARC-Record-ID")), field(lines, b"WARC-Type"), digest, number(field(lines, b"WARC-Refers-To")), len(payload), hashlib.sha1(payload).hexdigest(), head.decode(), payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema)

    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("header", pa.string()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(released(released(run)), "page_id long, record_type string, digest string, refers_to long, bytes long, sha1 string, header string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """payload_bytes and payload_digest of the full payload for every record read.

    A revisit takes them from the response that it names; a digest that
    disagrees with the payload's own is an error.
    """
    own = records.filter("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.when(F.col("digest") == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("payload digest mismatch"))).alias("payload_digest"), "record_type", "refers_to"
    )
    target = own.filter(F.col("payload_bytes") >= LEAST_BYTES).select(F.col("page_id").alias("_page"), "payload_bytes", "payload_digest").distinct()
    later = records.filter("record_type = 'revisit'").select("page_id", "digest", "record_type", "refers_to")
    later = later.join(target, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("payload_digest")), "left")
    return own.unionByName(later.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Store, write and read back ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    headers, payloads = store(pages.select("page_id", "url", "html"), scratch)
    scratch.release()
    write_archives(headers, payloads, scratch.at("archives"))
    scratch.drop("payloads", "headers")
    read = read_archives(spark, scratch.at("archives")).drop("payload", "header")
    return resolved(scratch.table(read, "read"))


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
m AS (SELECT *, CAST(strlen(payload) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY payload) AS newest FROM p)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM m
"""
