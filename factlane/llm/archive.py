"""A content-addressed WARC archive.

Writing makes two Parquet tables below one folder:

* ``payloads``: each distinct payload once, under its SHA-256;
* ``records``: each record's exact header block, with the key of its payload.

Of records with equal payloads (of at least ``min_revisit_bytes``) the one with the
largest page id is the response, the others are revisits that refer to it.  Reading
joins the two tables, computes the digests of every stored payload anew, fails on
a payload that isn't what its key says or a record that isn't what its header says,
and gives back the original records, byte for byte.  ``export_warc`` writes them as one stream of WARC/1.1 per file.

A payload held by a third of all records is stored once: before the shuffle each
task keeps one row of each payload.  The joins are on tables that lie in files, so
Spark can split a key that many records share.

Nulls: a missing html is the empty payload, which is stored and deduplicated like any
other; a missing url is an empty target.  Missing page ids are smaller than any
other.  Of rows with equal payload and equal
page id one is the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep, new_path, write_once

#: Fixed: digits that Spark's conv() gives for base 32, and those of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32, as in WARC-Payload-Digest."""
    digest = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def record_id(key: Column, number: Column) -> Column:
    """A URN that is the same whenever the same table is archived."""
    digest = F.md5(F.concat_ws(":", number.cast("string"), key).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _header(lines: list[tuple[str, Column]]) -> Column:
    """A header block with the empty line that ends it; lines without a value are left out."""
    shown = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit(END))) for name, v in lines]
    return F.concat(F.lit(f"WARC/1.1{END}"), *[F.coalesce(x, F.lit("")) for x in shown], F.lit(END))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``; other columns are not archived."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # a line end in a url would end its header line
    rows = pages.select("page_id", F.translate(F.coalesce("url", F.lit("")), END, "  ").alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes")
    )
    listed = keep(
        rows.withColumn("number", F.monotonically_increasing_id())
        .withColumn("sha1", base32_sha1(F.col("payload")))
        .drop("payload"),
        "listed",
    )
    # missing ids order first, so a page that has one is preferred
    order = F.struct("page_id", "number")
    first = listed.groupBy("sha256").agg(F.max_by(F.struct("page_id", "number", "url"), order).alias("of"))
    first = keep(first.select("sha256", *[F.col(f"of.{c}").alias(f"first_{c}") for c in ("page_id", "number", "url")]), "responses")
    write_once(rows.groupBy("sha256").agg(F.first("payload").alias("payload")), f"{path}/payloads")
    listed = listed.join(first, "sha256")
    revisit = (F.col("bytes") >= min_revisit_bytes) & (F.col("number") != F.col("first_number"))
    kind = F.when(revisit, "revisit").otherwise("response")
    own_id = record_id(F.col("sha256"), F.col("number"))
    other_id = record_id(F.col("sha256"), F.col("first_number"))
    header = _header([
        ("WARC-Type", kind),
        ("WARC-Record-ID", own_id),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, other_id)),
        ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
        ("X-Refers-To-Page", F.when(revisit, F.col("first_page_id").cast("string"))),
        ("X-Page", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("text/html")),
        ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ])
    listed.select("number", header.cast("binary").alias("header"), "sha256").write.parquet(f"{path}/records")


def verified_payloads(spark: SparkSession, path: str, with_bytes: bool = True) -> DataFrame:
    """The stored payloads with digests and length computed from their bytes; a wrong key is an error."""
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    right = F.col("sha256") == F.sha2("payload", 256)
    checked = stored.withColumn("sha256", F.when(right, F.col("sha256")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload does not have the digest "), F.col("sha256")))
    ))
    columns = ["sha256", base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")]
    return checked.select(*columns, *(["payload"] if with_bytes else []))


def field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(header.cast("string"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: ``number``, its fields, and the original ``record`` (header, block, two line ends) as bytes."""
    records = spark.read.parquet(f"{path}/records")
    joined = records.join(verified_payloads(spark, path), "sha256")
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "number", *_fields(), F.concat("header", block, F.lit((END * 2).encode())).alias("record"), "payload", "header"
    ).select("number", "page_id", "payload_bytes", _checked().alias("payload_digest"), "record_type", "refers_to", "record", "payload")


def _checked() -> Column:
    """The digest, an error unless the record's block and its end lie where Content-Length says and have the header's digest."""
    header, record = F.col("header"), F.col("record")
    start, length = F.octet_length(header), field(header, "Content-Length").cast("int")
    whole = (F.octet_length(record) == start + length + len(END) * 2) & (
        F.substring(record, start + length + 1, F.lit(len(END) * 2)) == F.lit((END * 2).encode())
    )
    content = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.substring(record, start + 1, length))
    digest = F.concat(F.lit("sha1:"), base32_sha1(content))
    right = whole & (digest == field(header, "WARC-Payload-Digest"))
    return F.when(right, F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("record does not have the length or digest of its header: "), F.coalesce(field(header, "WARC-Record-ID"), F.lit("?"))))
    )


def _fields() -> list[Column]:
    header = F.col("header")
    return [
        field(header, "X-Page").cast("long").alias("page_id"),
        "payload_bytes", "payload_digest",
        field(header, "WARC-Type").alias("record_type"),
        field(header, "X-Refers-To-Page").cast("long").alias("refers_to"),
    ]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Every record's fields, its payload read and verified but not passed on."""
    records = spark.read.parquet(f"{path}/records")
    return records.join(verified_payloads(spark, path, with_bytes=False), "sha256").select("number", *_fields())


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """The archive as WARC/1.1 files: every record whole, one after the other."""
    record = F.col("record")
    text = F.substring(record, F.lit(1), F.octet_length(record) - len(END) * 2).cast("string")
    read_records(spark, path).select(text.alias("value")).write.option("lineSep", END * 2).text(to)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read its records back: the fields of each, checked on the rebuilt record."""
    path = new_path(pages.sparkSession, "archive")
    write_archive(pages, path)
    return read_records(pages.sparkSession, path).drop("record", "payload")
