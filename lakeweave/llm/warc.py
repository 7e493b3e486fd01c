"""A content-addressed web archive.

Every page is a WARC record. Payload bytes are stored once under their SHA-256; the exact bytes of each record's
header are stored apart and name that key. Reading joins both, recomputes the key of every payload and
puts the original records together again. Of the records with equal payloads of ``MIN_REVISIT`` bytes or more,
that with the largest page id is the response and the others revisit it.

Defined results: a null html is an empty payload; smaller payloads are stored once too, but all their records
are responses; if several rows have the largest id, all of them are responses; rows with null ids revisit
the largest id there is, or are responses if all ids are null; line breaks in an address are escaped, a null
address has no header line; an empty table gives an empty archive; further columns are not read. Two payloads
with one key but different SHA-1 or length, or a stored payload that doesn't have its key, stop the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.session import materialize

MIN_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uri(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, key, sha1, length`` per page."""
    base = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    return base.select(
        "*", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length")
    )


def write(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Writes ``payloads`` and ``headers`` under ``folder``."""
    base = records(pages)
    payloads = base.groupBy("key").agg(
        F.first("payload").alias("payload"),
        (F.min("sha1") == F.max("sha1")).alias("same_sha1"),
        (F.min("length") == F.max("length")).alias("same_length"),
    )
    checked = payloads.select(
        "key",
        F.when(F.col("same_sha1") & F.col("same_length"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("different payloads have the key "), F.col("key"))))
        .alias("payload"),
    )
    checked.write.mode("overwrite").parquet(f"{folder}/payloads")
    named = materialize(base.select("page_id", "url", "key", "sha1", "length"), "records")
    tops = named.where(F.col("length") >= MIN_REVISIT).groupBy("key").agg(F.max("page_id").alias("top"))
    typed = named.join(tops, "key", "left").withColumn(
        "revisit", F.coalesce(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False))
    )
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uri("page_id")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", address),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _uri("top"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("length")).cast("string")),
        F.lit("\r\n"),
    )
    typed.select("key", F.encode(header, "UTF-8").alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")


def _field(name: str, pattern: str) -> Column:
    """A field of the header, or null."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record`` per record.

    ``record`` is the original record, header, block and closing line breaks; a revisit has no block.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    verified = payloads.select(
        "key",
        F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("a stored payload does not have the key "), F.col("key"))))
        .alias("payload"),
    ).select(
        "key", "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    joined = spark.read.parquet(f"{folder}/headers").join(verified, "key")
    kind = _field("WARC-Type", "([a-z]+)")
    ending = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    block = F.when(kind == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return joined.select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        kind.alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        "payload_bytes",
        "payload_digest",
        "payload",
        F.concat("header", block, ending).alias("record"),
    )
