"""WARC as a content-addressed archive.

Payload bytes are stored once, in a table keyed by their SHA-256; the exact header block of every record is
stored in another, with the key of its payload. A record is rebuilt by a join of the two. The digest is verified
twice: when writing, records of one SHA-256 must agree in length and SHA-1; when reading, the stored bytes must
hash to their key and to the digest that the header names.

Of records with equal payloads of at least min_bytes bytes the one with the largest page_id is the response,
the others revisit it. A record's id is `urn:page:<page_id>`, followed by `:` and a number of its own in the archive
where the page_id is null or repeated.
Cases: null html is an empty payload; a null url is written as `urn:page:<page_id>`; signs of a url that can't stand in a
header are percent-encoded there, and the url as it was goes in Base64 into a line of its own; of records with the same
page_id and payload the one with the least url is the response and the others revisit it; a null page_id is less than any
other and written as empty; other columns are never looked at; an empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import answered, answered_or_not, hot_keys, new_path, remove, written

DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables."""

    payloads: str
    headers: str


def base32(hexed: Column) -> Column:
    """Base32, RFC 4648, of a 40-digit hex string: each 5 hex digits are 4 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


UNFIT = r"[\x00-\x20\x7f]"


def _header(date: str) -> Column:
    crlf = "\r\n"
    fit = F.array_join(F.transform(F.split("url", ""), lambda c: F.when(c.rlike(UNFIT), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    plain = ~F.col("url").rlike(UNFIT)
    uri = F.coalesce(F.when(plain, F.col("url")).otherwise(fit), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    record = lambda page, number: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":"), number.cast("string")), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), record(F.col("page_id"), F.col("own"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.when(~plain, F.concat(F.lit("X-Target-URI-Base64: "), F.regexp_replace(F.base64(F.col("url").cast("binary")), r"\s", ""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record(F.col("last"), F.col("head")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(""),
        F.lit(""),
    ]
    return F.concat_ws(crlf, *lines).cast("binary")


def write(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, date: str = DATE) -> Archive:
    """Write one record per row of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select("page_id", "url", F.unhex(F.sha2(html, 256)).alias("d"), base32(F.sha1(html)).alias("sha1"), F.octet_length(html).cast("long").alias("n"))
    counted = written(spark, slim.withColumn("number", F.monotonically_increasing_id()), "counted")
    shared = written(spark, counted.filter("page_id is not null").groupBy("page_id").agg(F.count("*").alias("times")).filter("times > 1"), "shared")
    total = counted.count()
    slim = answered_or_not(counted, shared, "page_id", "times", total)
    slim = written(spark, slim.withColumn("own", F.when(F.col("page_id").isNull() | F.col("times").isNotNull(), F.col("number"))), "records")
    # the response is the record that sorts first; equal digests must agree in length and SHA-1; all of it combines map-side
    order = F.struct(F.col("page_id").isNull().alias("none"), F.bitwise_not("page_id").alias("late"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNull().alias("z"), "number", "page_id", "own")
    groups = slim.groupBy("d").agg(F.count("*").alias("size"), F.min(order).alias("k"), (F.min("sha1") == F.max("sha1")).alias("s"), (F.min("n") == F.max("n")).alias("m"))
    same = F.when(F.col("s") & F.col("m"), F.lit(True)).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast("boolean"))
    groups = written(spark, groups.filter(same).filter("size > 1").select("d", "size", F.col("k.page_id").alias("last"), F.col("k.number").alias("number_of_head"), F.col("k.own").alias("head")), "copies")  # most payloads have no copy
    marked = answered_or_not(slim, groups, "d", "size", total)  # a payload of many records is no key of a shuffle
    response = F.col("number_of_head").isNull() | (F.col("n") < min_bytes) | (F.col("number") == F.col("number_of_head"))
    records = marked.withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    archive = Archive(new_path(spark, "warc-payloads"), new_path(spark, "warc-headers"))
    records.select(_header(date).alias("header"), "d").write.option("compression", "zstd").parquet(archive.headers)
    # a payload is stored by a row with the response's page_id; where equal ids repeat, duplicates of that row go
    keyed = pages.select("page_id", html.alias("payload")).withColumn("d", F.unhex(F.sha2("payload", 256)))
    first = F.col("page_id").eqNullSafe(F.col("last"))
    copies = answered(slim, groups, "d", "size", total).select("d", "page_id", first.alias("first"))
    losers = written(spark, copies.filter(~F.col("first")).select(F.col("d").alias("__d"), F.col("page_id").alias("__p")).distinct(), "losers")
    kept = keyed.join(losers, (F.col("d") == F.col("__d")) & F.col("page_id").eqNullSafe(F.col("__p")), "left_anti")
    repeated = written(spark, copies.filter("first").groupBy(F.col("d").alias("__d")).agg(F.count("*").alias("c")).filter("c > 1").select("__d"), "repeated")
    once = kept.join(repeated, F.col("d") == F.col("__d"), "left_anti")
    if not repeated.isEmpty():
        once = once.unionByName(kept.join(repeated, F.col("d") == F.col("__d"), "left_semi").dropDuplicates(["d"]))
    once.select("d", "payload").write.option("compression", "zstd").parquet(archive.payloads)
    for t in (counted, shared, slim, groups, losers, repeated):
        remove(spark, t)
    return archive


SALTS = 64


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record rebuilt: header, payload (the full one, of revisits too), d, verified."""
    headers = spark.read.schema("header binary, d binary").parquet(archive.headers)
    payloads = spark.read.schema("d binary, payload binary").parquet(archive.payloads)
    # payloads of many records, fewer than HOT_PARTS, meet them in SALTS tasks
    sizes = headers.groupBy("d").agg(F.count("*").alias("records"))
    hot = F.broadcast(written(spark, hot_keys(sizes, "d", "records", headers.count()).select("d", F.lit(True).alias("hot")), "hot"))
    headers = headers.join(hot, "d", "left").select("header", "d", F.when(F.col("hot"), F.pmod(F.xxhash64("header"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")).alias("salt"))
    sound = payloads.withColumn("sound", F.unhex(F.sha2("payload", 256)) == F.col("d")).withColumn("sha1", base32(F.sha1("payload")))
    named = F.regexp_extract(F.col("header").cast("string"), r"WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1)
    places = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    sound = sound.join(hot, "d", "left").select("d", "payload", "sound", "sha1", F.explode(places).alias("salt"))
    return headers.join(sound, ["d", "salt"]).select("header", "payload", "d", (F.col("sound") & (F.col("sha1") == named)).alias("verified"), "sha1")


def bytes_of(rebuilt: DataFrame) -> DataFrame:
    """The records of records() as they stand in a WARC file: header block, content (none for revisits), two line ends."""
    revisit = F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n")
    return rebuilt.select(F.concat(F.col("header"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")).alias("record"))


def read(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record, parsed from its header and checked against its payload: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, verified."""
    h = F.col("header").cast("string")
    get = lambda name, what=r"([^\r\n]*)": F.nullif(F.regexp_extract(h, rf"\n{name}: {what}\r", 1), F.lit(""))
    r = records(spark, archive)
    return r.select(
        get("WARC-Record-ID", "<urn:page:([^:>]*)[^>]*>").cast("long").alias("page_id"),
        F.coalesce(F.unbase64(get("X-Target-URI-Base64")).cast("string"), get("WARC-Target-URI")).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        get("WARC-Payload-Digest", r"sha1:([^\r\n]*)").alias("payload_digest"),
        get("WARC-Type").alias("record_type"),
        get("WARC-Refers-To", "<urn:page:([^:>]*)[^>]*>").cast("long").alias("refers_to"),
        "payload",
        "verified",
    )
