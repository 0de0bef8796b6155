"""Content-addressed WARC archive.

Two tables hold an archive. ``payloads`` has the bytes of each distinct
payload once, under its SHA-1 and SHA-256; ``headers`` has the exact header
block of every record with the digests that lead to its payload. A record is
rebuilt by joining the two: header, payload (a revisit record has none) and
the closing line breaks, byte for byte as WARC/1.1 lays it out
(``record_bytes``); ``parse_records`` reads such bytes back.

Of the records with equal payloads of at least ``min_bytes`` bytes, that with
the smallest page_id is the response and the others revisit it; smaller ones
are all responses. A null html is an empty payload, a null url becomes
``about:blank``. Pages with a null page_id get a record under an id made from
their url and digest, and come back with a null page_id; they are the response
only where no page with an id has the payload (that with the smallest hash of
its url, ties by url), and its revisits then refer to a null page. Of rows that
repeat a page_id each gets a record, the repeats of a response being revisits
of it; so do rows without one that repeat a url and payload. Payloads are kept
whole, of any length; a record is one row and has to fit a task. Other columns
are not read. An empty table makes an empty archive.

Payloads are grouped by SHA-256, and ``read_archive`` verifies the stored bytes
against it and against the header's SHA-1 and length, so a damaged or mixed-up
payload raises instead of passing on. What a payload's many copies are told of
it goes through ``skew.lookup``, and the payload itself through
``skew.salted``, so no task gets them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import lookup, salted

#: Payloads of fewer bytes are stored with each of their records' digests but never revisited.
MIN_BYTES = 0
#: Record ids are made from the page's number under this fixed prefix.
RECORD_ID = "urn:page:"
#: Ids of pages without a number go on with this and a hash of url and digest.
UNNUMBERED = "unnumbered:"
#: Date of records whose pages come without one: fixed, so that archives are reproducible.
DATE = "1970-01-01T00:00:00Z"
_LINE = "\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex40: Column) -> Column:
    """Base32 of 20 bytes in hex: four groups of 40 bits, 8 characters each."""
    groups = [F.lpad(F.conv(F.substring(hex40, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
        .withColumn("numbered", F.col("page_id").isNotNull())
        # Pages without a number are told apart by their url.
        .withColumn("page_key", F.coalesce("page_id", F.xxhash64(F.coalesce("url", F.lit("")))))
        .withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes the archive of ``pages`` (page_id, url, html) to ``path``: folders headers and payloads.

    The payload bytes cross one shuffle at most: that which picks one copy a digest
    (dropping repeats of a row reuses its partitioning).
    """
    spark = pages.sparkSession
    rows = _payloads(pages)
    meta = rows.select("page_id", "numbered", "page_key", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("sha1"))
    meta.write.mode("overwrite").parquet(f"{path}/_meta")
    meta = spark.read.schema(meta.schema).parquet(f"{path}/_meta")
    least = lambda numbered: F.min(F.when(F.col("numbered") == numbered, F.col("page_key")))
    firsts = meta.groupBy("sha256").agg(least(True).alias("first_id"), least(False).alias("first_key"))
    firsts = firsts.select("sha256", F.col("first_id").isNotNull().alias("numbered"), F.coalesce("first_id", "first_key").alias("page_key"))
    # A payload is stored by the row that is the first of its digest; only ids and digests are shuffled to find it.
    key = ["page_key", "numbered", "sha256"]
    stored = rows.join(firsts, key, "left_semi").dropDuplicates(key)
    stored.select("sha256", base32(F.sha1("payload")).alias("sha1"), "payload").write.mode("overwrite").parquet(f"{path}/payloads")

    counted = meta.groupBy("page_id", *key, "url", "payload_bytes", "sha1").agg(F.count(F.lit(1)).alias("copies"))
    counted = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    counted.write.mode("overwrite").parquet(f"{path}/_rows")
    counted = spark.read.schema(counted.schema).parquet(f"{path}/_rows")
    # Ties of page_id with one digest but different urls: the smallest url is the response.
    tie = meta.join(firsts, key, "left_semi").groupBy("sha256").agg(F.min(F.struct("page_id", "page_key", "numbered", F.coalesce("url", F.lit("")).alias("url"))).alias("first"))
    same = (F.col("page_key") == F.col("first.page_key")) & (F.col("numbered") == F.col("first.numbered")) & (F.coalesce("url", F.lit("")) == F.col("first.url")) & (F.col("copy") == 1)
    records = lookup(counted, tie, "sha256", "page_key").select("page_id", "url", "sha256", "sha1", "payload_bytes", "first", ((F.col("payload_bytes") >= min_bytes) & ~same).alias("revisit"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_LINE))
    unnumbered = lambda url: F.concat(F.lit(UNNUMBERED), F.sha2(F.concat_ws(" ", F.hex("sha256"), F.coalesce(url, F.lit(""))).cast("binary"), 256))
    name = lambda page_id, url: F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), unnumbered(url)), F.lit(">"))
    uri = F.regexp_replace(F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.lit("about:blank")), r"[\r\n]", "%0A")
    header = F.concat(
        F.lit("WARC/1.1" + _LINE),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", name(F.col("page_id"), F.col("url"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(field("WARC-Refers-To", name(F.col("first.page_id"), F.col("first.url"))), field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_LINE),
    )
    records.select(F.encode(header, "UTF-8").alias("header"), "sha256").write.mode("overwrite").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _number(c: Column) -> Column:
    """The page's number in a record id; null where it has none."""
    return F.nullif(F.regexp_extract(c, rf"<{RECORD_ID}(-?\d+)>", 1), F.lit("")).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, from the archive alone.

    Columns: page_id, record_type, target_uri, payload_digest, refers_to (null
    for a response, or where that has no page_id), payload (of the response for
    a revisit), header. Raises where the payload
    does not have the digest or length that the header states.
    """
    headers = spark.read.parquet(f"{path}/headers").withColumn("text", F.decode("header", "UTF-8"))
    records = headers.select(
        _number(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("target_uri"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        F.when(_field("WARC-Refers-To").isNotNull(), _number(_field("WARC-Refers-To"))).alias("refers_to"),
        _field("Content-Length").cast("long").alias("block_bytes"),
        "sha256", "header",
    )
    stored = spark.read.parquet(f"{path}/payloads").select("sha256", "payload", base32(F.sha1("payload")).alias("found"), (F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("sound"))
    whole = F.col("sound") & (F.col("found") == F.col("payload_digest")) & ((F.col("record_type") == "revisit") | (F.octet_length("payload") == F.col("block_bytes")))
    # Of a payload with many copies each part of their headers gets one: none of the tasks gets them all, and no payload is broadcast.
    return salted(records, stored, "sha256", "header").select(
        "page_id", "record_type", "target_uri", "payload_digest", "refers_to",
        F.when(F.coalesce(whole, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without an id")))).cast("binary")).alias("payload"),
        "header",
    )


def _bytes() -> Column:
    block = F.when(F.col("record_type") == "revisit", F.unhex(F.lit(""))).otherwise(F.col("payload"))
    return F.concat(F.col("header"), block, F.encode(F.lit(_LINE * 2), "UTF-8"))


def record_bytes(archive: DataFrame) -> DataFrame:
    """Each record as it stands in a WARC file: page_id, record."""
    return archive.select("page_id", _bytes().alias("record"))


def parse_records(records: DataFrame, record: str = "record") -> DataFrame:
    """WARC records in bytes, taken apart: adds record_type, page_id, refers_to, payload_digest, block. Raises where the lengths do not fit."""
    end = F.lit(_LINE * 2)
    # Header fields are ASCII but for the uri, and the first empty line ends them.
    text = F.concat(F.substring_index(F.decode(record, "UTF-8"), _LINE * 2, 1), F.lit(_LINE))
    parsed = records.withColumn("text", text).withColumn("at", F.octet_length("text") + 2).withColumn("size", _field("Content-Length").cast("long"))
    whole = (F.octet_length(record) == F.col("at") + F.col("size") + 4) & (F.substring(F.col(record), F.octet_length(record) - 3, F.lit(4)) == F.encode(end, "UTF-8")) & F.col("text").startswith("WARC/1.1" + _LINE)
    block = F.when(F.coalesce(whole, F.lit(False)), F.substring(F.col(record), F.col("at") + 1, F.col("size").cast("int"))).otherwise(F.raise_error(F.lit("not a whole WARC record")).cast("binary"))
    return parsed.select(
        *(c for c in records.columns if c not in ("record_type", "page_id", "refers_to", "payload_digest", "block")),
        _field("WARC-Type").alias("record_type"), _number(_field("WARC-Record-ID")).alias("page_id"), _number(_field("WARC-Refers-To")).alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"), block.alias("block"),
    )


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record is written in the archive, rebuilt as bytes and parsed; a revisit's full payload is that of the record it refers to."""
    scratch = Scratch(spark, "warc")
    path = scratch.path("archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    archive = read_archive(spark, path)
    full = [F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("found")]
    records = parse_records(archive.select(_bytes().alias("record"), *full))
    sound = (F.col("record_type") == "revisit") | (F.octet_length("block") == F.col("payload_bytes"))
    digest = F.when(sound & (F.col("found") == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not fit its payload")))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


_GROUP = "translate(to_base(CAST('0x' || substr(h, {at}, 10) AS UBIGINT)::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
OP5_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT body, min(page_id) AS first_id FROM p GROUP BY body
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  {' || '.join(_GROUP.format(at=at) for at in (1, 11, 21, 31))} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (body)
"""
