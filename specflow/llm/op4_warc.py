"""Content-addressed WARC archive.

``payloads/``  each different payload once, under its SHA-256
``records/``   one row per record: its exact header block, its SHA-256 key

A record is header block, empty line, payload (responses only), two line
ends, as in WARC 1.1; it is rebuilt by joining the two tables.  A revisit
record has the payload's digest and length in its headers and no block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, workspace

CRLF = "\r\n"
#: Digits of Spark's conv() in base 32 and those of RFC 4648.
_CONV32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: four groups of 40 bits, eight digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _CONV32, _RFC32)


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(F.lit("WARC/1.1" + CRLF), *[
        F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
        for k, v in fields])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    Of the rows with equal payloads of at least ``min_bytes`` bytes the one
    with the smallest page_id is the response and the others revisit it; all
    rows that share this page_id and payload are responses, and so are all if
    every page_id is null.  Equality is that of SHA-256, SHA-1 and length
    together; when one SHA-256 has two of the others, the write fails.
    A null html is an empty payload, a null url leaves its header out, line
    breaks in a url become %0D and %0A, other columns are ignored, and an
    empty table gives an archive without records.
    """
    src = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = src.select("page_id", "url", F.sha2("payload", 256).alias("key"), base32_sha1(F.col("payload")).alias("sha1"),
                       F.octet_length("payload").cast("long").alias("n_bytes"))
    keys = materialize(keyed, "warc-keys")
    firsts = keys.groupBy("key").agg(
        F.min("page_id").alias("first_id"), F.min("sha1").alias("sha1"), F.max("sha1").alias("sha1_b"),
        F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("n_bytes_b"))
    firsts = firsts.withColumn("first_id", F.when(
        (F.col("sha1") == F.col("sha1_b")) & (F.col("n_bytes") == F.col("n_bytes_b")), F.col("first_id"))
        .otherwise(F.raise_error(F.concat(F.lit("different payloads share the SHA-256 "), F.col("key"))).cast("long")))
    firsts = materialize(firsts.select("key", "first_id"), "warc-firsts")
    rec = keys.join(firsts, "key")  # a frequent payload's key: a plain join, which adaptive execution splits
    revisit = (F.col("n_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    head = _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Payload-Length", F.col("n_bytes")),
        ("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n_bytes"))))
    rec.select(F.encode(head, "UTF-8").alias("header"), F.when(~revisit, F.col("key")).alias("key")).write.parquet(f"{path}/records")
    # Payloads move once, dealt by key and page_id, which no payload makes frequent.
    row_id = F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("row_id")
    pick = firsts.withColumnRenamed("first_id", "page_id").select("key", row_id)
    (src.select(F.sha2("payload", 256).alias("key"), row_id, "payload").join(pick, ["key", "row_id"])
     .groupBy("key", "row_id").agg(F.first("payload").alias("payload"))
     .select("key", "payload").write.parquet(f"{path}/payloads"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record's bytes, rebuilt: column ``record``.  A stored payload whose
    SHA-256 isn't its key raises."""
    rec = spark.read.schema("header binary, key string").parquet(f"{path}/records")
    pay = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    pay = pay.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("a stored payload differs from its digest "), F.col("key"))).cast("binary")))
    body = F.coalesce(F.col("payload"), F.lit(b""))
    return rec.join(pay, "key", "left").select(F.concat(
        F.col("header"), F.lit(CRLF.encode()), body, F.lit((2 * CRLF).encode())).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """The fields of records, read from their bytes: page_id, record_type,
    payload_bytes, payload_digest, refers_to and the payload itself."""
    cut = F.instr(F.decode("record", "ISO-8859-1"), CRLF + CRLF)
    r = records.withColumn("_cut", cut)
    r = r.select(F.expr("decode(substring(record, 1, _cut + 1), 'UTF-8')").alias("_h"),
                 F.expr("substring(record, _cut + 4)").alias("_rest"))
    field = lambda k: F.regexp_extract("_h", rf"(?:^|\r\n){k}: ([^\r\n]*)", 1)
    kind, digest = field("WARC-Type"), F.substring(field("WARC-Payload-Digest"), 6, 32)
    own = F.expr("substring(_rest, 1, length(_rest) - 4)")
    return r.select(
        field("WARC-Record-ID").alias("_id"), field("WARC-Refers-To").alias("_ref"), kind.alias("record_type"),
        field("WARC-Payload-Length").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.when(kind == "response", own).alias("payload")).select(
        F.expr("try_cast(regexp_extract(_id, 'page:(-?[0-9]+)>', 1) AS bigint)").alias("page_id"), "payload_bytes",
        "payload_digest", "record_type",
        F.expr("try_cast(regexp_extract(_ref, 'page:(-?[0-9]+)>', 1) AS bigint)").alias("refers_to"), "payload")


def warc_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archive, read it back and check each response's payload against
    the digest and length in its headers."""
    spark = pages.sparkSession
    path = path or workspace(spark, "warc")
    write_archive(pages, path, min_bytes)
    got = parse_records(read_records(spark, path))
    good = F.col("payload").isNull() | ((base32_sha1(F.col("payload")) == F.col("payload_digest"))
                                        & (F.octet_length("payload") == F.col("payload_bytes")))
    return got.withColumn("payload_bytes", F.when(good, F.col("payload_bytes")).otherwise(
        F.raise_error(F.lit("a record's payload differs from its headers")).cast("long")))
