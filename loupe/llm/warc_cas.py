"""Content-addressed WARC archive: payload bytes are stored once under their
SHA-256, the exact record headers separately, and joins give the records back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.common import scratch

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _safe(c: Column) -> Column:
    """A header value holds no line break; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``path/payloads`` (``address, payload, payload_sha1, n_bytes``)
    and ``path/headers`` (``page_id, address, header``).

    Null html is an empty payload.  Of equal payloads of at least
    ``min_revisit_bytes`` the one with the largest id is the response; rows
    repeated under that id are responses too.  Rows with a null id are
    responses if no other row has the payload, else revisits.  Only ids, digests and
    lengths are grouped; payloads move once, after a map-side merge of equal
    addresses, so a page copied a million times does not fill a task."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("page_id"), _safe(F.col(url_col)).alias("url"), payload.alias("payload"))
    p = p.withColumn("address", F.sha2("payload", 256))
    p.groupBy("address").agg(F.first("payload").alias("payload")).select(
        "address", "payload", F.sha1("payload").alias("payload_sha1"), F.length("payload").cast("long").alias("n_bytes")
    ).write.parquet(f"{path}/payloads")
    thin = p.select("page_id", "url", "address", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    keeper = thin.where(F.col("n") >= min_revisit_bytes).groupBy("address").agg(F.max("page_id").alias("keeper"))
    h = thin.join(keeper, "address", "left").withColumn(
        "revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))
    lines = [F.lit("WARC/1.1"),
             F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
             F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
             F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
             F.lit(f"WARC-Date: {date}"),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
             F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("keeper")))),
             F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
             F.concat(F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")).cast("string"))]
    h.select("page_id", "address", F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).alias("header")
             ).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: ``page_id, header, record_type, refers_to,
    declared_digest, payload, payload_bytes, payload_digest, verified,
    record`` (``record``: header, body and the closing line breaks).

    Digest and length are taken from the stored bytes, and a payload counts as
    verified if its bytes still give its address."""
    store = spark.read.parquet(f"{path}/payloads").select(
        "address", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("address")).alias("verified"))
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    h = spark.read.parquet(f"{path}/headers").select(
        "page_id", "address", "header", field("WARC-Type").alias("record_type"),
        F.expr(r"try_cast(regexp_extract(header, r'\r\nWARC-Refers-To: <urn:page:([^>]*)>', 1) as bigint)").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return h.join(store, "address").withColumn(
        "record", F.concat(F.col("header").cast("binary"), body, F.lit((CRLF + CRLF).encode()))).drop("address")


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write an archive into the shared folder and read it back."""
    path = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    write_archive(pages, path, **options)
    return read_archive(pages.sparkSession, path)
