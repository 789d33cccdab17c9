"""WARC records as a content-addressed archive.

Payload bytes are stored once per SHA-256 digest; the exact header bytes of every record are kept in a second table, and
records are put together again by a join on the digest. The digest is verified against the bytes whenever they are read.

Defined results: a null page text is the empty payload; null urls give an empty target; a null page_id is kept (it sorts
below every other id); repeated rows give one record each, the first of equal ids being the response; an empty table gives
two empty tables. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import materialize

#: Payloads below this many bytes are never replaced by a revisit record.
REVISIT_BYTES = 1000
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record_id(page_id: str, row: str) -> Column:
    return _lines("<urn:record:", F.coalesce(F.col(page_id).cast("string"), F.lit("null")), ":", F.col(row).cast("string"), ">")


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, date: str = WARC_DATE) -> None:
    """Write ``headers`` and ``payloads`` below ``path`` for pages(page_id, url, html).

    Two scans of the pages: the first reads them into slim record drafts, the second shuffles each payload to its digest,
    after copies inside a task have been merged. A digest shared by a third of the pages thus moves once per task.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest = F.sha2("payload", 256)
    drafts, _ = materialize(
        base.select(
            "page_id", F.coalesce("url", F.lit("")).alias("url"), digest.alias("digest"), F.sha1("payload").alias("sha1"),
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("row"),
        ),
        "warc-drafts",
    )
    first = (
        drafts.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy("digest").agg(F.max(F.struct("page_id", (-F.col("row")).alias("last"))).alias("r"), F.count("*").alias("n"))
        .where("n > 1").select("digest", F.col("r.page_id").alias("first_page"), (-F.col("r.last")).alias("first_row"))
    )
    records = drafts.join(first, "digest", "left")
    revisit = F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row"))
    http = _lines(
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ",
        F.col("payload_bytes").cast("string"), "\r\n\r\n",
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    refers = F.when(
        revisit, _lines("WARC-Profile: ", REVISIT_PROFILE, "\r\nWARC-Refers-To: ", _record_id("first_page", "first_row"), "\r\n")
    ).otherwise(F.lit(""))
    head = _lines(
        "WARC/1.1\r\nWARC-Type: ", F.when(revisit, "revisit").otherwise("response"), "\r\nWARC-Record-ID: ",
        _record_id("page_id", "row"), "\r\nWARC-Date: ", date, "\r\nWARC-Target-URI: ",
        F.regexp_replace("url", r"[\r\n]", ""), "\r\nWARC-Payload-Digest: sha1:", F.col("sha1"), "\r\n", refers,
        "Content-Type: application/http; msgtype=response\r\nContent-Length: ", length.cast("string"), "\r\n\r\n",
    )
    records.select("row", "digest", head.cast("binary").alias("header"), http.cast("binary").alias("http_header")) \
        .write.mode("overwrite").parquet(f"{path}/headers")
    base.select(digest.alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload")) \
        .write.mode("overwrite").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, payload_bytes, payload_digest), measured on the bytes read back; a digest that does not match fails."""
    found = F.sha2("payload", 256)
    return spark.read.parquet(f"{path}/payloads").select(
        F.when(found == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest")))).alias("digest"),
        "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
    )


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: <urn:record:(-?\d+):\d+>\r\n", 1)
    return F.nullif(found, F.lit("")).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, parsed from the stored header bytes and joined with its payload.

    ``record`` holds the exact bytes of the WARC record; ``payload`` the full payload, also for revisit records. Columns a
    caller does not use cost nothing: the payload crosses the shuffle only when it or ``record`` is selected.
    """
    heads = spark.read.parquet(f"{path}/headers")
    joined = heads.join(read_payloads(spark, path), "digest", "left")
    kind = _field("WARC-Type")
    record = F.concat(
        "header", "http_header", F.when(kind == "revisit", F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n")
    )
    return joined.select(
        _page("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest",
        _field("WARC-Payload-Digest").alias("header_digest"), kind.alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"), "digest", "payload",
        record.alias("record"),
    )
