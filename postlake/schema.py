"""Record schemas of the listing data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _fields(names, nullable=True):
    return [T.StructField(n, _S, nullable) for n in names]


REQUIRED_LISTING = ["title", "company", "description", "url", "source"]
OPTIONAL_LISTING = [
    "location", "apply_url", "salary", "job_type", "experience",
    "posted_date", "seniority", "platform_job_id", "source_tier",
]

# One raw listing as any source hands it over.  Nullability is checked by the
# validation operator, never trusted from the input.
RAW_LISTING = T.StructType(_fields(REQUIRED_LISTING + OPTIONAL_LISTING))

STORED_LISTING = T.StructType(
    _fields([
        "platform", "platform_job_id", "url", "apply_url", "title", "company", "source",
        "location", "description", "salary", "job_type", "experience", "seniority",
        "posted_date", "source_tier", "fingerprint",
    ])
    + [
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("scraped_date", T.DateType()),
    ]
)

SEEN_STORE = T.StructType(
    _fields(["url_hash", "content_hash", "desc_hash"]) + [T.StructField("stored_at", T.TimestampType())]
)

RUN_LOG = T.StructType(_fields(["timestamp", "level", "message", "runId"]))

VIOLATION = T.StructType([
    T.StructField("domain", _S), T.StructField("reason", _S), T.StructField("status_code", T.IntegerType()),
    T.StructField("ts", T.TimestampType()), T.StructField("backoff_ms", T.LongType()),
    T.StructField("attempt", T.LongType()),
])
