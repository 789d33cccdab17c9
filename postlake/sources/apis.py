"""API JSON payloads to listings.

Each function takes a payload table with a ``body`` column holding one raw
response per row, and keeps every other column of the row (query, location).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import empty_to_null, first_filled, head

_SERP = (
    "jobs ARRAY<STRUCT<title STRING, company STRING, location STRING, snippet STRING, link STRING>>, "
    "organic ARRAY<STRUCT<title STRING, link STRING, snippet STRING>>"
)
_BOARD_JOB = (
    "ARRAY<STRUCT<title STRING, designation STRING, companyName STRING, company STRING, "
    "placeholders ARRAY<STRUCT<type STRING, label STRING>>, jobLocation STRING, location STRING, "
    "jobDescription STRING, snippet STRING, jdURL STRING, jobId STRING, salary STRING, "
    "experienceText STRING, footerPlaceholderLabel STRING, createdDate STRING>>"
)
_BOARD = f"jobDetails {_BOARD_JOB}, data {_BOARD_JOB}"
_AGGREGATOR = (
    "data ARRAY<STRUCT<job_id STRING, employer_name STRING, job_title STRING, job_description STRING, "
    "job_apply_link STRING, job_city STRING, job_state STRING, job_country STRING, "
    "job_employment_type STRING, job_posted_at_datetime_utc STRING, job_min_salary STRING, "
    "job_max_salary STRING, job_salary_currency STRING, job_salary_period STRING, job_is_remote BOOLEAN>>"
)


def _keep(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "body"]


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.withColumn("api", F.from_json("body", schema, {"mode": "PERMISSIVE"}))


def api_serp(payloads: DataFrame) -> DataFrame:
    """Search API: the job widget, or organic links when the widget is empty."""
    job = "STRUCT<title STRING, company STRING, location STRING, description STRING, url STRING>"
    said = lambda v: F.coalesce(v, F.lit("undefined"))  # noqa: E731 - text of a missing field
    from_widget = F.transform(
        "api.jobs",
        lambda j: F.struct(
            F.coalesce(j["title"], F.lit("")).alias("title"),
            first_filled(j["company"], F.lit("Unknown")).alias("company"),
            empty_to_null(j["location"]).alias("location"),
            first_filled(j["snippet"], F.concat(said(j["title"]), F.lit(" at "), said(j["company"]))).alias("description"),
            F.coalesce(j["link"], F.lit("")).alias("url"),
        ).cast(job),
    )
    from_links = F.transform(
        F.filter("api.organic", lambda o: empty_to_null(o["title"]).isNotNull() & empty_to_null(o["link"]).isNotNull()),
        lambda o: F.struct(
            o["title"].alias("title"), F.lit("Various / See Link").alias("company"),
            F.col("location").alias("location"),
            first_filled(o["snippet"], o["title"]).alias("description"), o["link"].alias("url"),
        ).cast(job),
    )
    chosen = F.when(F.coalesce(F.size("api.jobs"), F.lit(0)) > 0, from_widget).otherwise(from_links)
    kept = [c for c in _keep(payloads) if c != "location"]
    return (
        _parsed(payloads, _SERP)
        .select(*kept, F.posexplode(chosen).alias("item_no", "job"))
        .select(*kept, "item_no", "job.*", F.lit("api").alias("source_tier"))
    )


def api_board(payloads: DataFrame, origin: str = "https://www.naukri.com", max_chars: int | None = None) -> DataFrame:
    """Board API: ``jobDetails`` or ``data``, with per-field fallbacks."""
    job = F.col("job")

    def placeholder(kind: str) -> Column:
        return F.get(F.filter(job["placeholders"], lambda p: p["type"] == kind), F.lit(0))["label"]

    link = job["jdURL"]
    path = F.coalesce(link, F.concat(F.lit("/job-listings-"), F.coalesce(job["jobId"], F.lit("undefined"))))
    return (
        _parsed(payloads, _BOARD)
        .select(*_keep(payloads), F.posexplode(F.coalesce("api.jobDetails", "api.data")).alias("item_no", "job"))
        .select(
            *[c for c in _keep(payloads) if c != "location"], "item_no",
            F.coalesce(job["title"], job["designation"], F.lit("")).alias("title"),
            F.coalesce(job["companyName"], job["company"], F.lit("Unknown")).alias("company"),
            F.coalesce(placeholder("location"), job["jobLocation"], job["location"]).alias("location"),
            head(F.coalesce(job["jobDescription"], job["snippet"], job["title"], F.lit("")), max_chars).alias("description"),
            F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit(origin), path)).alias("url"),
            F.coalesce(placeholder("salary"), job["salary"]).alias("salary"),
            F.coalesce(placeholder("experience"), job["experienceText"]).alias("job_type"),
            F.coalesce(job["footerPlaceholderLabel"], job["createdDate"]).alias("posted_date"),
            F.when(~job["jobId"].isin("", "0"), job["jobId"]).alias("platform_job_id"),
        )
        .filter(F.col("title") != "")
    )


def api_aggregator(payloads: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Aggregator API: remote flag or city, state, country; salary as text."""
    job = F.col("job")
    place = F.concat_ws(", ", *[empty_to_null(job[k]) for k in ("job_city", "job_state", "job_country")])
    low, high = (F.when(job[k].try_cast("double") != 0, job[k]) for k in ("job_min_salary", "job_max_salary"))
    currency = F.coalesce(job["job_salary_currency"], F.lit("₹"))
    period = F.coalesce(job["job_salary_period"], F.lit("year"))
    kept = [c for c in _keep(payloads) if c != "location"]
    return (
        _parsed(payloads, _AGGREGATOR)
        .select(*_keep(payloads), F.posexplode("api.data").alias("item_no", "job"))
        .select(
            *kept, "item_no",
            job["job_title"].alias("title"),
            F.coalesce(job["employer_name"], F.lit("Unknown")).alias("company"),
            F.when(job["job_is_remote"], F.lit("Remote")).otherwise(empty_to_null(place)).alias("location"),
            head(F.coalesce(job["job_description"], F.lit("")), max_chars).alias("description"),
            F.coalesce(job["job_apply_link"], F.lit("")).alias("url"),
            F.when(low.isNotNull() & high.isNotNull(), F.concat(currency, low, F.lit("-"), high, F.lit("/"), period))
            .when(low.isNotNull(), F.concat(currency, low, F.lit("+/"), period)).alias("salary"),
            job["job_employment_type"].alias("job_type"),
            job["job_posted_at_datetime_utc"].alias("posted_date"),
        )
        .filter((empty_to_null("title").isNotNull()) & (F.col("url") != ""))
    )


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per listing from one row per fetch; failed fetches stay visible."""
    return batches.select(
        F.col("source").alias("batch_source"), "tier", "duration_ms", "error",
        F.posexplode_outer("jobs").alias("item_no", "job"),
    ).select("batch_source", "tier", "duration_ms", "error", "item_no", "job.*")
