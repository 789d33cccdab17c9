"""Views that let the fixed test tables stand in for collected data.

Every view covers its whole table.  Each Spark view has a SQL twin used by the
checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import page_text, page_title
from postlake.functions.urls import url_host, url_path
from postlake.operators.lifecycle import manifest
from postlake.plans import sqltext as S
from postlake.sources.tables import read_table

AS_OF = "2024-01-31 00:00:00"
RUN_START = "2024-01-01 00:00:00"
STORAGE_AS_OF = "2001-08-02 00:00:00"
RECRAWL = 1_000_000_000

DOMAINS = [
    "linkedin.com", "in.linkedin.com", "jobs.linkedin.com", "notlinkedin.com", "www.indeed.com",
    "in.indeed.com", "naukri.com", "internshala.com", "wellfound.com", "www.glassdoor.com",
    "hackerearth.com", "cutshort.io", "instahyre.com", "foundit.in", "shine.com",
    "timesjobs.com", "api.example.com", "boards.example.org", "https://custom.example.com/api", "xnaukri.com",
]
CHANNELS = ["chat", "mail", "hook"]
STATUSES = [429, 403, 503, 407, 500]


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def _sql_pick(values: list, index: str) -> str:
    inner = ", ".join(S.lit(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{inner}])[{index}]"


# --- listings from pages: every page crawled twice ------------------------------

def v_listings(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Each page as a listing, plus a re-crawl under a decorated URL."""
    pages = read_table(spark, sf_dir, "pages", stream).select(
        "page_id", "url",
        page_title("html").alias("title"),
        F.regexp_extract(url_host("url"), r"^(?:www\.|m\.|blog\.)?([^.]+)", 1).alias("company"),
        page_text("html").alias("description"),
        F.split_part(url_path("url"), F.lit("/"), F.lit(2)).alias("source"),
    )
    head = F.regexp_extract("url", "^([^#]*)", 1)
    tail = F.substring("url", F.length(head) + 1, F.length("url"))
    mark = F.when(F.contains(head, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    plain = ~F.rlike("url", F.lit("[?#]"))
    again = (
        F.when(F.col("page_id") % 3 == 0, F.concat(head, mark, F.lit("utm_source=again"), tail))
        .when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("#x")))
        .when(plain, F.concat("url", F.lit("/")))
        .otherwise(F.concat("url", F.lit("#y")))
    )
    copies = F.array(
        F.struct(F.col("url").alias("url"), F.col("page_id").alias("seq")),
        F.struct(again.alias("url"), (F.col("page_id") + RECRAWL).alias("seq")),
    )
    return pages.withColumn("c", F.explode(copies)).select(
        "c.seq", "c.url", "title", "company", "description", "source"
    )


SQL_LISTINGS = f"""
lp AS (SELECT page_id, url, {S.page_title('html')} AS title,
  {S.ext(S.host('url'), r'^(?:www[.]|m[.]|blog[.])?([^.]+)')} AS company,
  {S.page_text('html')} AS description, split_part({S.path('url')}, '/', 2) AS source FROM pages),
v_listings AS (
  SELECT page_id AS seq, url, title, company, description, source FROM lp
  UNION ALL
  SELECT page_id + {RECRAWL} AS seq, CASE
    WHEN page_id % 3 = 0 THEN split_part(url, '#', 1)
      || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again'
      || CASE WHEN contains(url, '#') THEN url[strpos(url, '#'):] ELSE '' END
    WHEN page_id % 3 = 1 THEN url || '#x'
    WHEN contains(url, '?') OR contains(url, '#') THEN url || '#y'
    ELSE url || '/' END AS url, title, company, description, source FROM lp)
"""


# --- listings from documents -------------------------------------------------------

def v_doc_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("title"),
        F.col("source").alias("company"),
        F.col("text").alias("description"),
        F.col("source").alias("source"),
        F.col("lang").alias("location"),
    )


SQL_DOC_LISTINGS = """
v_doc_listings AS (SELECT doc_id AS seq, 'https://' || source || '.example.com/d/' || doc_id AS url,
  text AS title, source AS company, text AS description, source AS source, lang AS location
  FROM documents)
"""


def v_doc_recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document met again: same URL, mirrored, reworded or renamed."""
    n = F.col("seq") % 4
    mirror = F.concat(F.lit("https://mirror.example.org/j/"), F.col("seq").cast("string"))
    return v_doc_listings(spark, sf_dir).select(
        "seq",
        F.when(n == 0, F.concat("url", F.lit("?utm_source=again"))).otherwise(mirror).alias("url"),
        F.when(n == 3, F.concat(F.lit("variant "), F.col("seq").cast("string"), F.lit(" "), "title"))
        .otherwise(F.col("title")).alias("title"),
        "company",
        F.when(n == 2, F.concat(F.lit("reworded "), "description")).otherwise(F.col("description")).alias("description"),
        "source", "location",
    )


SQL_DOC_RECRAWL = """
v_doc_recrawl AS (SELECT seq,
  CASE WHEN seq % 4 = 0 THEN url || '?utm_source=again' ELSE 'https://mirror.example.org/j/' || seq END AS url,
  CASE WHEN seq % 4 = 3 THEN 'variant ' || seq || ' ' || title ELSE title END AS title, company,
  CASE WHEN seq % 4 = 2 THEN 'reworded ' || description ELSE description END AS description, source, location
  FROM v_doc_listings)
"""


# --- events as request log, run events and alerts --------------------------------

def _events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return read_table(spark, sf_dir, "events", stream).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"
    )


def v_traffic(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    status = F.when(
        F.col("event_type") == "error", _pick(STATUSES, (F.col("event_id") % 5 + 1).cast("int"))
    ).otherwise(F.lit(200))
    return _events(spark, sf_dir, stream).select(
        "event_id", "ts",
        _pick(DOMAINS, (F.col("user_id") % len(DOMAINS) + 1).cast("int")).alias("domain"),
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("latency_ms"),
        status.alias("status"),
        status.isin(429, 403, 503).alias("blocked"),
    )


SQL_TRAFFIC = f"""
v_traffic AS (SELECT *, status IN (429, 403, 503) AS blocked FROM (
  SELECT event_id, ts, {_sql_pick(DOMAINS, f'user_id % {len(DOMAINS)} + 1')} AS domain,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS latency_ms,
    CASE WHEN event_type = 'error' THEN {_sql_pick(STATUSES, 'event_id % 5 + 1')} ELSE 200 END AS status
  FROM events))
"""


def v_run_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Run events: a request leaves a start and an outcome, failures their cause."""
    cause = F.when(F.col("event_id") % 5 < 2, F.lit("rate_limited")).when(
        F.col("event_id") % 5 == 3, F.lit("proxy_failed")
    )
    kind = F.col("event_type")
    steps = (
        F.when(kind == "view", F.array(F.lit("request_started"), F.lit("request_ok")))
        .when(kind == "error", F.array_compact(F.array(F.lit("request_started"), F.lit("request_failed"), cause)))
        .when(kind == "purchase", F.array(F.lit("extracted")))
        .when(kind == "click", F.array(F.lit("deduplicated")))
        .otherwise(F.array(F.lit("stored")))
    )
    return _events(spark, sf_dir, stream).select(
        "event_id", "ts",
        _pick(DOMAINS, (F.col("user_id") % len(DOMAINS) + 1).cast("int")).alias("domain"),
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("latency_ms"),
        F.explode(steps).alias("event_type"),
    )


SQL_RUN_EVENTS = f"""
v_run_events AS (SELECT event_id, ts, {_sql_pick(DOMAINS, f'user_id % {len(DOMAINS)} + 1')} AS domain,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS latency_ms, unnest(CASE event_type
    WHEN 'view' THEN ['request_started', 'request_ok']
    WHEN 'error' THEN CASE WHEN event_id % 5 < 2 THEN ['request_started', 'request_failed', 'rate_limited']
      WHEN event_id % 5 = 3 THEN ['request_started', 'request_failed', 'proxy_failed']
      ELSE ['request_started', 'request_failed'] END
    WHEN 'purchase' THEN ['extracted'] WHEN 'click' THEN ['deduplicated'] ELSE ['stored'] END) AS event_type
  FROM events)
"""


def v_alerts(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    return _events(spark, sf_dir, stream).select(
        "event_id", "ts",
        _pick(CHANNELS, (F.col("user_id") % len(CHANNELS) + 1).cast("int")).alias("channel"),
        F.when(F.col("event_type") == "error", F.lit("critical")).otherwise(F.lit("warning")).alias("severity"),
    )


SQL_ALERTS = f"""
v_alerts AS (SELECT event_id, ts, {_sql_pick(CHANNELS, f'user_id % {len(CHANNELS)} + 1')} AS channel,
  CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity FROM events)
"""


def v_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "ts", F.col("value").alias("value"))


# --- ledger and storage ---------------------------------------------------------------

def v_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return read_table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(flag == "A", F.lit("anthropic")).when(flag == "N", F.lit("openai"))
        .otherwise(F.lit("someone-else")).alias("provider"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("tokens"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
    )


SQL_LEDGER = """
v_ledger AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day,
  CASE l_returnflag WHEN 'A' THEN 'anthropic' WHEN 'N' THEN 'openai' ELSE 'someone-else' END AS provider,
  CAST(l_quantity * 1000 AS BIGINT) AS tokens, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice
  FROM lineitem)
"""


def v_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").select(
        F.lpad(key.cast("string"), 12, "0").alias("shard"),
        F.floor("o_totalprice").cast("bigint").alias("size_bytes"),
        (key % 50 + 1).cast("bigint").alias("record_count"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))).alias("mtime"),
    )


SQL_SHARDS = """
v_shards AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS shard, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  CAST(o_orderkey % 50 + 1 AS BIGINT) AS record_count,
  o_orderdate + to_seconds(o_orderkey % 86400) AS mtime FROM orders)
"""


def v_archives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Archives (one per day) and manifests: none on Sundays, those of
    Saturdays not uploaded yet."""
    days = manifest(v_shards(spark, sf_dir)).withColumn("mtime", F.to_timestamp("day"))
    weekday = F.dayofweek("mtime")  # 1 is Sunday
    archives = days.select(
        "archive_path", "day", F.floor(F.col("total_original_bytes") / 3).cast("bigint").alias("size_bytes"), "mtime"
    )
    manifests = days.filter(weekday != 1).select(
        "archive_path", "total_records",
        F.when(weekday != 7, F.col("mtime") + F.expr("INTERVAL 1 DAY")).alias("uploaded_at"),
    )
    return archives, manifests


SQL_MANIFEST = """
man AS (SELECT *, 'archives/' || day[1:4] || '/' || day[6:7] || '/' || day || '_jobs_' || first_shard || '-'
    || last_shard || '.tar.gz' AS archive_path
  FROM (SELECT strftime(mtime, '%Y-%m-%d') AS day, count(*) AS shards,
    CAST(sum(record_count) AS BIGINT) AS total_records, CAST(sum(size_bytes) AS BIGINT) AS total_original_bytes,
    min(shard) AS first_shard, max(shard) AS last_shard FROM v_shards GROUP BY 1))
"""
SQL_ARCHIVES = """
arch AS (SELECT archive_path, day, CAST(floor(total_original_bytes / 3) AS BIGINT) AS size_bytes,
  CAST(day AS TIMESTAMP) AS mtime FROM man),
mani AS (SELECT archive_path, total_records, CASE WHEN dayofweek(CAST(day AS DATE)) <> 6
  THEN CAST(day AS TIMESTAMP) + INTERVAL 1 DAY END AS uploaded_at FROM man WHERE dayofweek(CAST(day AS DATE)) <> 0)
"""


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries: part names as keywords, part types as places."""
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("keywords"), F.col("p_type").alias("location")
    )
