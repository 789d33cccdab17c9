"""Queries over the storage lifecycle, the cost ledger and the frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions.hashing import hash16
from postlake.operators import ledger, lifecycle
from postlake.operators.frontier import frontier
from postlake.plans import jobs
from postlake.plans import sqltext as S
from postlake.plans import views as V
from postlake.plans.registry import query
from postlake.sources.tables import read_table

_NOW = f"TIMESTAMP '{V.STORAGE_AS_OF}'"
_AGE = S.half_up(f"(epoch_us({_NOW}) - epoch_us(mtime)) / 8.64e10::DOUBLE", 1)


@query(
    "archive_manifest",
    f"""WITH {V.SQL_SHARDS}, {V.SQL_MANIFEST} SELECT day, shards, total_records, total_original_bytes, archive_path FROM man""",
)
def archive_manifest(spark, sf):
    return lifecycle.manifest(V.v_shards(spark, sf)).select(
        "day", "shards", "total_records", "total_original_bytes", "archive_path"
    )


@query(
    "archive_manifest_files",
    f"""WITH {V.SQL_SHARDS} SELECT strftime(mtime, '%Y-%m-%d') AS day, shard, size_bytes, record_count, epoch_us(mtime) AS mtime_us
    FROM v_shards""",
)
def archive_manifest_files(spark, sf):
    files = lifecycle.manifest_files(V.v_shards(spark, sf))
    return files.select("day", "shard", "size_bytes", "record_count", F.unix_micros("mtime").alias("mtime_us"))


@query(
    "compression_ratios",
    f"""WITH {V.SQL_SHARDS}, {V.SQL_MANIFEST}, {V.SQL_ARCHIVES} SELECT man.day, printf('%.1f%%',
      (1.0::DOUBLE - size_bytes / CAST(total_original_bytes AS DOUBLE)) * 100) AS ratio FROM man JOIN arch USING (archive_path)""",
)
def compression_ratios(spark, sf):
    archives, _ = V.v_archives(spark, sf)
    days = lifecycle.manifest(V.v_shards(spark, sf))
    return archives.select("archive_path", "size_bytes").join(days, "archive_path").select(
        "day",
        lifecycle.compression_ratio(F.col("size_bytes").cast("double"), F.col("total_original_bytes").cast("double")).alias("ratio"),
    )


_SQL_ARCH = f"{V.SQL_SHARDS}, {V.SQL_MANIFEST}, {V.SQL_ARCHIVES}"
_SQL_WITH = f"""{_SQL_ARCH}, wm AS (SELECT arch.*, coalesce(mani.total_records, 0) AS total_records, mani.uploaded_at
  FROM arch LEFT JOIN mani ON arch.archive_path = mani.archive_path)"""


@query(
    "archive_inventory",
    f"""WITH {_SQL_WITH} SELECT coalesce(archive_path, 'TOTAL') AS archive, CAST(sum(total_records) AS BIGINT) AS total_records,
      CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS archives FROM wm GROUP BY ROLLUP (archive_path)""",
)
def archive_inventory(spark, sf):
    rows = lifecycle.with_manifest(*V.v_archives(spark, sf)).select(
        F.col("archive_path").alias("archive"), "total_records", F.col("size_bytes").alias("archive_size_bytes")
    )
    return lifecycle.inventory(rows).drop("size_text")


@query("archives_with_manifest", f"WITH {_SQL_WITH} SELECT archive_path, total_records, uploaded_at IS NOT NULL AS uploaded FROM wm")
def archives_with_manifest(spark, sf):
    return lifecycle.with_manifest(*V.v_archives(spark, sf)).select(
        "archive_path", "total_records", F.col("uploaded_at").isNotNull().alias("uploaded")
    )


@query("pending_uploads", f"WITH {_SQL_WITH} SELECT archive_path FROM wm WHERE uploaded_at IS NULL")
def pending_uploads(spark, sf):
    return lifecycle.pending_uploads(*V.v_archives(spark, sf)).select("archive_path")


SQL_PLAN = f"""{_SQL_WITH}, plan AS (SELECT *, {_AGE} AS age_days, CASE WHEN {_AGE} < 90 THEN 'keep'
  WHEN uploaded_at IS NULL THEN 'not_uploaded' ELSE 'delete' END AS action FROM wm)"""


@query("cleanup_plan", f"WITH {SQL_PLAN} SELECT archive_path, age_days, action FROM plan ORDER BY age_days DESC, archive_path")
def cleanup_plan(spark, sf):
    plan = lifecycle.cleanup_plan(*V.v_archives(spark, sf), V.STORAGE_AS_OF, guard=True)
    return lifecycle.oldest_first(plan).select("archive_path", "age_days", "action")


@query(
    "cleanup_outcome",
    f"""WITH {SQL_PLAN} SELECT count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'keep') AS kept_by_age,
      count(*) FILTER (action = 'not_uploaded') AS kept_by_upload,
      CAST(coalesce(sum(size_bytes) FILTER (action = 'delete'), 0) AS BIGINT) AS freed_bytes FROM plan""",
)
def cleanup_outcome(spark, sf):
    return lifecycle.cleanup_outcome(lifecycle.cleanup_plan(*V.v_archives(spark, sf), V.STORAGE_AS_OF, guard=True))


@query(
    "storage_usage",
    f"""WITH {SQL_PLAN}, files AS (SELECT 'warm' AS tier, size_bytes FROM plan WHERE action <> 'delete' UNION ALL
      SELECT 'hot', size_bytes FROM v_shards WHERE (epoch_us({_NOW}) - epoch_us(mtime)) / 8.64e10::DOUBLE < 7)
    SELECT coalesce(tier, 'total') AS tier, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) AS files FROM files
    GROUP BY ROLLUP (tier)""",
)
def storage_usage(spark, sf):
    return jobs.lifecycle_cycle(V.v_shards(spark, sf), *V.v_archives(spark, sf), V.STORAGE_AS_OF)["usage"]


# --- ledger ----------------------------------------------------------------------------

SQL_COST = f"""{V.SQL_LEDGER}, led AS (SELECT *, tokens * {S.rate_case('provider')} / 1e6::DOUBLE AS cost_usd FROM (
  SELECT day, provider, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_ledger GROUP BY 1, 2))"""


@query("cost_ledger", f"WITH {SQL_COST} SELECT day, provider, calls, tokens, cost_usd FROM led")
def cost_ledger(spark, sf):
    return ledger.cost_ledger(V.v_ledger(spark, sf))


@query(
    "budget_report",
    f"""WITH {SQL_COST} SELECT day, provider, calls, tokens, cost_usd, greatest(2.0::DOUBLE - cost_usd, 0.0::DOUBLE) AS budget_left,
      cost_usd / 2.0::DOUBLE * 100 AS used_pct, cost_usd >= 2.0 AS exceeded, cost_usd < 2.0 AND cost_usd / 2.0::DOUBLE * 100 >= 80 AS warning FROM led""",
)
def budget_report(spark, sf):
    return ledger.budget_report(ledger.cost_ledger(V.v_ledger(spark, sf)), limit=2.0)


_CALL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "budget_gate",
    f"""WITH {V.SQL_LEDGER}, s AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY day, provider ORDER BY {', '.join(_CALL_ORDER)}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM v_ledger)
    SELECT day, provider, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, tokens_before,
      tokens_before * {S.rate_case('provider')} / 1e6::DOUBLE >= 2.0 AS skipped FROM s""",
)
def budget_gate(spark, sf):
    gated = ledger.budget_gate(
        V.v_ledger(spark, sf), _CALL_ORDER, F.floor(F.col("l_orderkey") / 10_000_000).cast("bigint"), limit=2.0
    )
    return gated.select(
        "day", "provider", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "tokens_before", "skipped"
    )


# --- response cache ----------------------------------------------------------------------

_CACHE_AT = "TIMESTAMP '2024-01-31 00:00:00'"


def cache_view(spark, sf):
    """One entry per distinct document text, cached up to 47 hours ago."""
    docs = read_table(spark, sf, "documents").groupBy(hash16("text").alias("content_hash")).agg(
        F.min("doc_id").alias("entry_id"), F.min("n_chars").alias("size_bytes")
    )
    age = F.make_dt_interval(hours=(F.col("entry_id") % 48).cast("int"))
    return docs.withColumn("cached_at", F.lit(V.AS_OF).cast("timestamp") - age)


SQL_CACHE = f"""cache AS (SELECT *, {_CACHE_AT} - to_hours(entry_id % 48) AS cached_at FROM (
    SELECT {S.hash16('text')} AS content_hash, min(doc_id) AS entry_id, min(n_chars) AS size_bytes FROM documents GROUP BY 1)),
  d AS (SELECT doc_id, {S.hash16('text')} AS content_hash FROM documents)"""


@query(
    "cache_hits",
    f"""WITH {SQL_CACHE} SELECT doc_id, entry_id FROM d JOIN cache USING (content_hash)
      WHERE cached_at >= {_CACHE_AT} - INTERVAL 24 HOUR""",
)
def cache_hits(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", hash16("text").alias("content_hash"))
    return ledger.cache_split(docs, cache_view(spark, sf), V.AS_OF)[0].select("doc_id", "entry_id")


@query(
    "cache_misses",
    f"""WITH {SQL_CACHE} SELECT doc_id FROM d WHERE content_hash NOT IN (SELECT content_hash FROM cache
      WHERE cached_at >= {_CACHE_AT} - INTERVAL 24 HOUR)""",
)
def cache_misses(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", hash16("text").alias("content_hash"))
    return ledger.cache_split(docs, cache_view(spark, sf), V.AS_OF)[1].select("doc_id")


@query(
    "cache_stats",
    f"WITH {SQL_CACHE} SELECT count(*) AS entries, {S.half_up('sum(size_bytes) / 1024')} AS size_kb FROM cache",
)
def cache_stats(spark, sf):
    return ledger.cache_stats(cache_view(spark, sf))


# --- frontier --------------------------------------------------------------------------------

_Q = "replace(keywords, ' ', '+')"
_L = "replace(location, ' ', '+')"
_SLUG = "replace(lower(keywords), ' ', '-')"


def _sql_start(size: int) -> str:
    return f"CASE WHEN p > 1 THEN '&start=' || (p - 1) * {size} ELSE '' END"


_SQL_SITES = " UNION ALL ".join(
    f"SELECT query_id, '{site}' AS site, CAST(p AS BIGINT) AS page_no, {url} AS seed_url FROM q, generate_series(1, {cap}) AS g(p)"
    for site, cap, url in [
        ("cutshort", 5, f"'https://cutshort.io/jobs?keywords=' || {_Q} || '&experience=0-1' || CASE WHEN p > 1 THEN '&page=' || p ELSE '' END"),
        ("foundit", 5, f"'https://www.foundit.in/srp/results?query=' || {_Q} || '&location=' || {_L} || {_sql_start(15)}"),
        ("shine", 5, f"'https://www.shine.com/job-search/' || {_SLUG} || '-jobs/' || CASE WHEN p > 1 THEN 'page-' || p || '/' ELSE '' END "
                     "|| '?q=' || replace(keywords, ' ', '%20') || '&experience=0'"),
        ("timesjobs", 5, "'https://www.timesjobs.com/candidate/job-search.html?searchType=personalizedSearch&from=submit&txtKeywords=' || "
                         f"{_Q} || '&txtLocation=' || {_L} || '&sequence=' || p || '&startPage=1'"),
        ("wellfound", 1, f"'https://wellfound.com/jobs?search=' || {_Q} || '&location=' || {_L}"),
        ("indeed", 10, f"'https://in.indeed.com/jobs?q=' || {_Q} || '&l=' || {_L} || {_sql_start(10)} || '&sort=date&limit=10'"),
        ("linkedin", 4, f"'https://www.linkedin.com/jobs/search/?keywords=' || {_Q} || '&location=' || {_L} || "
                        f"'&trk=public_jobs_jobs-search-bar_search-submit&position=1&pageNum=0' || {_sql_start(25)} || '&sortBy=DD'"),
        ("google", 3, f"'https://www.google.com/search?q=' || {_Q} || '+jobs+in+' || {_L} || '&ibp=htl%3Bjobs' || {_sql_start(10)}"),
        ("indeed_rss", 1, f"'https://in.indeed.com/rss?q=' || {_Q} || '&l=' || {_L} || '&sort=date&fromage=7'"),
        ("naukri", 1, f"'https://www.naukri.com/' || {_SLUG} || '-jobs-in-' || replace(lower(location), ' ', '-')"),
        ("naukri_all", 1, f"'https://www.naukri.com/' || {_SLUG} || '-jobs'"),
        ("internshala", 1, f"'https://internshala.com/internships/keywords-' || {_SLUG}"),
        ("internshala_all", 1, f"'https://internshala.com/internships/' || {_SLUG} || '-internship'"),
    ]
)


@query(
    "search_frontier",
    f"WITH q AS (SELECT p_partkey AS query_id, p_name AS keywords, p_type AS location FROM part) {_SQL_SITES}",
)
def search_frontier(spark, sf):
    return frontier(V.v_queries(spark, sf)).select(
        "query_id", "site", F.col("page_no").cast("bigint").alias("page_no"), "seed_url"
    )
