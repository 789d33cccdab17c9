"""Queries over validation, filters, deduplication and the stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions.hashing import with_fingerprints
from postlake.functions.urls import domain_of, source_fingerprint
from postlake.operators import dedup, listings, metrics, search_index, store
from postlake.plans import jobs
from postlake.plans import sqltext as S
from postlake.plans import views as V
from postlake.plans.registry import query
from postlake.plans.text_queries import SQL_FP
from postlake.session import scratch_path
from postlake.sources.tables import read_table


def _fp(df, mode="url_title"):
    return with_fingerprints(df, mode)


@query(
    "distinct_postings_per_domain",
    f"""WITH {V.SQL_LISTINGS}, {SQL_FP},
    firsts AS (SELECT * FROM fp QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY seq) = 1)
    SELECT {S.domain_of('url')} AS domain, count(*) AS postings FROM firsts GROUP BY 1""",
)
def distinct_postings_per_domain(spark, sf):
    return jobs.postings_per_domain(V.v_listings(spark, sf))


@query(
    "stamp_listings",
    f"""WITH {V.SQL_LISTINGS} SELECT seq, source AS platform, 'direct_crawl' AS source_tier,
      epoch_us(TIMESTAMP '{V.AS_OF}') AS scraped_us FROM v_listings""",
)
def stamp_listings(spark, sf):
    return listings.stamp(V.v_listings(spark, sf), V.AS_OF).select(
        "seq", "platform", "source_tier", F.unix_micros("scraped_at").alias("scraped_us")
    )


def _dirty(spark, sf):
    """Listings with planted faults in every fifth shape, over all documents."""
    n = F.col("seq") % 5
    return V.v_doc_listings(spark, sf).select(
        "seq",
        F.when(n == 1, F.concat(F.lit("no scheme "), F.col("seq").cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(n == 2, F.substring("title", 1, 1)).otherwise(F.col("title")).alias("title"),
        F.when(n == 3, F.substring("description", 1, 9)).otherwise(F.col("description")).alias("description"),
        F.when(n != 4, F.col("company")).alias("company"), "source",
    )


SQL_DIRTY = f"""
dirty AS (SELECT seq, CASE WHEN seq % 5 = 1 THEN 'no scheme ' || seq ELSE url END AS url,
  CASE WHEN seq % 5 = 2 THEN substring(title, 1, 1) ELSE title END AS title,
  CASE WHEN seq % 5 = 3 THEN substring(description, 1, 9) ELSE description END AS description,
  CASE WHEN seq % 5 <> 4 THEN company END AS company, source FROM v_doc_listings),
checked AS (SELECT *, coalesce(company, 'Unknown Company') AS company_out,
  concat_ws(',', CASE WHEN NOT regexp_matches(url, '^https?://[^/]') THEN 'url' END,
  CASE WHEN length(title) < 2 THEN 'title' END, CASE WHEN length(description) < 10 THEN 'description' END) AS reasons FROM dirty)
"""


@query(
    "validate_accepted",
    f"WITH {V.SQL_DOC_LISTINGS}, {SQL_DIRTY} SELECT seq, company_out AS company FROM checked WHERE reasons = ''",
)
def validate_accepted(spark, sf):
    valid, _ = listings.validate(listings.stamp(_dirty(spark, sf), V.AS_OF))
    return valid.select("seq", "company")


@query(
    "validate_rejected",
    f"WITH {V.SQL_DOC_LISTINGS}, {SQL_DIRTY} SELECT seq, reasons FROM checked WHERE reasons <> ''",
)
def validate_rejected(spark, sf):
    _, rejected = listings.validate(listings.stamp(_dirty(spark, sf), V.AS_OF))
    return rejected.select("seq", F.array_join("reasons", ",").alias("reasons"))


@query(
    "require_fields",
    f"WITH {V.SQL_DOC_LISTINGS}, {SQL_DIRTY} SELECT seq FROM dirty WHERE length(title) > 3 AND url <> '' AND contains(url, '/d/')",
)
def require_fields(spark, sf):
    return listings.require_fields(_dirty(spark, sf), ["title", "url"], min_title=4, url_part="/d/").select("seq")


@query(
    "keyword_any",
    f"""WITH {V.SQL_DOC_LISTINGS} SELECT seq FROM v_doc_listings WHERE
      contains(lower(title), 'thining') OR contains(lower(description), 'thining')
      OR contains(lower(title), 'deveux') OR contains(lower(description), 'deveux')""",
)
def keyword_any(spark, sf):
    return listings.keyword_any(V.v_doc_listings(spark, sf), "Thining deveux").select("seq")


@query(
    "search_listings",
    f"""WITH {V.SQL_DOC_LISTINGS}, w AS (SELECT seq, string_split(trim(regexp_replace(lower(title || ' ' || company),
      '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM v_doc_listings)
    SELECT seq FROM w WHERE list_contains(words, 'the') AND list_contains(words, 'of')""",
)
def search_listings(spark, sf):
    return listings.search(V.v_doc_listings(spark, sf), "The of").select("seq")


@query(
    "search_index",
    f"""WITH {V.SQL_DOC_LISTINGS}, {V.SQL_DOC_RECRAWL}, b AS (SELECT seq, title, company FROM v_doc_listings
      UNION ALL SELECT seq + {V.RECRAWL}, title, company FROM v_doc_recrawl),
    w AS (SELECT seq, string_split(trim(regexp_replace(lower(title || ' ' || company), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM b)
    SELECT seq FROM w WHERE list_contains(words, 'variant') AND list_contains(words, 'the') AND list_contains(words, 'of')""",
)
def search_index_query(spark, sf):
    """Two loads are indexed one after the other, then searched for three words of very different frequency."""
    path = scratch_path(spark, "search-index")
    search_index.append(V.v_doc_listings(spark, sf), path, "seq")
    search_index.append(V.v_doc_recrawl(spark, sf).withColumn("seq", F.col("seq") + V.RECRAWL), path, "seq")
    return search_index.search(spark, path, "The variant of").select(F.col("id").alias("seq"))


@query(
    "in_batch_first",
    f"WITH {V.SQL_LISTINGS}, {SQL_FP} SELECT url_hash, min(seq) AS seq FROM fp GROUP BY 1",
)
def in_batch_first(spark, sf):
    return dedup.first_in_batch(_fp(V.v_listings(spark, sf)), ["seq"]).select("url_hash", "seq")


def _sql_source_fp(src: str) -> str:
    return f"""SELECT seq, regexp_replace({S.token('source')}, '[^a-z0-9]+', '-', 'g') || '::'
      || lower(split_part(url, '://', 1)) || '://' || {S.host('url')}
      || coalesce(nullif(rtrim(lower({S.path('url')}), '/'), ''), '/') || '::'
      || lower({S.ext(S.path('url'), '([^/]+)/*$')}) AS source_fp FROM {src}"""


@query(
    "source_dedup",
    f"WITH {V.SQL_LISTINGS}, f AS ({_sql_source_fp('v_listings')}) SELECT source_fp, min(seq) AS seq FROM f GROUP BY 1",
)
def source_dedup(spark, sf):
    rows = V.v_listings(spark, sf).withColumn(
        "source_fp", source_fingerprint("source", "url", F.lit(None).cast("string"))
    )
    return listings.dedup_by_source(rows, ["seq"]).select("source_fp", "seq")


@query(
    "source_dedup_stats",
    f"""WITH {V.SQL_LISTINGS}, f AS (SELECT lower(source) || '::' || lower(split_part(url, '://', 1)) || '://' || {S.host('url')}
      || coalesce(nullif(rtrim(lower({S.path('url')}), '/'), ''), '/') AS fp FROM v_listings),
    t AS (SELECT count(*) AS lookups, count(DISTINCT fp) AS unique_jobs FROM f)
    SELECT lookups, unique_jobs, lookups - unique_jobs AS duplicates,
      (lookups - unique_jobs) / CAST(lookups AS DOUBLE) AS hit_ratio FROM t""",
)
def source_dedup_stats(spark, sf):
    rows = V.v_listings(spark, sf).withColumn(
        "source_fp", source_fingerprint("source", "url", F.lit(None).cast("string"))
    )
    return listings.source_dedup_stats(rows)


@query(
    "source_dedup_known",
    f"""WITH {V.SQL_DOC_LISTINGS}, {V.SQL_DOC_RECRAWL}, k AS ({_sql_source_fp('v_doc_listings')}), r AS ({_sql_source_fp('v_doc_recrawl')})
    SELECT count(DISTINCT source_fp) AS unknown_jobs FROM r WHERE source_fp NOT IN (SELECT source_fp FROM k)""",
)
def source_dedup_known(spark, sf):
    fp = source_fingerprint("source", "url", F.lit(None).cast("string"))
    known = V.v_doc_listings(spark, sf).withColumn("source_fp", fp)
    rows = V.v_doc_recrawl(spark, sf).withColumn("source_fp", fp)
    return listings.dedup_by_source(rows, ["seq"], known).agg(F.count(F.lit(1)).alias("unknown_jobs"))


# --- history -------------------------------------------------------------------

def _seen(spark, sf, mode):
    """Seen store: every document, stored up to 39 days ago."""
    return _fp(V.v_doc_listings(spark, sf), mode).select(
        "url_hash", "content_hash", "desc_hash",
        (F.lit(V.AS_OF).cast("timestamp") - F.make_dt_interval(days=(F.col("seq") % 40).cast("int"))).alias("stored_at"),
    )


def _sql_hashes(src: str, mode: str) -> str:
    content = (
        S.canonical_url("url") + " || '::' || " + S.normalize_title("title") if mode == "url_title" else
        " || '::' || ".join([S.normalize_title("title"), S.normalize_company("company"),
                             S.normalize_location("split_part(location, ',', 1)")])
    )
    return (
        f"SELECT *, {S.hash16(S.canonical_url('url'))} AS url_hash, {S.hash16(content)} AS content_hash, "
        f"{S.hash16(S.normalize_description('description'))} AS desc_hash FROM {src}"
    )


def sql_history(mode: str) -> str:
    return f"""{V.SQL_DOC_LISTINGS}, {V.SQL_DOC_RECRAWL},
    seen AS (SELECT url_hash, content_hash, desc_hash, TIMESTAMP '{V.AS_OF}' - to_days(CAST(seq % 40 AS INTEGER)) AS stored_at
      FROM ({_sql_hashes('v_doc_listings', mode)})),
    batch AS ({_sql_hashes('v_doc_recrawl', mode)}),
    content_keys AS (SELECT content_hash, max(stored_at) AS last_seen, list(DISTINCT desc_hash) AS texts FROM seen GROUP BY 1),
    verdicts AS (SELECT b.seq, b.url, b.url_hash, b.content_hash, b.desc_hash, b.source, CASE
      WHEN b.url_hash IN (SELECT url_hash FROM seen) THEN 'url'
      WHEN list_contains(k.texts, b.desc_hash) OR k.last_seen > TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY THEN 'content'
      ELSE 'none' END AS verdict FROM batch b LEFT JOIN content_keys k ON b.content_hash = k.content_hash)"""


BOARDS = "title_company_location"


@query("history_url_match", f"WITH {sql_history('url_title')} SELECT seq FROM verdicts WHERE verdict = 'url'")
def history_url_match(spark, sf):
    return dedup.match_url(_fp(V.v_doc_recrawl(spark, sf)), _seen(spark, sf, "url_title")).select("seq")


@query(
    "history_content_match",
    f"""WITH {sql_history(BOARDS)} SELECT b.seq FROM batch b JOIN content_keys k ON b.content_hash = k.content_hash
      WHERE list_contains(k.texts, b.desc_hash) OR k.last_seen > TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY""",
)
def history_content_match(spark, sf):
    batch = _fp(V.v_doc_recrawl(spark, sf), BOARDS)
    return dedup.match_content(batch, _seen(spark, sf, BOARDS), V.AS_OF).select("seq")


@query("dedup_verdict", f"WITH {sql_history('url_title')} SELECT seq, verdict FROM verdicts")
def dedup_verdict(spark, sf):
    batch = _fp(V.v_doc_recrawl(spark, sf))
    return dedup.dedup_verdict(batch, _seen(spark, sf, "url_title"), V.AS_OF).select("seq", "verdict")


@query("dedup_verdict_cross_board", f"WITH {sql_history(BOARDS)} SELECT seq, verdict FROM verdicts")
def dedup_verdict_cross_board(spark, sf):
    batch = _fp(V.v_doc_recrawl(spark, sf), BOARDS)
    return dedup.dedup_verdict(batch, _seen(spark, sf, BOARDS), V.AS_OF).select("seq", "verdict")


@query(
    "dedup_stats",
    f"""WITH {sql_history(BOARDS)} SELECT count(*) AS processed, count(*) FILTER (verdict = 'url') AS skipped_url,
      count(*) FILTER (verdict = 'content') AS skipped_content, count(*) FILTER (verdict = 'none') AS stored,
      {S.half_up("count(*) FILTER (verdict <> 'none') / count(*) * 100")} AS dup_rate_pct FROM verdicts""",
)
def dedup_stats(spark, sf):
    batch = _fp(V.v_doc_recrawl(spark, sf), BOARDS)
    return dedup.dedup_stats(dedup.dedup_verdict(batch, _seen(spark, sf, BOARDS), V.AS_OF))


@query(
    "mark_seen",
    f"""WITH {sql_history('url_title')}, added AS (SELECT url_hash, content_hash, desc_hash, TIMESTAMP '{V.AS_OF}' AS stored_at FROM batch),
    both_ AS (SELECT *, 0 AS n FROM seen UNION ALL SELECT *, 1 AS n FROM added)
    SELECT url_hash, content_hash, desc_hash, epoch_us(stored_at) AS stored_us FROM both_
      QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY n DESC, stored_at DESC, content_hash, desc_hash) = 1""",
)
def mark_seen(spark, sf):
    stored = _fp(V.v_doc_recrawl(spark, sf)).withColumn("stored_at", F.lit(V.AS_OF).cast("timestamp"))
    return dedup.mark_seen(_seen(spark, sf, "url_title"), stored).select(
        "url_hash", "content_hash", "desc_hash", F.unix_micros("stored_at").alias("stored_us")
    )


@query(
    "prune_seen",
    f"""WITH {sql_history('url_title')} SELECT url_hash, epoch_us(stored_at) AS stored_us FROM seen
      WHERE stored_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY""",
)
def prune_seen(spark, sf):
    return dedup.prune_seen(_seen(spark, sf, "url_title"), V.AS_OF).select(
        "url_hash", F.unix_micros("stored_at").alias("stored_us")
    )


@query("seen_store_size", f"WITH {sql_history('url_title')} SELECT count(*) AS store_size FROM seen")
def seen_store_size(spark, sf):
    return dedup.store_size(_seen(spark, sf, "url_title"))


# --- stored table -------------------------------------------------------------------

SQL_FPRINT = "sha256(url || '||' || title || '||' || company)"


@query(
    "insert_if_absent",
    f"""WITH {V.SQL_DOC_LISTINGS}, {V.SQL_DOC_RECRAWL},
    target AS (SELECT {SQL_FPRINT} AS fingerprint FROM v_doc_listings),
    offered AS (SELECT seq, {SQL_FPRINT} AS fingerprint FROM (
      SELECT seq, url, title, company FROM v_doc_recrawl UNION ALL SELECT seq + {V.RECRAWL}, url, title, company FROM v_doc_listings
      UNION ALL SELECT seq + 2 * {V.RECRAWL}, url, title, company FROM v_doc_recrawl))
    SELECT fingerprint, min(seq) AS seq FROM offered WHERE fingerprint NOT IN (SELECT fingerprint FROM target) GROUP BY 1""",
)
def insert_if_absent(spark, sf):
    docs, again = V.v_doc_listings(spark, sf), V.v_doc_recrawl(spark, sf)
    target = store.to_stored(listings.stamp(docs, V.AS_OF), V.AS_OF)
    offered = again.unionByName(docs.withColumn("seq", F.col("seq") + V.RECRAWL)).unionByName(
        again.withColumn("seq", F.col("seq") + 2 * V.RECRAWL)
    )
    rows = store.to_stored(listings.stamp(offered, V.AS_OF), V.AS_OF)
    return store.new_rows(rows, target, ["seq"]).select("fingerprint", "seq")


@query(
    "stored_defaults",
    f"""WITH {V.SQL_DOC_LISTINGS}, {SQL_DIRTY} SELECT seq, source AS platform, source,
      coalesce(company, 'Unknown Company') AS company, sha256(url || '||' || title || '||' || coalesce(company, 'Unknown Company'))
      AS fingerprint, 'direct_crawl' AS source_tier FROM dirty""",
)
def stored_defaults(spark, sf):
    dirty = listings.stamp(_dirty(spark, sf), V.AS_OF).withColumn("company", F.coalesce("company", F.lit("Unknown Company")))
    return store.to_stored(dirty, V.AS_OF).select("seq", "platform", "source", "company", "fingerprint", "source_tier")


@query(
    "count_jobs",
    f"WITH {V.SQL_DOC_LISTINGS} SELECT count(DISTINCT {SQL_FPRINT}) AS jobs FROM v_doc_listings",
)
def count_jobs(spark, sf):
    rows = store.to_stored(listings.stamp(V.v_doc_listings(spark, sf), V.AS_OF), V.AS_OF)
    return store.count_jobs(store.new_rows(rows, None, ["seq"]))


@query(
    "limit_per_source",
    f"""WITH {V.SQL_DOC_LISTINGS} SELECT source, location, seq FROM v_doc_listings
      QUALIFY row_number() OVER (PARTITION BY source, location ORDER BY seq) <= 3""",
)
def limit_per_source(spark, sf):
    return listings.limit_results(V.v_doc_listings(spark, sf), ["source", "location"], ["seq"], n=3).select(
        "source", "location", "seq"
    )


@query(
    "fallback_union",
    f"""WITH {V.SQL_LISTINGS}, {V.SQL_DOC_LISTINGS}, p AS (SELECT seq, title, company, location AS k, 'primary' AS origin FROM v_doc_listings),
    s AS (SELECT seq, title, company, source AS k, 'secondary' AS origin FROM v_listings)
    SELECT seq, k, origin FROM p UNION ALL
    SELECT seq, k, origin FROM s WHERE k NOT IN (SELECT k FROM p GROUP BY k HAVING count(*) >= 300)""",
)
def fallback_union(spark, sf):
    primary = V.v_doc_listings(spark, sf).select("seq", F.col("location").alias("k"), F.lit("primary").alias("origin"))
    secondary = V.v_listings(spark, sf).select("seq", F.col("source").alias("k"), F.lit("secondary").alias("origin"))
    return listings.fallback_union(primary, secondary, ["k"], n=300)


@query(
    "pages_until_enough",
    """WITH g AS (SELECT l_orderkey AS q, l_linenumber AS page_no, count(*) AS n_, CAST(max(l_quantity) AS BIGINT) // 10 AS jobs_found
      FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, coalesce(sum(jobs_found) OVER w, 0) AS before_, coalesce(max(CASE WHEN jobs_found = 0 THEN 1 ELSE 0 END) OVER w, 0) AS empty_
      FROM g WINDOW w AS (PARTITION BY q ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT q, CAST(page_no AS BIGINT) AS page_no, jobs_found FROM c WHERE before_ < 6 AND empty_ = 0""",
)
def pages_until_enough(spark, sf):
    found = read_table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").cast("bigint").alias("page_no")
    ).agg(F.floor(F.max("l_quantity") / 10).cast("bigint").alias("jobs_found"))
    return listings.pages_until_enough(found, ["q"], 6).select("q", "page_no", "jobs_found")


@query(
    "union_sources",
    f"""WITH {V.SQL_LISTINGS}, {V.SQL_DOC_LISTINGS} SELECT seq, url, location FROM (
      SELECT seq, url, NULL AS location FROM v_listings UNION ALL SELECT seq, url, location FROM v_doc_listings)""",
)
def union_sources(spark, sf):
    return listings.union_sources([V.v_listings(spark, sf), V.v_doc_listings(spark, sf)]).select("seq", "url", "location")


# --- the whole batch -----------------------------------------------------------------

_SQL_INGEST = f"""{sql_history('url_title')}, {SQL_DIRTY},
    offered AS (SELECT seq, url, title, company, description, source FROM v_doc_recrawl
      UNION ALL SELECT seq + {V.RECRAWL}, url, title, company, description, source FROM dirty),
    ok AS (SELECT seq, url, title, coalesce(company, 'Unknown Company') AS company, description, source,
      NOT (regexp_matches(url, '^https?://[^/]') AND length(title) >= 2 AND length(description) >= 10) AS invalid FROM offered),
    hashed AS (SELECT *, {S.hash16(S.canonical_url('url'))} AS url_hash FROM ok WHERE NOT invalid),
    firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY seq) = 1),
    results AS (SELECT source, 'invalid' AS outcome FROM ok WHERE invalid
      UNION ALL SELECT h.source, CASE WHEN f.seq IS NULL OR f.url_hash IN (SELECT url_hash FROM seen) THEN 'duplicate'
        ELSE 'stored' END FROM hashed h LEFT JOIN firsts f ON h.seq = f.seq)"""


def _ingest(spark, sf):
    offered = V.v_doc_recrawl(spark, sf).drop("location").unionByName(
        _dirty(spark, sf).withColumn("seq", F.col("seq") + V.RECRAWL)
    )
    return jobs.ingest_outcomes(offered, _seen(spark, sf, "url_title"), V.AS_OF, order=["seq"])


@query(
    "ingest_breakdown",
    f"""WITH {_SQL_INGEST} SELECT 'direct_crawl' AS source_tier, source, count(*) AS "raw",
      count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'duplicate') AS duplicates,
      count(*) FILTER (outcome = 'invalid') AS invalid FROM results GROUP BY source""",
)
def ingest_breakdown(spark, sf):
    return metrics.tier_breakdown(_ingest(spark, sf))


@query(
    "ingest_summary",
    f"""WITH {_SQL_INGEST} SELECT count(*) FILTER (outcome = 'stored') AS total_stored,
      count(*) FILTER (outcome = 'duplicate') AS total_duplicates, count(*) FILTER (outcome = 'invalid') AS total_invalid FROM results""",
)
def ingest_summary(spark, sf):
    return metrics.run_summary(_ingest(spark, sf))


@query(
    "coverage_gate",
    f"""WITH {V.SQL_LISTINGS}, c AS (SELECT {S.domain_of('url')} AS domain, count(*) AS collected FROM v_listings GROUP BY 1)
    SELECT domain, collected, collected < 25 AS should_launch, collected > 0 AND collected < 25 AS partial_collection,
      CASE WHEN collected >= 25 THEN 'skip-threshold-reached (' || collected || ' >= 25)'
      ELSE 'partial-api-collection (' || collected || '/25)' END AS reason FROM c""",
)
def coverage_gate(spark, sf):
    counts = V.v_listings(spark, sf).groupBy(domain_of("url").alias("domain")).agg(F.count(F.lit(1)).alias("collected"))
    return metrics.coverage_gate(counts)


