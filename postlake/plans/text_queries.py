"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions import hashing, scalars, text, urls
from postlake.plans import sqltext as S
from postlake.plans import views as V
from postlake.plans.registry import query
from postlake.sources.tables import read_table


@query("base_text", f"SELECT doc_id, {S.base_text('text')} AS base FROM documents")
def base_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", text.base_text("text").alias("base"))


# Titles and companies carry the noise words through the part and nation names.
@query(
    "normalize_title",
    f"""SELECT doc_id, {S.normalize_title("'Sr. ' || text || ' (Remote) - Full Time ' || source")} AS norm_title
    FROM documents""",
)
def normalize_title(spark, sf):
    title = F.concat(F.lit("Sr. "), F.col("text"), F.lit(" (Remote) - Full Time "), "source")
    return read_table(spark, sf, "documents").select("doc_id", text.normalize_title(title).alias("norm_title"))


_COMPANY_TAILS = [" Pvt. Ltd.", " Technologies India Limited", " Inc.", " & Sons", " Global Services Corp"]


@query(
    "normalize_company",
    f"""SELECT c_custkey, {S.normalize_company("c_mktsegment || ' ' || c_name || (["
        + ", ".join(S.lit(t) for t in _COMPANY_TAILS) + "])[c_custkey % 5 + 1]")} AS norm_company FROM customer""",
)
def normalize_company(spark, sf):
    tail = V._pick(_COMPANY_TAILS, (F.col("c_custkey") % 5 + 1).cast("int"))
    name = F.concat("c_mktsegment", F.lit(" "), "c_name", tail)
    return read_table(spark, sf, "customer").select("c_custkey", text.normalize_company(name).alias("norm_company"))


_CITIES = ["Bengaluru", "Bengaluru, Karnataka", "New Delhi", "Gurugram ", "BOMBAY", "Pune (West)", "calcutta"]


@query(
    "normalize_location",
    f"""SELECT s_suppkey, {S.normalize_location("(["
        + ", ".join(S.lit(t) for t in _CITIES) + "])[s_suppkey % 7 + 1]")} AS norm_location FROM supplier""",
)
def normalize_location(spark, sf):
    city = V._pick(_CITIES, (F.col("s_suppkey") % 7 + 1).cast("int"))
    return read_table(spark, sf, "supplier").select("s_suppkey", text.normalize_location(city).alias("norm_location"))


@query("description_hash", f"SELECT doc_id, {S.hash16(S.normalize_description('text'))} AS desc_hash FROM documents")
def description_hash(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", hashing.hash16(text.normalize_description("text")).alias("desc_hash")
    )


@query("canonical_url", f"WITH {V.SQL_LISTINGS} SELECT seq, {S.canonical_url('url')} AS canonical_url FROM v_listings")
def canonical_url(spark, sf):
    return V.v_listings(spark, sf).select("seq", urls.canonical_url("url").alias("canonical_url"))


SQL_FP = f"""
fp AS (SELECT seq, url, title, company, description, source, {S.canonical_url('url')} AS canonical_url,
    {S.normalize_title('title')} AS norm_title, {S.normalize_company('company')} AS norm_company,
    {S.hash16(S.canonical_url('url'))} AS url_hash,
    {S.hash16(S.canonical_url('url') + " || '::' || " + S.normalize_title('title'))} AS content_hash,
    {S.hash16(S.normalize_description('description'))} AS desc_hash FROM v_listings)
"""


@query(
    "listing_fingerprints",
    f"WITH {V.SQL_LISTINGS}, {SQL_FP} SELECT seq, norm_title, norm_company, url_hash, content_hash, desc_hash FROM fp",
)
def listing_fingerprints(spark, sf):
    return hashing.with_fingerprints(V.v_listings(spark, sf)).select(
        "seq", "norm_title", "norm_company", "url_hash", "content_hash", "desc_hash"
    )


@query(
    "row_fingerprint",
    f"WITH {V.SQL_LISTINGS} SELECT seq, sha256(url || '||' || title || '||' || company) AS fingerprint FROM v_listings",
)
def row_fingerprint(spark, sf):
    return V.v_listings(spark, sf).select("seq", hashing.row_fingerprint().alias("fingerprint"))


_ID_URL = (
    "CASE doc_id % 4 WHEN 0 THEN 'https://Jobs.Example.com:443/v/' || doc_id || '/?jk=K' || doc_id "
    "WHEN 1 THEN 'https://jobs.example.com/v/Role-' || doc_id || '/#apply' "
    "WHEN 2 THEN ' https://jobs.example.com/v?jobId=J' || doc_id || '&id=' ELSE 'not a url ' || doc_id END"
)
_ID_SQL_PATH = S.path(S.token("u"))


@query(
    "source_fingerprint",
    f"""WITH d AS (SELECT doc_id, 'Board ' || upper(source) AS src, CASE WHEN doc_id % 3 = 0 THEN ' P' || doc_id END AS pid,
      {_ID_URL} AS u FROM documents),
    parts AS (SELECT doc_id, regexp_replace({S.token('src')}, '[^a-z0-9]+', '-', 'g') AS slug,
      CASE WHEN doc_id % 4 = 3 THEN {S.token('u')} ELSE split_part({S.token('u')}, '://', 1) || '://'
        || {S.host(S.token('u'))} || CASE WHEN rtrim({_ID_SQL_PATH}, '/') = '' THEN '/' ELSE rtrim({_ID_SQL_PATH}, '/') END END AS nurl,
      coalesce(nullif({S.token('pid')}, ''), CASE doc_id % 4 WHEN 0 THEN 'k' || doc_id
        WHEN 1 THEN 'role-' || doc_id WHEN 2 THEN 'j' || doc_id ELSE '' END) AS jid FROM d)
    SELECT doc_id, slug, nurl, jid, slug || '::' || nurl || '::' || jid AS source_fp FROM parts""",
)
def source_fingerprint(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("Board "), F.upper("source")).alias("src"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" P"), F.col("doc_id").cast("string"))).alias("pid"),
        F.expr(_ID_URL).alias("u"),
    )
    return d.select(
        "doc_id", urls.source_slug("src").alias("slug"), urls.source_url("u").alias("nurl"),
        urls.job_id("pid", "u").alias("jid"), urls.source_fingerprint("src", "u", "pid").alias("source_fp"),
    )


_NUMERIC_FORMS = (
    "CASE p_partkey % 4 WHEN 0 THEN 'urn:li:jobPosting:' || (3800000000 + p_partkey) "
    "WHEN 1 THEN '/jobs/view/' || p_partkey || '/?trk=x' WHEN 2 THEN '' || (10000000 + p_partkey) ELSE 'part ' || p_partkey END"
)


@query(
    "numeric_job_id",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(3800000000 + p_partkey AS VARCHAR)
      WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN CAST(10000000 + p_partkey AS VARCHAR) END AS job_id FROM part""",
)
def numeric_job_id(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", urls.numeric_job_id(F.expr(_NUMERIC_FORMS)).alias("job_id"))


@query("page_domains", f"SELECT page_id, {S.domain_of('url')} AS domain FROM pages")
def page_domains(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", urls.domain_of("url").alias("domain"))


@query(
    "paging_offset",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id * 10 ELSE 0 END AS start_offset FROM pages""",
)
def paging_offset(spark, sf):
    link = F.when(
        F.col("page_id") % 2 == 0,
        F.concat(F.lit("https://x.example.com/jobs?q=a&start="), (F.col("page_id") * 10).cast("string"), F.lit("#p")),
    ).otherwise(F.col("url"))
    return read_table(spark, sf, "pages").select("page_id", urls.start_offset(link).alias("start_offset"))


@query(
    "tracker_links",
    f"""WITH l AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.google-analytics.com/c?u=' || url
      WHEN 1 THEN 'https://cdn.example.com/a.png?u=' || url WHEN 2 THEN 'https://bat.bing.com/?u=' || url ELSE url END AS link,
      (['script', 'image', 'xhr', 'font', 'document'])[page_id % 5 + 1] AS asset FROM pages)
    SELECT page_id, asset, {' OR '.join(f"contains(link, {S.lit(t)})" for t in K.TRACKER_FRAGMENTS)} AS tracker,
      ({' OR '.join(f"contains(link, {S.lit(t)})" for t in K.TRACKER_FRAGMENTS)}) OR asset IN {S.sql_list(K.HEAVY_ASSET_TYPES)} AS strict_hit FROM l""",
)
def tracker_links(spark, sf):
    kind = (F.col("page_id") % 4)
    link = (
        F.when(kind == 0, F.concat(F.lit("https://www.google-analytics.com/c?u="), "url"))
        .when(kind == 1, F.concat(F.lit("https://cdn.example.com/a.png?u="), "url"))
        .when(kind == 2, F.concat(F.lit("https://bat.bing.com/?u="), "url"))
        .otherwise(F.col("url"))
    )
    asset = V._pick(["script", "image", "xhr", "font", "document"], (F.col("page_id") % 5 + 1).cast("int"))
    rows = read_table(spark, sf, "pages").select("page_id", asset.alias("asset"), link.alias("link"))
    return rows.select(
        "page_id", "asset", urls.tracker_url("link").alias("tracker"),
        urls.tracker_url("link", "asset", strict=True).alias("strict_hit"),
    )


@query("clean_page_text", f"SELECT page_id, {S.page_text('html')} AS content FROM pages")
def clean_page_text(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", text.page_text("html").alias("content"))


_PROVIDER_PICK = ["anthropic", "groq", "mistral"]


@query(
    "content_gate",
    f"""WITH c AS (SELECT page_id, ([{', '.join(S.lit(p) for p in _PROVIDER_PICK)}])[page_id % 3 + 1] AS provider,
      {S.page_text('html')} AS t FROM pages)
    SELECT page_id, provider, t AS content FROM c WHERE trim(t) <> ''""",
)
def content_gate(spark, sf):
    from postlake.sources.pages import content_gate as gate

    pages = read_table(spark, sf, "pages").withColumn(
        "provider", V._pick(_PROVIDER_PICK, (F.col("page_id") % 3 + 1).cast("int"))
    )
    return gate(pages).select("page_id", "provider", "content")


@query(
    "title_company",
    f"""WITH t AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Role At ' || title || ' | Site' ELSE company END AS heading
      FROM (SELECT page_id, {S.page_title('html')} AS title, {S.host('url')} AS company FROM pages)),
    m AS (SELECT page_id, heading, {S.ws_trim(S.ext('heading', '(?i)at[' + chr(92) + 's]+(.+?)(?:[|]|$)'))} AS found FROM t)
    SELECT page_id, coalesce(nullif(found, ''), heading) AS company FROM m""",
)
def title_company(spark, sf):
    pages = read_table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Role At "), text.page_title("html"), F.lit(" | Site")))
        .otherwise(urls.url_host("url")).alias("heading"),
    )
    return pages.select("page_id", text.title_company("heading").alias("company"))


@query(
    "human_sizes",
    """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 40 + 1) / 100) AS BIGINT) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10)
      ELSE printf('%.2f MB', floor(n / 1048576.0::DOUBLE * 100 + 0.5) / 100) END AS size_text FROM s""",
)
def human_sizes(spark, sf):
    n = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 40 + 1) / 100).cast("bigint")
    return read_table(spark, sf, "orders").select("o_orderkey", scalars.human_size(n).alias("size_text"))


@query(
    "shard_ages",
    f"""WITH {V.SQL_SHARDS} SELECT shard, strftime(mtime, '%Y-%m-%d') AS day,
      {S.half_up(f"(epoch_us(TIMESTAMP '{V.STORAGE_AS_OF}') - epoch_us(mtime)) / 8.64e10::DOUBLE", 1)} AS age_days,
      (epoch_us(TIMESTAMP '{V.STORAGE_AS_OF}') - epoch_us(mtime)) / 8.64e10::DOUBLE >= 7 AS old FROM v_shards""",
)
def shard_ages(spark, sf):
    return V.v_shards(spark, sf).select(
        "shard", scalars.day_key("mtime").alias("day"),
        scalars.age_days_rounded("mtime", V.STORAGE_AS_OF).alias("age_days"),
        (scalars.age_days("mtime", V.STORAGE_AS_OF) >= K.ARCHIVE_AFTER_DAYS).alias("old"),
    )


@query(
    "ist_flags",
    """WITH h AS (SELECT event_id, hour(ts + INTERVAL 330 MINUTES) AS h FROM events)
    SELECT event_id, h >= 9 AND h < 19 AS business, h >= 22 OR h < 6 AS off_hours FROM h""",
)
def ist_flags(spark, sf):
    return read_table(spark, sf, "events").select(
        "event_id", scalars.is_business_hours(F.col("ts").cast("timestamp")).alias("business"),
        scalars.is_off_hours(F.col("ts").cast("timestamp")).alias("off_hours"),
    )


@query(
    "status_classes",
    f"""WITH {V.SQL_TRAFFIC} SELECT event_id, status IN (429, 403, 503) AS limited, CASE WHEN status = 429 THEN 'soft_block'
      WHEN status = 403 THEN 'hard_block' WHEN status = 407 THEN 'proxy_auth' WHEN status >= 500 THEN 'permanent'
      ELSE 'unexpected' END AS failure FROM v_traffic""",
)
def status_classes(spark, sf):
    return V.v_traffic(spark, sf).select(
        "event_id", scalars.is_rate_limited("status").alias("limited"), scalars.failure_class("status").alias("failure")
    )


@query(
    "request_latency",
    """WITH r AS (SELECT event_id, CASE event_type WHEN 'signup' THEN NULL WHEN 'click' THEN 0 ELSE epoch_ms(ts) END AS s,
      epoch_ms(ts) + CAST(floor(value * 10) AS BIGINT) - CASE event_type WHEN 'error' THEN 200 ELSE 0 END AS e FROM events)
    SELECT event_id, CASE WHEN s > 0 AND e - s >= 0 THEN CAST(e - s AS DOUBLE) END AS latency_ms FROM r""",
)
def request_latency(spark, sf):
    kind, ms = F.col("event_type"), F.unix_millis(F.col("ts").cast("timestamp"))
    start = F.when(kind == "signup", F.lit(None)).when(kind == "click", F.lit(0)).otherwise(ms)
    end = ms + F.floor(F.col("value") * 10).cast("bigint") - F.when(kind == "error", F.lit(200)).otherwise(F.lit(0))
    return read_table(spark, sf, "events").select("event_id", scalars.latency_ms(start, end).alias("latency_ms"))
