"""Queries over feed, API, script and model payloads.

The payloads are written from the documents and pages tables (one payload per
row), then read back through the source functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.hashing import hash16
from postlake.functions.text import base_text
from postlake.operators import listings
from postlake.plans import jobs
from postlake.plans import sqltext as S
from postlake.plans import views as V
from postlake.plans.registry import query
from postlake.sources import apis, feeds
from postlake.sources import pages as P
from postlake.sources import responses as R
from postlake.sources.tables import read_table


def _docs(spark, sf):
    """Documents with the plain texts that the payloads carry."""
    return read_table(spark, sf, "documents").select(
        "doc_id", "source", "lang", "text",
        F.concat(F.lit("role "), base_text("text")).alias("t"),
        base_text("text").alias("b"),
    )


_SQL_DOCS = f"""docs AS (SELECT doc_id, source, lang, text, 'role ' || {S.base_text('text')} AS t,
  {S.base_text('text')} AS b FROM documents)"""


def _tag(name: str, value) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name.split(' ')[0]}>"))


def _str(c: str) -> Column:
    return F.col(c).cast("string")


# Every fifth feed opens with an item that can be mended and one that cannot; neither takes the others along.
_DAMAGED = (
    "<item><title>R & D&nbsp;</title><link>https://damaged.example.com/?a=1&b=2</link><description>one<br>two</description></item>"
    "<item><title>open<link>https://lost.example.com/</link></item>"
)


def _feed(*parts) -> Column:
    return F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="urn:dc" xmlns:himalayasJobs="urn:h"><channel><title>feed</title>'),
        F.when(F.col("doc_id") % 5 == 0, F.lit(_DAMAGED)).otherwise(F.lit("")), F.lit("<item>"), *parts, F.lit("</item><item><title></title><link>https://dropped.example.com/</link></item></channel></rss>"),
    )


def _maybe(test: Column, part: Column) -> Column:
    return F.when(test, part).otherwise(F.lit(""))


_N = "doc_id % 4"


@query(
    "feed_location_in_description",
    rf"""WITH {_SQL_DOCS} SELECT doc_id, trim(t) AS title, CASE WHEN {_N} = 0 THEN 'Src ' || source WHEN {_N} = 1 THEN 'Auth ' || source
      ELSE 'Unknown' END AS company, CASE WHEN {_N} < 2 THEN 'Pune ' || lang
      WHEN length(trim(t) || ' ') < 60 THEN trim(t) END AS location,
      CASE WHEN {_N} < 2 THEN 'Pune ' || lang || ' - ' ELSE trim(t) || ' -  ' END || b AS description,
      'https://feed.example.com/i?a=1&d=' || doc_id AS url, 'Mon, 01 Jan 2024 00:00:00 GMT' AS posted_date FROM docs
    UNION ALL SELECT doc_id, 'R & D', 'Unknown', NULL, 'one two', 'https://damaged.example.com/?a=1&b=2', NULL FROM docs
      WHERE doc_id % 5 = 0""".replace("-  ", "- "),
)
def feed_location_in_description(spark, sf):
    n = F.col("doc_id") % 4
    link = F.concat(F.lit("https://feed.example.com/i?a=1&amp;d="), _str("doc_id"))
    lead = F.when(n < 2, F.concat(F.lit("&lt;b&gt;Pune "), F.col("lang"), F.lit("&lt;/b&gt; - "))).otherwise(
        F.concat(F.trim("t"), F.lit(" -  "))
    )
    body = _feed(
        _tag("title", F.concat(F.lit(" "), F.col("t"), F.lit("\n"))),
        _maybe(n != 3, _tag("link", link)), _maybe(n == 3, _tag('guid isPermaLink="false"', link)),
        F.lit("<description><![CDATA["), F.regexp_replace(F.regexp_replace(lead, "&lt;", "<"), "&gt;", ">"), F.col("b"),
        F.lit("]]></description>"),
        _tag("pubDate", F.lit("Mon, 01 Jan 2024 00:00:00 GMT")),
        _maybe(n == 0, _tag("source", F.concat(F.lit("Src "), F.col("source")))),
        _maybe(n == 1, _tag("author", F.concat(F.lit("Auth "), F.col("source")))),
    )
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return feeds.rss_items(payloads, "location_in_description").select(
        "doc_id", "title", "company", "location", "description", "url", "posted_date"
    )


@query(
    "feed_creator_company",
    f"""WITH {_SQL_DOCS}, x AS (SELECT *, CASE WHEN {_N} = 2 THEN t || ' at Big ' || source ELSE trim(t) END AS ti FROM docs)
    SELECT doc_id, ti AS title,
      CASE {_N} WHEN 0 THEN 'Creator ' || source WHEN 1 THEN 'Firm ' || source
        ELSE CASE WHEN contains(ti, ' at ') THEN trim(list_last(string_split(ti, ' at '))) ELSE 'Unknown' END END AS company,
      b AS description, 'https://feed.example.com/c/' || doc_id AS url, 'api' AS source_tier FROM x
    UNION ALL SELECT doc_id, 'R & D', 'Unknown', 'one two', 'https://damaged.example.com/?a=1&b=2', 'api' FROM docs WHERE doc_id % 5 = 0""",
)
def feed_creator_company(spark, sf):
    n = F.col("doc_id") % 4
    body = _feed(
        _tag("title", F.when(n == 2, F.concat("t", F.lit(" at Big "), "source")).otherwise(F.col("t"))),
        _tag("link", F.concat(F.lit("https://feed.example.com/c/"), _str("doc_id"))), _tag("description", F.col("b")),
        _maybe(n == 0, _tag("dc:creator", F.concat(F.lit("Creator "), F.col("source")))),
        _maybe(n == 1, _tag("company", F.concat(F.lit("Firm "), F.col("source")))),
    )
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return feeds.rss_items(payloads, "creator_company").select("doc_id", "title", "company", "description", "url", "source_tier")


@query(
    "feed_role_at_company",
    rf"""WITH {_SQL_DOCS}, x AS (SELECT *, CASE WHEN {_N} = 1 THEN 'dev AT Big ' || source ELSE 'dev ' || doc_id END AS ti FROM docs)
    SELECT doc_id, CASE WHEN {_N} = 1 THEN 'dev' ELSE ti END AS title, CASE {_N} WHEN 0 THEN 'Tag ' || source WHEN 1 THEN 'Big ' || source
      WHEN 2 THEN 'Acme BIG ' || upper(source[1:1]) || source[2:] ELSE 'Unknown' END AS company,
      trim(b) AS description,
      CASE WHEN {_N} = 2 THEN 'https://feed.example.com/companies/acme-BIG-' || source || '/jobs/' || doc_id
        ELSE 'https://feed.example.com/j/' || doc_id END AS url FROM x
    UNION ALL SELECT doc_id, 'R & D', 'Unknown', 'one two', 'https://damaged.example.com/?a=1&b=2' FROM docs WHERE doc_id % 5 = 0""",
)
def feed_role_at_company(spark, sf):
    n = F.col("doc_id") % 4
    body = _feed(
        _tag("title", F.when(n == 1, F.concat(F.lit("dev AT Big "), "source")).otherwise(F.concat(F.lit("dev "), _str("doc_id")))),
        _tag("link", F.when(n == 2, F.concat(F.lit("https://feed.example.com/companies/acme-BIG-"), "source", F.lit("/jobs/"), _str("doc_id")))
             .otherwise(F.concat(F.lit("https://feed.example.com/j/"), _str("doc_id")))),
        _tag("description", F.col("b")),
        _maybe(n == 0, _tag("himalayasJobs:companyName", F.concat(F.lit("Tag "), F.col("source")))),
    )
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return feeds.rss_items(payloads, "role_at_company").select("doc_id", "title", "company", "description", "url")


@query(
    "feed_rejects",
    """SELECT doc_id, item_no, reason FROM (
      SELECT doc_id, CAST(1 AS BIGINT) AS item_no, 'item does not parse' AS reason FROM documents WHERE doc_id % 5 = 0
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END, 'no title' FROM documents)""",
)
def feed_rejects(spark, sf):
    body = _feed(
        _tag("title", F.concat(F.lit("dev "), _str("doc_id"))),
        _tag("link", F.concat(F.lit("https://feed.example.com/j/"), _str("doc_id"))), _tag("description", F.col("b")),
    )
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return feeds.rejected_items(payloads).select("doc_id", F.col("item_no").cast("bigint").alias("item_no"), "reason")


# --- JSON APIs ------------------------------------------------------------------------

@query(
    "api_search_results",
    f"""WITH {_SQL_DOCS} SELECT doc_id, CASE WHEN {_N} = 0 THEN coalesce(text, '') ELSE t END AS title,
      CASE {_N} WHEN 0 THEN 'Firm ' || source WHEN 1 THEN 'Unknown' ELSE 'Various / See Link' END AS company,
      CASE {_N} WHEN 0 THEN 'Pune' WHEN 1 THEN NULL ELSE lang END AS location,
      CASE {_N} WHEN 0 THEN b WHEN 1 THEN t || ' at undefined' WHEN 2 THEN b ELSE t END AS description,
      'https://s.example.com/' || doc_id AS url FROM docs WHERE NOT ({_N} = 0 AND b = '')
    UNION ALL SELECT doc_id, text, 'Firm ' || source, 'Pune', text || ' at Firm ' || source, 'https://s.example.com/' || doc_id
      FROM docs WHERE {_N} = 0 AND b = ''""",
)
def api_search_results(spark, sf):
    n = F.col("doc_id") % 4
    link = F.concat(F.lit("https://s.example.com/"), _str("doc_id"))
    job = F.when(n == 0, F.struct(
        F.col("text").alias("title"), F.concat(F.lit("Firm "), F.col("source")).alias("company"), F.lit("Pune").alias("location"),
        F.col("b").alias("snippet"), link.alias("link"),
    )).otherwise(F.struct(
        F.col("t").alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("location"),
        F.lit(None).cast("string").alias("snippet"), link.alias("link"),
    ))
    organic = F.struct(F.col("t").alias("title"), link.alias("link"), F.when(n == 2, F.col("b")).alias("snippet"))
    body = F.to_json(F.struct(
        F.when(n < 2, F.array(job)).when(n == 2, F.array().cast("array<struct<title:string,company:string,location:string,snippet:string,link:string>>")).alias("jobs"),
        F.array(organic, F.struct(F.lit("").alias("title"), F.lit("x").alias("link"), F.lit(None).cast("string").alias("snippet"))).alias("organic"),
    ))
    payloads = _docs(spark, sf).select("doc_id", F.col("lang").alias("location"), body.alias("body"))
    return apis.api_serp(payloads).select("doc_id", "title", "company", "location", "description", "url")


@query(
    "api_board_results",
    f"""WITH {_SQL_DOCS} SELECT doc_id, CASE WHEN {_N} = 3 THEN 'Designated ' || doc_id ELSE t END AS title, CASE WHEN {_N} = 2 THEN 'Unknown' ELSE 'Firm ' || source END AS company,
      CASE {_N} WHEN 0 THEN 'Place ' || lang WHEN 1 THEN 'Loc ' || lang END AS location, text AS description,
      CASE {_N} WHEN 0 THEN 'https://b.example.com/' || doc_id WHEN 1 THEN 'https://www.naukri.com/rel/' || doc_id
        ELSE 'https://www.naukri.com/job-listings-' || doc_id END AS url,
      CASE WHEN {_N} = 0 THEN '5 LPA' END AS salary, CASE WHEN {_N} = 0 THEN '0-1 yrs' END AS job_type,
      nullif(CAST(doc_id AS VARCHAR), '0') AS platform_job_id FROM docs""",
)
def api_board_results(spark, sf):
    n = F.col("doc_id") % 4
    null = F.lit(None).cast("string")

    def ph(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.alias("label"))

    job = F.struct(
        F.when(n != 3, F.col("t")).alias("title"), F.concat(F.lit("Designated "), _str("doc_id")).alias("designation"),
        F.when(n < 2, F.concat(F.lit("Firm "), F.col("source"))).alias("companyName"),
        F.when(n == 3, F.concat(F.lit("Firm "), F.col("source"))).otherwise(null).alias("company"),
        F.when(n == 0, F.array(
            ph("experience", F.lit("0-1 yrs")), ph("salary", F.lit("5 LPA")), ph("location", F.concat(F.lit("Place "), F.col("lang"))),
        )).alias("placeholders"),
        F.when(n == 1, F.concat(F.lit("Loc "), F.col("lang"))).alias("jobLocation"),
        F.col("text").alias("jobDescription"),
        F.when(n == 0, F.concat(F.lit("https://b.example.com/"), _str("doc_id")))
        .when(n == 1, F.concat(F.lit("/rel/"), _str("doc_id"))).alias("jdURL"),
        F.col("doc_id").alias("jobId"),
    )
    body = F.to_json(F.struct(
        F.when(n < 2, F.array(job)).alias("jobDetails"), F.when(n >= 2, F.array(job)).alias("data")
    ))
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return apis.api_board(payloads).select(
        "doc_id", "title", "company", "location", "description", "url", "salary", "job_type", "platform_job_id"
    )


@query(
    "api_aggregator_results",
    f"""WITH {_SQL_DOCS} SELECT doc_id, t AS title, CASE WHEN {_N} = 0 THEN 'Unknown' ELSE 'Firm ' || source END AS company,
      CASE {_N} WHEN 0 THEN 'Remote' WHEN 1 THEN 'Pune, MH, IN' WHEN 2 THEN 'Pune, IN' END AS location, text AS description,
      'https://a.example.com/' || doc_id AS url, CASE {_N} WHEN 0 THEN 'USD100-200/MONTH' WHEN 1 THEN '₹100+/year' END AS salary FROM docs""",
)
def api_aggregator_results(spark, sf):
    n = F.col("doc_id") % 4
    job = F.struct(
        F.when(n != 0, F.concat(F.lit("Firm "), F.col("source"))).alias("employer_name"), F.col("t").alias("job_title"),
        F.col("text").alias("job_description"), F.concat(F.lit("https://a.example.com/"), _str("doc_id")).alias("job_apply_link"),
        F.when(n < 3, F.lit("Pune")).otherwise(F.lit("")).alias("job_city"), F.when(n == 1, F.lit("MH")).alias("job_state"),
        F.when(n < 3, F.lit("IN")).alias("job_country"), F.when(n < 2, F.lit(100)).otherwise(F.lit(0)).alias("job_min_salary"),
        F.when(n == 0, F.lit(200)).alias("job_max_salary"), F.when(n == 0, F.lit("USD")).alias("job_salary_currency"),
        F.when(n == 0, F.lit("MONTH")).alias("job_salary_period"), (n == 0).alias("job_is_remote"),
    )
    dropped = F.struct(*[F.lit("x").alias(c) for c in ("job_title",)], F.lit("").alias("job_apply_link"))
    body = F.concat(
        F.lit('{"status":"OK","data":['), F.to_json(job), F.lit(","), F.to_json(dropped), F.lit("]}")
    )
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return apis.api_aggregator(payloads).select("doc_id", "title", "company", "location", "description", "url", "salary")


@query(
    "fetch_batches",
    f"""WITH {_SQL_DOCS} SELECT source AS batch_source, lang AS tier, doc_id, title FROM (
      SELECT doc_id, source, lang, t || ' a' AS title FROM docs WHERE {_N} < 2 UNION ALL
      SELECT doc_id, source, lang, t || ' b' AS title FROM docs WHERE {_N} < 2 UNION ALL
      SELECT doc_id, source, lang, NULL AS title FROM docs WHERE {_N} >= 2)""",
)
def fetch_batches(spark, sf):
    def listing(mark):
        return F.struct(
            F.concat(F.col("t"), F.lit(mark)).alias("title"), F.col("source").alias("company"), _str("doc_id").alias("url")
        )

    batches = _docs(spark, sf).select(
        "source", F.col("lang").alias("tier"), F.lit(1).cast("bigint").alias("duration_ms"), _str("doc_id").alias("error"),
        F.when(F.col("doc_id") % 4 < 2, F.array(listing(" a"), listing(" b"))).otherwise(
            F.array().cast("array<struct<title:string,company:string,url:string>>")
        ).alias("jobs"),
    )
    return apis.explode_batches(batches).select(
        "batch_source", "tier", F.col("error").cast("bigint").alias("doc_id"), "title"
    )


# --- JSON inside pages ---------------------------------------------------------------------

@query(
    "jsonld_postings",
    f"""WITH {_SQL_DOCS} SELECT doc_id, CASE WHEN {_N} = 3 THEN t || ' second' ELSE t END AS title, 'Firm ' || source AS company, 'Pune' AS location,
      b AS description, 'https://ld.example.com/' || doc_id AS url, '5000' AS salary, CAST(doc_id AS VARCHAR) AS platform_job_id
      FROM docs""",
)
def jsonld_postings(spark, sf):
    n = F.col("doc_id") % 4

    def posting(title):
        return F.to_json(F.struct(
            F.lit("JobPosting").alias("@type"), title.alias("title"),
            F.struct(F.concat(F.lit("Firm "), F.col("source")).alias("name")).alias("hiringOrganization"),
            F.struct(F.struct(F.lit("Pune").alias("addressLocality")).alias("address")).alias("jobLocation"),
            F.concat(F.lit("<p>"), F.col("b"), F.lit("</p>")).alias("description"),
            F.concat(F.lit("https://ld.example.com/"), _str("doc_id")).alias("url"),
            F.struct(F.struct(F.lit(5000).alias("value")).alias("value")).alias("baseSalary"),
            F.struct(F.col("doc_id").alias("value")).alias("identifier"),
        ))

    one, other = posting(F.col("t")), F.lit('{"@type":"WebSite","title":"not a posting"}')
    second = posting(F.concat(F.col("t"), F.lit(" second")))
    block = (
        F.when(n == 0, one)
        .when(n == 1, F.concat(F.lit("["), other, F.lit(","), one, F.lit("]")))
        .when(n == 2, F.concat(F.lit('{"@context":"https://schema.org","@graph":['), one, F.lit(","), other, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), second, F.lit("]")))
    )
    html = F.concat(
        F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), block,
        F.lit("</script><script>var x = 1;</script><p>body</p></html>"),
    )
    pages = _docs(spark, sf).select("doc_id", F.lit("u").alias("url"), html.alias("html"))
    return P.jsonld_postings(pages).select(
        "doc_id", "title", "company", "location", "description", "url", "salary", "platform_job_id"
    )


@query(
    "script_variable_rows",
    f"""WITH {_SQL_DOCS} SELECT doc_id, t AS title, CASE WHEN {_N} = 0 THEN 'Unknown' ELSE 'Firm ' || source END AS company,
      CASE WHEN {_N} < 2 THEN 'Pune, ' || lang END AS location, 'https://internshala.com/internship/detail/' || (doc_id + 1) AS url,
      'Internship' AS job_type, CASE WHEN {_N} = 0 THEN '9000' END AS salary, CAST(doc_id + 1 AS VARCHAR) AS platform_job_id FROM docs""",
)
def script_variable_rows(spark, sf):
    n = F.col("doc_id") % 4
    item = F.struct(
        (F.col("doc_id") + 1).alias("id"), F.col("t").alias("title"),
        F.when(n != 0, F.concat(F.lit("Firm "), F.col("source"))).alias("company_name"),
        F.when(n < 2, F.array(F.lit("Pune"), F.col("lang"))).alias("location_names"),
        F.when(n == 0, F.struct(F.lit(9000).alias("salary"))).alias("stipend"),
    )
    html = F.concat(
        F.lit("<script>var a = [1]; internship_list_data = "), F.to_json(F.array(item)),
        F.lit(";\nvar more = [2];</script>"),
    )
    pages = _docs(spark, sf).select("doc_id", F.lit("u").alias("url"), html.alias("html"))
    return P.script_var_listings(pages).select(
        "doc_id", "title", "company", "location", "url", "job_type", "salary", "platform_job_id"
    )


# --- landed model responses ------------------------------------------------------------------

_FORMATS = ["openai", "anthropic", "gemini", "ollama"]


def _records() -> Column:
    """Two records per document: one for starters, one not (by document)."""
    n = F.col("doc_id") % 3
    first = F.struct(
        F.concat(F.lit(" "), F.col("t")).alias("title"), F.concat(F.lit("Firm "), F.col("source"), F.lit(" ")).alias("company"),
        F.lit("").alias("location"), F.concat(F.lit("apply/"), _str("doc_id")).alias("applyLink"), (n == 0).alias("isFresher"),
        F.when(n == 1, F.lit("0-1 years")).otherwise(F.lit("2+ years")).alias("experienceNormalized"),
        F.col("b").alias("rawDescription"),
    )
    second = F.struct(
        F.concat(F.col("t"), F.lit(" two")).alias("title"), F.concat(F.lit("Firm "), F.col("source")).alias("company"),
        F.lit("Pune").alias("location"), F.concat(F.lit("https://x.example.com/"), _str("doc_id")).alias("applyLink"),
        F.lit(False).alias("isFresher"), F.lit("Fresher").alias("experienceNormalized"), F.lit(None).cast("string").alias("rawDescription"),
    )
    records = F.to_json(F.array(first, second))
    # every fifth answer names a title twice: the last one counts
    return F.when(F.col("doc_id") % 5 == 0, F.replace(records, F.lit('[{"title":'), F.lit('[{"title":"old","title":'))).otherwise(records)


def _responses(spark, sf):
    """Responses in all four formats: as tool call or text, wrapped or chatty."""
    n, way = F.col("doc_id") % 4, F.floor(F.col("doc_id") / 4) % 4
    arr = F.col("arr")
    said = (
        F.when(way == 0, F.concat(F.lit('{"jobs":'), arr, F.lit("}")))
        .when(way == 1, F.concat(F.lit("Here you go: "), arr, F.lit(" Hope it helps.")))
        .when(way == 2, F.concat(F.lit('{"note":"[none]","zeta":'), arr, F.lit(',"alpha":[]}')))
        .otherwise(arr)
    )
    as_text = F.to_json(F.struct(F.col("said").alias("v")))
    quoted = F.expr("substring(quoted_json, 6, length(quoted_json) - 6)")  # {"v":"..."} -> "..."
    usage = F.concat(F.lit('"usage":{"prompt_tokens":1,"total_tokens":'), (F.col("doc_id") + 1).cast("string"), F.lit("}"))
    q = F.col("quoted")
    tool = way == 0
    obj = F.col("said")
    body = (
        F.when((n == 0) & tool, F.concat(F.lit('{"choices":[{"message":{"content":null,"tool_calls":[{"function":{"arguments":'), q, F.lit("}}]}}],"), usage, F.lit("}")))
        .when(n == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), q, F.lit("}}],"), usage, F.lit("}")))
        .when((n == 1) & tool, F.concat(F.lit('{"content":[{"type":"text","text":"no"},{"type":"tool_use","input":'), obj, F.lit('}],"usage":{"input_tokens":2,"output_tokens":'), _str("doc_id"), F.lit("}}")))
        .when(n == 1, F.concat(F.lit('{"content":[{"type":"text","text":'), q, F.lit('}],"usage":{"input_tokens":2,"output_tokens":'), _str("doc_id"), F.lit("}}")))
        .when((n == 2) & tool, F.concat(F.lit('{"candidates":[{"content":{"parts":[{"functionCall":{"args":'), obj, F.lit('}}]}}],"usageMetadata":{"totalTokenCount":'), _str("doc_id"), F.lit("}}")))
        .when(n == 2, F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), q, F.lit('}]}}],"usageMetadata":{"totalTokenCount":'), _str("doc_id"), F.lit("}}")))
        .when(tool, F.concat(F.lit('{"message":{"tool_calls":[{"function":{"arguments":'), obj, F.lit("}}]}}")))
        .otherwise(F.concat(F.lit('{"message":{"content":'), q, F.lit("}}")))
    )
    return (
        _docs(spark, sf).withColumn("arr", _records()).withColumn("said", said)
        .withColumn("quoted_json", as_text).withColumn("quoted", quoted)
        .select(
            "doc_id", V._pick(_FORMATS, (n + 1).cast("int")).alias("api_format"),
            V._pick(_FORMATS, (n + 1).cast("int")).alias("provider"),
            F.concat(F.lit("https://m.example.com/p/"), _str("doc_id")).alias("page_url"), F.lit("BOARD_HUB").alias("source_label"),
            body.alias("body"),
        )
    )


def _sql_object(*pairs: tuple[str, str]) -> str:
    """JSON text of an object; the values are SQL for JSON values."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in pairs) + " || '}'"


def _sql_records(ordered: bool) -> str:
    """The two records as JSON text, with names in the order written or in the order of a parsed object."""
    def text(x):
        return f"""'"' || {x} || '"'"""

    first = [
        ("title", text("' ' || t")), ("company", text("'Firm ' || source || ' '")), ("location", text("''")),
        ("applyLink", text("'apply/' || doc_id")), ("isFresher", "CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END"),
        ("experienceNormalized", text("CASE WHEN doc_id % 3 = 1 THEN '0-1 years' ELSE '2+ years' END")), ("rawDescription", text("b")),
    ]
    second = [
        ("title", text("t || ' two'")), ("company", text("'Firm ' || source")), ("location", text("'Pune'")),
        ("applyLink", text("'https://x.example.com/' || doc_id")), ("isFresher", "'false'"), ("experienceNormalized", text("'Fresher'")),
    ]
    if ordered:
        first, second = sorted(first), sorted(second)
    return f"'[' || {_sql_object(*first)} || ',' || {_sql_object(*second)} || ']'"


@query(
    "model_payloads",
    f"""WITH {_SQL_DOCS}, arr AS (SELECT doc_id, {_sql_records(True)} AS parsed,
      CASE WHEN doc_id % 5 = 0 THEN replace({_sql_records(False)}, '[{{"title":', '[{{"title":"old","title":') ELSE {_sql_records(False)} END AS plain FROM docs)
    SELECT doc_id, (['openai', 'anthropic', 'gemini', 'ollama'])[doc_id % 4 + 1] AS api_format,
      sha256(CASE (doc_id // 4) % 4 WHEN 0 THEN '{{"jobs":' || CASE WHEN doc_id % 4 = 0 THEN plain ELSE parsed END || '}}'
        WHEN 1 THEN 'Here you go: ' || plain || ' Hope it helps.' WHEN 2 THEN '{{"note":"[none]","zeta":' || plain || ',"alpha":[]}}'
        ELSE plain END) AS payload_hash FROM arr""",
)
def model_payloads(spark, sf):
    rows = R.response_payload(_responses(spark, sf))
    return rows.select("doc_id", "api_format", F.sha2("payload", 256).alias("payload_hash"))


_SQL_RECORDS = f"""{_SQL_DOCS}, rec AS (
  SELECT doc_id, 0 AS item_no, trim(t) AS title, 'Firm ' || source AS company, '' AS location,
    'https://m.example.com/apply/' || doc_id AS apply_link, doc_id % 3 = 0 AS is_fresher,
    CASE WHEN doc_id % 3 = 1 THEN '0-1 years' ELSE '2+ years' END AS band, b AS raw_description FROM docs
  UNION ALL SELECT doc_id, 1, trim(t || ' two'), 'Firm ' || source, 'Pune', 'https://x.example.com/' || doc_id, false, 'Fresher', NULL FROM docs)"""


@query(
    "model_records",
    f"""WITH {_SQL_RECORDS} SELECT doc_id, CAST(item_no AS BIGINT) AS item_no, title, company, location, 'Full Time' AS job_type, apply_link,
      'board' AS source, is_fresher, band AS experience_normalized, raw_description FROM rec""",
)
def model_records(spark, sf):
    rows = R.sanitize_records(R.salvage_records(R.response_payload(_responses(spark, sf))))
    return rows.select(
        "doc_id", F.col("item_no").cast("bigint").alias("item_no"), "title", "company", "location", "job_type", "apply_link",
        "source", "is_fresher", "experience_normalized", "raw_description",
    )


_SQL_FRESH = f"{_SQL_RECORDS}, fresh AS (SELECT * FROM rec WHERE is_fresher OR band IN ('Fresher', '0-1 years'))"


@query(
    "model_records_normalized",
    f"""WITH {_SQL_FRESH} SELECT doc_id, {S.hash16("title || '|' || company || '|' || apply_link")} AS id,
      coalesce(nullif(location, ''), 'India') AS location, apply_link FROM fresh""",
)
def model_records_normalized(spark, sf):
    rows = R.sanitize_records(R.salvage_records(R.response_payload(_responses(spark, sf))))
    return R.normalize_records(R.fresher_only(rows)).select("doc_id", "id", "location", "apply_link")


@query(
    "model_listings",
    f"""WITH {_SQL_FRESH} SELECT title, company, coalesce(raw_description, title || ' at ' || company) AS description, apply_link AS url,
      'board' AS source, coalesce(nullif(location, ''), 'India') AS location, apply_link AS apply_url, 'Full Time' AS job_type,
      CAST(NULL AS VARCHAR) AS experience, 'headless' AS source_tier FROM fresh""",
)
def model_listings(spark, sf):
    return jobs.extract_from_responses(_responses(spark, sf))


@query(
    "model_token_usage",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id + 1 WHEN 1 THEN doc_id + 2 WHEN 2 THEN doc_id ELSE 0 END AS tokens FROM documents""",
)
def model_token_usage(spark, sf):
    return R.token_usage(_responses(spark, sf)).select("doc_id", "tokens")


_VIA = "doc_id % 4"  # 0: cached answer, 1: landed answer, 2: blocked page, 3: no answer, read by rules


@query(
    "page_extraction",
    f"""WITH {_SQL_FRESH} SELECT doc_id, 'model' AS via, title FROM fresh WHERE {_VIA} < 2
    UNION ALL SELECT doc_id, 'blocked', NULL FROM docs WHERE {_VIA} = 2
    UNION ALL SELECT doc_id, 'rules', 'Heading ' || doc_id FROM docs WHERE {_VIA} = 3
    UNION ALL SELECT doc_id, 'rules', 'Heading ' || doc_id FROM docs WHERE {_VIA} < 2 AND doc_id NOT IN (SELECT doc_id FROM fresh)""",
)
def page_extraction(spark, sf):
    """A page per document: cached, answered, blocked or read by rules, over a cache with outdated entries."""
    out = _extracted(spark, sf)
    number = lambda c: F.regexp_extract(c, r"/(\d+)$", 1).cast("bigint").alias("doc_id")
    return out["extracted"].select(number("page_url"), F.lit("model").alias("via"), "title").unionByName(
        out["blocked"].select(number("url"), F.lit("blocked").alias("via"), F.lit(None).cast("string").alias("title"))
    ).unionByName(out["by_rules"].select(number("url"), F.lit("rules").alias("via"), "title"))


@query(
    "page_cache_entries",
    f"""WITH {_SQL_FRESH} SELECT doc_id, count(*) AS jobs FROM fresh WHERE {_VIA} = 1 GROUP BY 1""",
)
def page_cache_entries(spark, sf):
    """What a run adds to the cache: the records of the pages it had no entry for."""
    entries = _extracted(spark, sf)["cache_entries"]
    return entries.select(
        F.regexp_extract("page_url", r"/(\d+)$", 1).cast("bigint").alias("doc_id"),
        F.size(F.from_json("jobs", "array<string>")).cast("bigint").alias("jobs"),
    )


def _extracted(spark, sf):
    via = F.col("doc_id") % 4
    phrase = F.when(via == 2, F.lit("<header>Access denied</header>")).otherwise(F.lit(""))
    docs = _docs(spark, sf).withColumn("url", F.concat(F.lit("https://m.example.com/p/"), _str("doc_id"))).withColumn(
        "html", F.concat(F.lit("<html><h1>Heading "), _str("doc_id"), F.lit("</h1>"), phrase, F.lit("<p>"), F.col("lang"), F.lit("</p></html>"))
    )
    pages = docs.select("doc_id", F.col("doc_id").alias("page_id"), "url", F.lit("board").alias("site"), "html")
    held = docs.withColumn("jobs", _records()).filter(via == 0).select(hash16("html").alias("content_hash"), "jobs")
    now = F.lit(V.AS_OF).cast("timestamp")
    cache = held.withColumn("cached_at", now - F.expr("INTERVAL 1 HOUR")).unionByName(
        held.select("content_hash", F.lit("[]").alias("jobs"), (now - F.expr("INTERVAL 5 HOURS")).alias("cached_at"))
    )
    answers = _responses(spark, sf).filter(via == 1)
    return jobs.extract_pages(pages.drop("doc_id"), answers, cache, V.AS_OF)


@query(
    "feed_keyword_matches",
    f"""WITH {_SQL_DOCS} SELECT doc_id FROM docs WHERE contains(lower('dev ' || doc_id), 'thining') OR contains(b, 'thining')""",
)
def feed_keyword_matches(spark, sf):
    body = _feed(
        _tag("title", F.concat(F.lit("dev "), _str("doc_id"))),
        _tag("link", F.concat(F.lit("https://feed.example.com/j/"), _str("doc_id"))), _tag("description", F.col("b")),
    )
    payloads = _docs(spark, sf).select("doc_id", body.alias("body"))
    return listings.keyword_any(feeds.rss_items(payloads, "creator_company"), "thining").select("doc_id")
