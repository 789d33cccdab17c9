"""Queries over page HTML: fields, links and block verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.text import page_title
from postlake.functions.urls import url_host
from postlake.plans import sqltext as S
from postlake.plans import views as V
from postlake.plans.registry import query
from postlake.sources import pages as P
from postlake.sources.tables import read_table


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


_H1 = r"(?is)<h1[^>]*>(.*?)(?:</h1>|$)"
_ART = r"(?is)<article[^>]*>(.*?)(?:</article>|$)"


def _sql_text(pattern: str) -> str:
    """Text of an element, with the entities that the pages hold (some cut off at the end) decoded."""
    return _decoded(S.strip_tags(S.ext("html", pattern)))


def _decoded(text: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, {S.lit(name)}, {S.lit(char)})"
    return f"regexp_replace({text}, '&amp$', '&')"


@query(
    "extract_fields",
    f"""WITH p AS (SELECT page_id, url, regexp_replace(html, '<[a-zA-Z/!][^>]*$', '') AS html FROM pages)
    SELECT page_id, url, coalesce(nullif({_sql_text(_H1)}, ''), {_sql_text('(?is)<title[^>]*>(.*?)(?:</title>|$)')}) AS title,
      {_sql_text(_ART)} AS description FROM p""",
)
def extract_fields(spark, sf):
    return P.extract_fields(_pages(spark, sf)).select("page_id", "url", "title", F.coalesce("description", F.lit("")).alias("description"))


@query(
    "page_links",
    r"""WITH h AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)href="([^"]+)"', 1))) AS href FROM pages),
    r AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN href
        WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href
        WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || href
        WHEN starts_with(href, '#') THEN split_part(url, '#', 1) || href
        WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href
        ELSE regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1) || href END AS link FROM h)
    SELECT DISTINCT page_id, link FROM r WHERE regexp_matches(link, '(?i)^https?://')
      AND lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]*)', 1)) = lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1))
    UNION SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || unnest(['/single?a=1&b=2', '/bare']) FROM pages""",
)
def page_links(spark, sf):
    quoted = F.lit("<a href='/single?a=1&amp;b=2'>s</a><a href=/bare>b</a>")
    return P.page_links(_pages(spark, sf).withColumn("html", F.concat(quoted, "html")))


@query(
    "page_links_same_domain",
    r"""WITH h AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '(?i)href="([^"]+)"', 1))) AS href FROM pages),
    r AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN href
        WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || href END AS link FROM h)
    SELECT DISTINCT page_id, link FROM r WHERE regexp_matches(link, '(?i)^https?://[^/]*/t') AND
      regexp_extract(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]*)', 1), '([^.]+[.][^.]+)$', 1) =
      regexp_extract(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1), '([^.]+[.][^.]+)$', 1)""",
)
def page_links_same_domain(spark, sf):
    return P.page_links(_pages(spark, sf), pattern="(?i)^https?://[^/]*/t", scope="same-domain")


@query(
    "distinct_links",
    r"""SELECT DISTINCT lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || href AS link FROM (
      SELECT url, unnest(regexp_extract_all(html, '(?i)href="(/[^"/][^"]*)"', 1)) AS href FROM pages)""",
)
def distinct_links(spark, sf):
    return P.distinct_links(P.page_links(_pages(spark, sf), pattern="^[^:]+://[^/]+/"))


_MARKUP = {  # site: markup of title and company around the page's own words
    "cutshort": ('<h1 class="a job-title b">{t}</h1>', '<div class="company-box"><i>x</i><span>{c}</span></div>'
                 "<div class='description'><div>Intro</div><p>Must know C &amp; SQL</p></div>"),
    "foundit": ('<h3 class="jobTitle">{t}</h3>', '<span class="companyName">{c}</span>'),
    "timesjobs": ('<h1 class="jd-job-title">{t}</h1>', '<h2 class="heading">{c}</h2>'),
    "wellfound": ('<h1 class="startup-header">{t}</h1>', '<h1 class="styles_name__9">Job at {c} | Site</h1>'),
    "indeed": ('<p data-testid="jobsearch-JobInfoHeader-title">{t}</p>', '<div data-testid="inlineHeader-companyName"><a href="#">{c}</a></div>'),
    "exampleboard": ('<div class="header-title"><h1>{t}</h1></div>', '<p class="employer-label">{c}</p>'),
}


def _marked(spark, sf):
    """Pages of six sites: one marked-up title and company, and the page text."""
    n = (F.col("page_id") % len(_MARKUP) + 1).cast("int")
    base = _pages(spark, sf).select(
        "page_id", "url", F.element_at(F.array(*[F.lit(s) for s in _MARKUP]), n).alias("site"),
        page_title("html").alias("t"), url_host("url").alias("c"), "html",
    )
    mark = F.lit("")
    for site, (title, company) in _MARKUP.items():
        parts = (title + company).replace("{t}", "\x00t\x00").replace("{c}", "\x00c\x00").split("\x00")
        text = F.concat(*[F.col(p) if p in ("t", "c") else F.lit(p) for p in parts])
        mark = F.when(F.col("site") == site, text).otherwise(mark)
    return base.withColumn("html", F.concat(mark, "html")).drop("t", "c")


@query(
    "site_fields",
    f"""SELECT page_id, ([{', '.join(S.lit(s) for s in _MARKUP)}])[page_id % {len(_MARKUP)} + 1] AS site,
      nullif({_decoded(S.strip_tags(S.page_title('html')))}, '') AS title, {S.host('url')} AS company,
      CASE WHEN page_id % {len(_MARKUP)} = 0 THEN 'Intro Must know C & SQL' END AS description FROM pages""",
)
def site_fields(spark, sf):
    return P.site_fields(_marked(spark, sf)).select("page_id", "site", "title", "company", "description")


@query(
    "card_listings",
    f"""WITH p AS (SELECT page_id, url, {_decoded(S.strip_tags(S.page_title('html')))} AS t, {S.host('url')} AS c FROM pages)
    SELECT page_id, CAST(0 AS BIGINT) AS card_no, t AS title, c AS company, 'https://www.naukri.com/j/' || page_id AS url,
      t || ' at ' || c AS description FROM p WHERE t <> ''
    UNION ALL SELECT page_id, 1, 'second', 'Unknown', url, 'details' FROM p""",
)
def card_listings(spark, sf):
    cards = F.concat(
        F.lit('<ul><li class="x jobTuple"><h2 class="title"><a href="/j/'), F.col("page_id").cast("string"), F.lit('">'),
        page_title("html"), F.lit('</a></h2><a class="comp-name company">'), url_host("url"),
        F.lit('</a></li><li class="jobTuple"><h2 class="title">second</h2><a href="'), F.col("url"),
        F.lit('">go</a><div class="job-desc">details</div></li></ul>'),
    )
    pages = _pages(spark, sf).select("page_id", "url", cards.alias("html"))
    return P.card_listings(pages, "naukri").select(
        "page_id", F.col("card_no").cast("bigint").alias("card_no"), "title", "company", "url", "description"
    )


@query(
    "hub_detail_links",
    """SELECT page_id, 'https://www.linkedin.com/jobs/view/' || (10000000000 + page_id) || '/' AS link FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, 'https://www.linkedin.com/jobs/view/' || page_id || '/' FROM pages WHERE page_id % 3 = 0
    UNION ALL SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || '/job/' || page_id || '?a=1&b=2' FROM pages WHERE page_id % 3 = 1
    UNION ALL SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || '/d/' || page_id FROM pages WHERE page_id % 3 = 2""",
)
def hub_detail_links(spark, sf):
    """Hubs of three sites around the pages' own markup: numbered cards, some of them twice, and links by selector."""
    number, way = F.col("page_id").cast("string"), F.col("page_id") % 3
    card = lambda *inside: F.concat(F.lit('<li class="jobs-search-results__list-item"'), *inside, F.lit("</li>"))
    marked = card(F.lit(" data-entity-urn='urn:li:jobPosting:"), (F.col("page_id") + 10_000_000_000).cast("string"), F.lit("'><i>x</i>"))
    linked = card(F.lit('><a href="/other">o</a><a href="https://in.linkedin.com/jobs/view/'), number, F.lit('?trk=1">go</a>'))
    hub = (
        F.when(way == 0, F.concat(marked, linked, marked, card(F.lit(">no number"))))
        .when(way == 1, F.concat(F.lit("<div class='job-card-x'><a href='/job/"), number, F.lit("?a=1&amp;b=2'>t</a></div><a href='https://else.example.com/job/1'>x</a>")))
        .otherwise(F.concat(F.lit("<h2><span><a href=/d/"), number, F.lit(">t</a></span></h2><a href='/no'>n</a>")))
    )
    site = V._pick(["linkedin", "cutshort", "timesjobs"], (way + 1).cast("int"))
    return P.hub_detail_links(_pages(spark, sf).select("page_id", "url", site.alias("site"), hub.alias("html")))


@query(
    "search_cards",
    f"""WITH p AS (SELECT page_id, coalesce(nullif({_decoded(S.strip_tags(S.page_title('html')))}, ''), 'none') AS t, {S.host('url')} AS c FROM pages)
    SELECT page_id, CAST(0 AS BIGINT) AS card_no, 'Card ' || t AS title, c AS company, 'Pune' AS location,
      'https://share.example.com/' || page_id AS url FROM p WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 1, 'Second ' || page_id, 'Unknown', NULL, 'https://www.google.com/r/' || page_id FROM p WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 0, 'Flat ' || t, c, 'Delhi', '' FROM p WHERE page_id % 2 = 1""",
)
def search_cards(spark, sf):
    number = F.col("page_id").cast("string")
    title = F.coalesce(F.nullif(page_title("html"), F.lit("")), F.lit("none"))
    first = F.concat(F.lit("<li data-jds='1' data-share-url='https://share.example.com/"), number, F.lit("'><div role=\"heading\">Card "), title,
                     F.lit("</div><div>"), url_host("url"), F.lit("</div><div>Pune</div><a href='/not'>x</a></li>"))
    second = F.concat(F.lit("<article data-encoded-doc=x><h3>Second "), number, F.lit("</h3><a href='/r/"), number, F.lit("'>go</a></article>"))
    flat = F.concat(F.lit("<ul><div role='listitem'><div>mark</div><h3>Flat "), title, F.lit("</h3><div>"), url_host("url"),
                    F.lit("</div><div>Delhi</div></div></ul>"))
    html = F.when(F.col("page_id") % 2 == 0, F.concat(first, second, first)).otherwise(flat)
    return P.search_cards(_pages(spark, sf).select("page_id", html.alias("html"))).drop("description")


_PLANTED = K.BLOCK_PHRASES + ["just a moment", "sign in to linkedin", "robot", "plain page"]


def _block_pages(spark, sf):
    """Pages with a planted phrase in title, header or late text, per site."""
    n = F.col("page_id")
    phrase = V._pick(_PLANTED, (n % len(_PLANTED) + 1).cast("int"))
    late = F.repeat(F.lit("filler "), 500)
    extra = (
        F.when(n % 4 == 0, F.concat(F.lit("<title>"), F.upper(phrase), F.lit("</title>"), F.col("html")))
        .when(n % 4 == 1, F.concat(F.lit("<header>"), phrase, F.lit("</header>"), F.col("html")))
        .when(n % 4 == 2, F.concat(F.lit("<p>"), late, phrase, F.lit("</p>"), F.col("html")))
        .otherwise(F.col("html"))
    )
    site = V._pick(list(K.SITE_BLOCK_TITLE_PHRASES), (n % len(K.SITE_BLOCK_TITLE_PHRASES) + 1).cast("int"))
    return _pages(spark, sf).select("page_id", "url", site.alias("site"), extra.alias("html"))


def _sql_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {S.lit(p)})" for p in phrases) + ")"


_SQL_SITE = "CASE site " + " ".join(
    f"WHEN {S.lit(s)} THEN {_sql_any('t', ps)}" + (f" OR {_sql_any('url', K.SITE_BLOCK_URL_PARTS[s])}" if s in K.SITE_BLOCK_URL_PARTS else "")
    for s, ps in K.SITE_BLOCK_TITLE_PHRASES.items()
) + " ELSE false END"


@query(
    "blocked_pages",
    f"""WITH q AS (SELECT page_id, url, html, ([{', '.join(S.lit(p) for p in _PLANTED)}])[page_id % {len(_PLANTED)} + 1] AS ph,
      ([{', '.join(S.lit(p) for p in K.SITE_BLOCK_TITLE_PHRASES)}])[page_id % {len(K.SITE_BLOCK_TITLE_PHRASES)} + 1] AS site FROM pages),
    b AS (SELECT page_id, url, site, CASE page_id % 4 WHEN 0 THEN '<title>' || upper(ph) || '</title>' || html
      WHEN 1 THEN '<header>' || ph || '</header>' || html WHEN 2 THEN '<p>' || repeat('filler ', 500) || ph || '</p>' || html ELSE html END AS html FROM q),
    x AS (SELECT page_id, url, site, lower({S.page_title('html')}) AS t, lower({S.visible_body('html')}) AS body FROM b)
    SELECT page_id, site, {_sql_any('t', K.BLOCK_PHRASES)} OR {_sql_any('body', K.BLOCK_PHRASES)} AS blocked, {_SQL_SITE} AS site_blocked FROM x""",
)
def blocked_pages(spark, sf):
    return P.classify_blocked(_block_pages(spark, sf)).drop("url")


@query("page_titles", f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def page_titles(spark, sf):
    return _pages(spark, sf).select("page_id", page_title("html").alias("title"))
