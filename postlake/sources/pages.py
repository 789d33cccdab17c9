"""Page HTML to listings, links and block verdicts.

Rules on whole elements are joined with the element table (``elements``),
everything else is one projection; the wide ``html`` column is dropped as soon
as its fields are out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.documents import parse_json
from postlake.functions.text import (
    as_col, contains_any, content_cap, empty_to_null, head, literal_pattern, page_text, page_title, title_company,
    visible_body, ws_trim,
)
from postlake.functions.urls import numeric_job_id, url_host, url_origin, url_scheme
from postlake.sources import elements as E

_LD_BLOCK = r'(?is)<script(?=[^<>]*\stype\s*=\s*["\']?application/ld\+json["\'\s>])[^<>]*>(.*)\z'


def jsonld_postings(pages: DataFrame, graph: bool = True, max_chars: int | None = None) -> DataFrame:
    """JobPosting blocks embedded in pages: object, array or ``@graph`` form."""
    blocks = pages.select(
        *[c for c in pages.columns if c != "html"],
        F.explode(F.filter(  # what stands before a closing tag, from the last opening tag of its kind on
            F.transform(F.split("html", r"(?i)</script\s*>"), lambda part: F.regexp_extract(part, _LD_BLOCK, 1)), lambda b: b != ""
        )).alias("block"),
    ).withColumn("doc", parse_json("block"))
    as_items = F.try_variant_get("doc", "$", "array<variant>")
    wrapped = F.when(F.col("doc").isNotNull(), F.array("doc"))
    if graph:
        wrapped = F.coalesce(F.try_variant_get("doc", "$['@graph']", "array<variant>"), wrapped)
    kept = [c for c in pages.columns if c not in ("html", "url")]
    item = blocks.select(*kept, F.explode(F.coalesce(as_items, wrapped)).alias("item"))

    def get(path: str) -> Column:
        return F.try_variant_get("item", path, "string")

    return (
        item.filter((get("$['@type']") == "JobPosting") & empty_to_null(get("$.title")).isNotNull())
        .select(
            *kept,
            get("$.title").alias("title"),
            F.coalesce(get("$.hiringOrganization.name"), F.lit("Unknown")).alias("company"),
            F.coalesce(get("$.jobLocation.address.addressLocality"), get("$.jobLocation.name")).alias("location"),
            head(ws_trim(F.regexp_replace(F.coalesce(get("$.description"), F.lit("")), "<[^<>]*>", " ")), max_chars)
            .alias("description"),
            F.coalesce(get("$.url"), get("$.directApply"), F.lit("")).alias("url"),
            F.coalesce(get("$.baseSalary.value.value"), get("$.estimatedSalary[0].value")).alias("salary"),
            get("$.employmentType").alias("job_type"),
            get("$.datePosted").alias("posted_date"),
            empty_to_null(get("$.identifier.value")).alias("platform_job_id"),
        )
    )


_SCRIPT_ROW = (
    "ARRAY<STRUCT<id STRING, title STRING, company_name STRING, location_names ARRAY<STRING>, "
    "stipend STRUCT<salary STRING>>>"
)


def script_var_rows(pages: DataFrame, var: str = "internship_list_data", schema: str = _SCRIPT_ROW) -> DataFrame:
    """Rows of a JSON array assigned to a script variable."""
    text = F.regexp_extract("html", rf"(?s){var}\s*=\s*(\[.*?\]);", 1)
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, F.explode(F.from_json(text, schema, {"mode": "PERMISSIVE"})).alias("item"))


def script_var_listings(pages: DataFrame, origin: str = "https://internshala.com") -> DataFrame:
    item = F.col("item")
    kept = [c for c in pages.columns if c not in ("html", "url")]
    return (
        script_var_rows(pages)
        .filter(empty_to_null(item["title"]).isNotNull())
        .select(
            *kept,
            item["title"].alias("title"),
            F.coalesce(item["company_name"], F.lit("Unknown")).alias("company"),
            F.when(item["location_names"].isNotNull(), F.array_join(item["location_names"], ", ")).alias("location"),
            item["title"].alias("description"),
            F.concat(F.lit(f"{origin}/internship/detail/"), F.coalesce(item["id"], F.lit("undefined"))).alias("url"),
            item["stipend"]["salary"].alias("salary"),
            F.lit("Internship").alias("job_type"),
            F.when(~item["id"].isin("", "0"), item["id"]).alias("platform_job_id"),
        )
    )


# (field, priority, selectors): the first element with text in priority order wins.
DEFAULT_RULES = [
    ("title", 1, 'h1[class*="title"]'), ("title", 2, 'h2[class*="title"]'), ("title", 3, "h1"), ("title", 4, "title"),
    ("company", 1, 'span[class*="company"],a[class*="company"],div[class*="company"]'),
    ("location", 1, 'span[class*="loc"],div[class*="loc"]'),
    ("description", 1, 'div[class*="desc"],section[class*="desc"]'), ("description", 2, "article"),
    ("experience", 1, 'span[class*="exp"],div[class*="exp"]'), ("salary", 1, 'span[class*="sal"]'),
    ("job_type", 1, 'span[class*="type"]'), ("posted_date", 1, 'span[class*="date"],time[class*="date"]'),
]


def _fields(pages: DataFrame, rules: list[tuple], names: list[str]) -> DataFrame:
    """The pages' own columns and the first text of each field, by joins of the element table with the rule rows."""
    own, hits = E.landed(pages, rules)
    said = E.with_text(E.whole_paths(hits, rules, ["page_no"]), own)
    found = said.groupBy("page_no").agg(*[E.best(n).alias(n) for n in names])
    return own.select("page_no", "page").join(found, "page_no", "left").select("page.*", *names)


def extract_fields(pages: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Apply ordered field rules; whole elements count, with their nested tags."""
    names = list(dict.fromkeys(field for field, _, _ in rules))
    return _fields(pages, E.rule_rows((None, *rule) for rule in rules), names)


_SITE_NAMES = ["title", "company", "location", "description", "experience", "job_type", "salary", "posted_date", "seniority"]


def site_fields(pages: DataFrame) -> DataFrame:
    """Detail fields by the rules of each page's own ``site``; a field stops at its first rule that gives text."""
    rules = [(site, name, k, paths) for site, own in K.SITE_FIELDS.items() for name, tries in own.items() for k, paths in enumerate(tries)]
    found = _fields(pages, E.rule_rows(rules), _SITE_NAMES)
    # one site writes "Role at Company | .." there
    return found.withColumn("company", F.when(F.col("site") == "wellfound", title_company("company")).otherwise(F.col("company")))


def _cards(hits: DataFrame, *more: str) -> DataFrame:
    """(page_no, card, card_last, ...): found elements, each once however many rules find it."""
    return hits.select("page_no", F.col("number").alias("card"), F.col("last").alias("card_last"), *more).dropDuplicates(["page_no", "card"])


def card_listings(pages: DataFrame, site: str) -> DataFrame:
    """One listing per result card of a search page; a card is a whole element, cards inside a card belong to it."""
    selectors, fields = K.SITE_CARDS[site]
    names = list(fields)
    kept = [c for c in pages.columns if c not in ("html", "url", "site")]
    rules = E.rule_rows([
        (None, "(card)", 0, ",".join(selectors)), (None, "(own)", 0, "[href]"), (None, "(link)", 0, "a[href]"),
        *((None, name, k, paths) for name, tries in fields.items() for k, paths in enumerate(tries)),
    ])
    own, hits = E.landed(pages.drop("site"), rules)
    before = Window.partitionBy("page_no").orderBy("card")
    outer = F.coalesce(F.max("card_last").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    cards = _cards(E.whole_paths(hits.where("field = '(card)'"), rules, ["page_no"])).withColumn("outer", outer).where("card > outer")
    cards = cards.select("page_no", "card", "card_last", (F.row_number().over(before) - 1).cast("bigint").alias("card_no"))
    held = E.inside(hits.where(~F.col("field").isin("(card)", "(own)")), cards)
    said = E.with_text(E.whole_paths(held, rules, ["page_no", "card"]), own)
    href = F.col("attributes")["href"]
    found = said.groupBy("page_no", "card").agg(
        *[E.best(n).alias(n) for n in names], F.min_by(href, F.when((F.col("field") == "(link)") & (href != ""), F.col("number"))).alias("_link")
    )
    addressed = hits.where("field = '(own)'").select("page_no", F.col("number").alias("card"), F.nullif(href, F.lit("")).alias("_own"))
    rows = cards.join(found, ["page_no", "card"], "left").join(addressed, ["page_no", "card"], "left").join(own.select("page_no", "page"), "page_no")
    rows = rows.select(
        *[F.col("page")[c].alias(c) for c in kept], "card_no", F.coalesce("_own", "_link", F.lit("")).alias("_href"), *names
    ).filter(F.col("title").isNotNull())
    lead = "Internship: " if site == "internshala" else ""
    described = F.concat(F.lit(lead), F.col("title"), F.lit(" at "), F.coalesce("company", F.lit("")))
    return rows.select(
        *kept, "card_no", "title", F.coalesce("company", F.lit("Unknown")).alias("company"),
        *[n for n in names if n not in ("title", "company", "description")],
        F.when(F.startswith("_href", F.lit("http")), F.col("_href")).otherwise(
            F.concat(F.lit(K.SITE_CARD_ORIGINS[site]), F.col("_href"))).alias("url"),
        F.coalesce("description", described).alias("description"), F.lit(site).alias("source"),
    )


_HREF = r"""(?i)\shref\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""


def _href(found: Column) -> Column:
    """The value of a found attribute, without its quotes and with its ampersands decoded."""
    value = F.regexp_replace(found, r"""(?is)^\s*href\s*=\s*["']?|["']$""", "")
    for name, char in (("#38", "&"), ("#x26", "&"), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        value = F.replace(value, F.lit(f"&{name};"), F.lit(char))
    return F.trim(value)


def hub_detail_links(pages: DataFrame) -> DataFrame:
    """Detail pages that a hub page of its own ``site`` leads to, once per hub page, and never off the hub's host.

    Sites with numbered listings give the number in a card's own mark or in a link of the card; the detail address is
    built from it, so a listing that stands twice under different links counts once.
    """
    rules = E.rule_rows([
        *((site, "(detail)", 0, ",".join(paths)) for site, paths in K.HUB_LINKS.items()),
        *((site, "(card)", 0, ",".join(cards)) for site, (cards, _, _, _) in K.HUB_NUMBERED.items()),
        *((site, "(link)", 0, ",".join(links)) for site, (_, _, links, _) in K.HUB_NUMBERED.items()),
    ])
    own, hits = E.landed(pages.select("page_id", "url", "site", "html"), rules)
    own = own.select("page_no", "page.*")
    href = F.col("attributes")["href"]
    details = E.whole_paths(hits.where("field = '(detail)'"), rules, ["page_no"]).where(href != "").select("page_no", href.alias("href"))
    absolute = resolve_link("href", "url")
    linked = details.join(own, "page_no").where(url_host(absolute) == url_host("url")).select("page_id", absolute.alias("link"))

    template, mark = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, (_, name, _, address) in K.HUB_NUMBERED.items():
        template = F.when(F.col("site") == site, F.lit(address)).otherwise(template)
        mark = F.when(F.col("site") == site, F.col("attributes")[name]).otherwise(mark)
    cards = _cards(E.whole_paths(hits.where("field = '(card)'"), rules, ["page_no"]), "attributes")
    held = E.inside(hits.where("field = '(link)'"), cards.drop("attributes"))
    links = E.whole_paths(held, rules, ["page_no", "card"]).select("page_no", "card", "number", href.alias("value"))
    marks = cards.join(own, "page_no").select("page_no", "card", F.lit(-1).alias("number"), mark.alias("value"))
    tried = marks.unionByName(links).withColumn("id", numeric_job_id("value"))
    numbers = tried.groupBy("page_no", "card").agg(F.min_by("id", F.when(F.col("id").isNotNull(), F.col("number"))).alias("id")).where("id is not null")
    numbered = numbers.join(own, "page_no").select("page_id", F.replace(template, F.lit("{id}"), F.col("id")).alias("link"))
    return linked.unionByName(numbered).filter(F.col("link").isNotNull()).distinct()


def search_cards(pages: DataFrame, origin: str = "https://www.google.com") -> DataFrame:
    """Listings among search results: marked cards, or the items of a flat list where a page has no marked card.

    A listing stands once per page; descriptions are whole.
    """
    kept = [c for c in pages.columns if c not in ("html", "url", "site")]
    rules = E.rule_rows([
        (None, "card", 0, ",".join(K.SEARCH_CARDS)), (None, "item", 0, '[role="listitem"]'), (None, "link", 0, "a[href]"),
        *((None, "title", k, path) for k, path in enumerate(K.SEARCH_TITLES)), (None, "block", 0, "div,div span"),
        (None, "company", 0, '[class*="company"]'), (None, "place", 0, '[class*="location"]'),
        *((None, "item_title", k, path) for k, path in enumerate(["h3", '[role="heading"]'])), (None, "item_block", 0, "div"),
    ])
    own, hits = E.landed(pages.drop("site"), rules)
    is_card = F.col("field").isin("card", "item")
    found = E.with_text(E.whole_paths(hits.where(is_card), rules, ["page_no"]), own)
    cards = found.select(
        "page_no", F.col("field").alias("kind"), F.col("number").alias("card"), F.col("last").alias("card_last"),
        F.col("said").alias("description"), F.col("attributes")["data-share-url"].alias("share"),
    ).dropDuplicates(["page_no", "kind", "card"])
    scope = ["page_no", "kind", "card"]
    held = E.inside(hits.where(~is_card), cards.select(*scope, "card_last"))
    said = E.with_text(E.whole_paths(held, rules, scope), own)
    blocks = lambda field: F.transform(F.array_sort(F.collect_list(  # noqa: E731 - the blocks of one card
        F.when(F.col("field") == field, F.struct("number", "said")))), lambda b: b["said"])
    parts = said.groupBy(*scope).agg(
        E.best("title").alias("card_title"), E.best("item_title").alias("item_title"), E.best("company").alias("company"),
        E.best("place").alias("place"), blocks("block").alias("blocks"), blocks("item_block").alias("item_blocks"),
        F.min_by(F.col("attributes")["href"], F.when(F.col("field") == "link", F.col("number"))).alias("link"),
    )
    full = F.filter("blocks", lambda b: (b != "") & ~b.eqNullSafe(F.col("card_title")))
    card = F.col("kind") == "card"
    rows = cards.join(parts, scope).select(
        *scope, "description", F.when(card, F.col("card_title")).otherwise(F.col("item_title")).alias("title"),
        F.when(card, F.coalesce("company", F.get(full, F.lit(0)))).otherwise(F.get("item_blocks", F.lit(1))).alias("company"),
        F.when(card, F.coalesce("place", F.get(full, F.lit(1)))).otherwise(F.get("item_blocks", F.lit(2))).alias("location"),
        F.coalesce(F.when(card, F.nullif("share", F.lit(""))), "link", F.lit("")).alias("url"),
    ).where((F.col("title") != "") & (~card | (F.length("title") > 3)))
    again = Window.partitionBy("page_no", "kind", "title", F.when(card, F.coalesce("company", F.lit("")))).orderBy("card")
    kinds = Window.partitionBy("page_no")
    rows = rows.withColumn("again", F.row_number().over(again)).where("again = 1").withColumn("first_kind", F.min("kind").over(kinds)).where(
        "kind = first_kind").withColumn("card_no", F.row_number().over(kinds.orderBy("card")).cast("bigint") - 1)
    url = F.when((F.col("url") == "") | F.startswith("url", F.lit("http")), F.col("url")).otherwise(F.concat(F.lit(origin), F.col("url")))
    return rows.join(own.select("page_no", "page"), "page_no").select(
        *[F.col("page")[c].alias(c) for c in kept], "card_no", "title", F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown")).alias("company"),
        F.nullif("location", F.lit("")).alias("location"), url.alias("url"), "description",
    )


def resolve_link(href, page_url) -> Column:
    """Absolute form of a link found on a page."""
    h, base = as_col(href), as_col(page_url)
    return (
        F.when(F.rlike(h, F.lit(r"(?i)^[a-z][a-z0-9+.\-]*:")), h)
        .when(F.startswith(h, F.lit("//")), F.concat(url_scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(url_origin(base), h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), h))
        .when(F.startswith(h, F.lit("?")), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), h))
        .otherwise(F.concat(
            F.when(
                F.rlike(base, F.lit("^[^:]+://[^/?#]+/")), F.regexp_extract(base, r"^([^:]+://[^?#]*/)", 1)
            ).otherwise(F.concat(url_origin(base), F.lit("/"))),
            h,
        ))
    )


def registrable(host) -> Column:
    """Last two labels of a host: the "same domain" scope."""
    return F.regexp_extract(as_col(host), r"([^.]+\.[^.]+)$", 1)


def page_links(pages: DataFrame, pattern: str | None = None, scope: str = "same-hostname") -> DataFrame:
    """Links of hub pages inside the given scope, once per page."""
    # Repeats only arise inside one page, so they go before the rows fan out
    # and no shuffle is needed.
    hrefs = F.filter(F.transform(F.regexp_extract_all("html", F.lit(_HREF), 0), _href), lambda h: h != "")
    found = F.transform(hrefs, lambda h: resolve_link(h, F.col("url")))
    links = pages.select("page_id", "url", F.explode(F.array_distinct(found)).alias("link")).filter(
        F.rlike("link", F.lit("(?i)^https?://"))
    )
    if pattern:
        links = links.filter(F.rlike("link", F.lit(pattern)))
    if scope == "same-hostname":
        links = links.filter(url_host("link") == url_host("url"))
    elif scope == "same-domain":
        links = links.filter(registrable(url_host("link")) == registrable(url_host("url")))
    elif scope != "all":
        raise ValueError("scope must be same-hostname, same-domain or all")
    return links.select("page_id", "link")


def distinct_links(links: DataFrame) -> DataFrame:
    """Every link once over all pages."""
    return links.select("link").distinct()


def is_blocked_page(title, body, head_chars: int | None = None) -> Column:
    """Block phrases in the title or the body; ``head_chars=BLOCK_BODY_CHARS`` looks at the body's opening only."""
    return contains_any(F.lower(as_col(title)), K.BLOCK_PHRASES) | F.rlike(
        F.lower(head(body, head_chars)), F.lit(literal_pattern(K.BLOCK_PHRASES))
    )


def is_site_blocked(site, title, url) -> Column:
    """Title phrases (and login-wall URLs) that only count for their own site."""
    lowered = F.lower(as_col(title))
    out = F.lit(False)
    for name, phrases in K.SITE_BLOCK_TITLE_PHRASES.items():
        hit = contains_any(lowered, phrases)
        if name in K.SITE_BLOCK_URL_PARTS:
            hit = hit | contains_any(as_col(url), K.SITE_BLOCK_URL_PARTS[name])
        out = F.when(as_col(site) == name, hit).otherwise(out)
    return F.coalesce(out, F.lit(False))


def with_block_flags(pages: DataFrame) -> DataFrame:
    """Add ``blocked`` and ``site_blocked`` to pages with a ``site`` column."""
    title = page_title("html")
    return pages.withColumns({
        "blocked": is_blocked_page(title, visible_body("html")),
        "site_blocked": is_site_blocked(F.col("site"), title, F.col("url")),
    })


def classify_blocked(pages: DataFrame) -> DataFrame:
    return with_block_flags(pages).select("page_id", "url", "site", "blocked", "site_blocked")


def content_gate(
    pages: DataFrame, provider: str = "provider", capped: bool = False, min_html: int = 0, min_text: int = 1,
) -> DataFrame:
    """Cleaned page text for its reader; pages without text leave.

    ``capped`` cuts the text at the reader's size; ``min_html=MIN_BODY_CHARS`` and ``min_text=MIN_CLEAN_CHARS`` also turn
    away short pages, as the collected system does.
    """
    text = page_text("html")
    content = F.substring(text, F.lit(1), content_cap(provider)) if capped else text
    return (
        pages.filter(F.length("html") >= min_html).withColumn("content", content)
        .filter(F.length(F.trim("content")) >= min_text).drop("html")
    )

