"""RSS payloads to listings.

Input is a landed payload table ``(source, body, ...)``, one feed document per
row.  A feed is split into items, every item is parsed with ``from_xml`` by
itself, and each dialect maps item tags to the listing columns.  An item that
is not well-formed is mended and parsed again; what still fails, or has no
title or link, is returned by ``rejected_items`` with the reason and takes
nothing else along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.documents import repair_item
from postlake.functions.text import (
    WS, capitalize_words, empty_to_null, first_filled, head, strip_tags, ws_trim,
)

_ITEM_TAGS = [
    "title", "link", "guid", "description", "pubDate", "source", "author",
    "dc:creator", "company", "himalayasJobs:companyName", "companyName",
]
# Leaf tags may carry attributes (<guid isPermaLink="false">): the text is then
# in _VALUE, which stays null for an empty tag.
_LEAF = T.StructType([T.StructField("_VALUE", T.StringType())])
_ITEM = T.StructType([*[T.StructField(t, _LEAF) for t in _ITEM_TAGS], T.StructField("_bad", T.StringType())])
_PARSE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

DIALECTS = ("location_in_description", "creator_company", "role_at_company")


def _tag(name: str) -> Column:
    return F.coalesce(ws_trim(F.col("item")[name]["_VALUE"]), F.lit(""))


def _items(payloads: DataFrame) -> DataFrame:
    """One row per item: ``item`` is its parsed form, null when even the mended text does not parse."""
    inside = r"(?is)<item(?:\s[^<>]*)?>(.*)\z"
    closed = F.split("body", r"(?i)</item\s*>")
    kept = [c for c in payloads.columns if c != "body"]
    raw = payloads.select(*kept, F.posexplode(closed).alias("item_no", "part"), F.size(closed).alias("_parts")).filter(
        F.rlike("part", F.lit(r"(?i)<item(?:\s[^<>]*)?>"))
    ).withColumn("raw", F.concat(F.lit("<item>"), F.regexp_extract("part", inside, 1), F.lit("</item>")))
    open_end = F.col("item_no") == F.col("_parts") - 1
    strict = F.from_xml(F.col("raw"), _ITEM, _PARSE)
    mended = F.from_xml(F.concat(F.lit("<item>"), repair_item(F.regexp_extract("raw", r"(?s)^<item>(.*)</item>$", 1), _ITEM_TAGS),
                                 F.lit("</item>")), _ITEM, _PARSE)
    return (
        raw.withColumn("strict", F.when(~open_end, strict))
        .withColumn("item", F.when(open_end, F.lit(None).cast(_ITEM)).when(F.col("strict._bad").isNull(), F.col("strict")).otherwise(mended))
        .withColumn("reason", F.when(open_end, "item is not closed").when(
            F.col("item").isNull() | F.col("item._bad").isNotNull(), "item does not parse"))
        .select(*kept, "item_no", "item", "reason", "raw")
    )


def rejected_items(payloads: DataFrame) -> DataFrame:
    """Items that give no listing, with the reason and their text."""
    kept = [c for c in payloads.columns if c != "body"]
    title, link = _tag("title"), first_filled(_tag("link"), _tag("guid"))
    reason = F.coalesce("reason", F.when(title == "", "no title").when(link.isNull(), "no link"))
    return _items(payloads).select(*kept, "item_no", reason.alias("reason"), "raw").filter(F.col("reason").isNotNull())


def rss_items(payloads: DataFrame, dialect: str, max_chars: int | None = None) -> DataFrame:
    """Listings of one feed dialect; rows without title or link are dropped.

    Descriptions are whole; ``max_chars=DESCRIPTION_MAX_CHARS`` cuts them as the collected system does.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    title, link = _tag("title"), first_filled(_tag("link"), _tag("guid"))
    stripped = strip_tags(_tag("description"))
    location = F.lit(None).cast("string")
    listing_title: Column = title
    tier = F.lit("api")
    description = head(stripped, max_chars)

    if dialect == "location_in_description":
        company = first_filled(_tag("source"), _tag("author"), F.lit("Unknown"))
        lead = F.regexp_extract(stripped, rf"^(.+?){WS}*-{WS}*", 1)
        location = F.when((lead != "") & (F.length(lead) < 60), lead)
        tier = F.lit(None).cast("string")
    elif dialect == "creator_company":
        parts = F.split(title, " at ")
        tagged = first_filled(_tag("dc:creator"), _tag("company"))
        company = (
            F.when(tagged.isNotNull(), tagged)
            .when(F.size(parts) > 1, ws_trim(F.element_at(parts, -1)))
            .otherwise(F.lit("Unknown"))
        )
    else:
        role = rf"(?i)(.+?){WS}+at{WS}+(.+)"
        has_role = F.rlike(title, F.lit(role))
        tagged = first_filled(_tag("himalayasJobs:companyName"), _tag("companyName"))
        tagged = F.nullif(tagged, F.lit("Unknown"))
        named = F.nullif(F.when(has_role, ws_trim(F.regexp_extract(title, role, 2))), F.lit("Unknown"))
        slug = empty_to_null(F.regexp_extract(F.coalesce(link, F.lit("")), "/companies/([^/]+)", 1))
        company = F.coalesce(tagged, named, capitalize_words(slug), F.lit("Unknown"))
        listing_title = F.when(has_role, ws_trim(F.regexp_extract(title, role, 1))).otherwise(title)
        description = strip_tags(head(_tag("description"), max_chars))

    return (
        _items(payloads).filter(F.col("reason").isNull())
        .select(
            *[c for c in payloads.columns if c != "body"], "item_no",
            listing_title.alias("title"), company.alias("company"), location.alias("location"),
            description.alias("description"), link.alias("url"),
            empty_to_null(_tag("pubDate")).alias("posted_date"), tier.alias("source_tier"),
            title.alias("_raw_title"),
        )
        .filter((F.col("_raw_title") != "") & F.col("url").isNotNull())
        .drop("_raw_title")
    )


