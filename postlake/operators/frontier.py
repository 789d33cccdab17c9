"""Search frontier: queries times sites times result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.text import first_filled


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "-")


def _percent_encode(c: Column) -> Column:
    """Encoding of a URI component: like a form value, but five marks stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def _encodings() -> dict[str, Column]:
    """What the marks of a template stand for; none of it depends on site or page."""
    keywords, location = F.col("keywords"), F.coalesce("location", F.lit(""))
    with_default = first_filled("location", F.lit(K.DEFAULT_LOCATION))
    return {
        "q": F.url_encode(keywords), "qc": _percent_encode(keywords), "slug": _slug(keywords), "loc": F.url_encode(location),
        "locd": F.url_encode(with_default), "locslug": _slug(with_default),
        "gq": F.url_encode(F.concat(keywords, F.lit(" jobs in "), with_default)),
    }


def _fill(template: str, optional_location: bool) -> Column:
    """A site's URL for the encoded query of the row, the marks of its page still in it."""
    url = F.lit(template)
    for name in _encodings():
        if f"{{{name}}}" in template:
            url = F.replace(url, F.lit(f"{{{name}}}"), F.col(f"_e.{name}"))
    if optional_location:
        url = F.regexp_replace(url, r"&(?:l|location)=(?=(?:\{start\})?(?:&|$))", "")
    return url


def _site(name: str, template: str, cap: int, style: str, size: int) -> Column:
    return F.struct(
        F.lit(name).alias("site"), F.lit(cap).alias("cap"), F.lit(style).alias("style"), F.lit(size).alias("size"),
        F.lit("{page}" in template).alias("has_page"), F.lit("{start}" in template).alias("has_start"),
        _fill(template, name in K.OPTIONAL_LOCATION_SITES).alias("url"),
    )


def _paged() -> Column:
    """The URL of a site for the page of the row."""
    page, style = F.col("page_no"), F.col("_s.style")
    number = page.cast("string")
    later = lambda text: F.when(page > 1, text).otherwise(F.lit(""))  # noqa: E731 - page 1 has no page part
    offset = later(F.concat(F.lit("&start="), ((page - 1) * F.col("_s.size")).cast("string")))
    in_path = F.when(style == "sequence", number).otherwise(later(F.concat(F.lit("page-"), number, F.lit("/"))))
    url = F.col("_s.url")
    url = F.when(F.col("_s.has_page"), F.replace(url, F.lit("{page}"), in_path)).otherwise(url)
    url = F.when(F.col("_s.has_start"), F.replace(url, F.lit("{start}"), offset)).otherwise(url)
    behind = F.when(style == "page", later(F.concat(F.lit("&page="), number))).when(style == "start", offset).otherwise(F.lit(""))
    return F.concat(url, behind)


def frontier(queries: DataFrame, sites=K.FRONTIER_SITES) -> DataFrame:
    """Seed URLs of every query.

    The sites are a constant list, so each query row is unfolded in place: no
    join and no shuffle. A query is encoded once, a site's URL filled once per
    query; a page only puts its own part into it.
    """
    return (
        queries.withColumn("_e", F.struct(*[c.alias(n) for n, c in _encodings().items()]))  # once per query, before it unfolds
        .withColumn("_s", F.explode(F.array(*[_site(*site) for site in sites]))).drop("_e")
        .withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("_s.cap"))))
        .withColumn("site", F.col("_s.site"))
        .withColumn("seed_url", _paged())
        .drop("_s")
    )
