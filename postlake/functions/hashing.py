"""Listing fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import as_col, base_text, normalize_location, strip_company_noise, strip_title_noise
from postlake.functions.urls import canonical_url

CONTENT_KEYS = ("url_title", "title_company_location")


def hash16(c) -> Column:
    return F.substring(F.sha2(as_col(c), 256), 1, 16)


def row_fingerprint(url="url", title="title", company="company") -> Column:
    """Full digest of url, title and company as stored."""
    parts = [F.coalesce(as_col(c), F.lit("")) for c in (url, title, company)]
    return _never_null(F.sha2(F.concat_ws("||", *parts), 256))


def content_input(content_key: str) -> Column:
    """Text behind the content hash.

    ``url_title`` is what the collected system computes (so equal content
    implies an equal URL); ``title_company_location`` is what it documents and
    the one that finds the same job on two boards.
    """
    url, title, company = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "title", "company"))
    if content_key == "url_title":
        return F.when(url != "", F.concat_ws("::", F.col("canonical_url"), F.col("norm_title"))).otherwise(
            F.concat_ws("::", url, title, company)
        )
    if content_key == "title_company_location":
        return F.concat_ws(
            "::", F.col("norm_title"), F.col("norm_company"),
            normalize_location(F.coalesce(F.col("location"), F.lit("")), city_only=True),
        )
    raise ValueError(f"content_key must be one of {CONTENT_KEYS}")


def _never_null(c: Column) -> Column:
    """Say that a hash cannot be null.

    Otherwise every join on it gets a null filter, which is pushed below the
    projection and works the whole hash out a second time.
    """
    return F.coalesce(c, F.lit(""))


def with_fingerprints(df: DataFrame, content_key: str = "url_title") -> DataFrame:
    """Add canonical_url, norm_title, norm_company, url_hash, content_hash, desc_hash.

    Base texts are columns of their own: the rules on them name a text several times, and inside a condition each mention
    would work it out again.
    """
    if "location" not in df.columns:
        df = df.withColumn("location", F.lit(None).cast("string"))
    bases = {f"_base_{c}": base_text(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "company", "description")}
    return (
        df.withColumns({"canonical_url": canonical_url(F.coalesce(F.col("url"), F.lit("")))} | bases)
        .withColumns({"norm_title": strip_title_noise("_base_title"), "norm_company": strip_company_noise("_base_company")})
        .withColumns({
            "url_hash": _never_null(hash16("canonical_url")),
            "content_hash": _never_null(hash16(content_input(content_key))),
            "desc_hash": _never_null(hash16("_base_description")),
        })
        .drop(*bases)
    )
