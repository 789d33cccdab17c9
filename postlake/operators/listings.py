"""Stamping, validation and filters on listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.scalars import ts_literal
from postlake.functions.text import contains_any, empty_to_null
from postlake.functions.urls import is_url
from postlake.operators.running import first_n, keep_first


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def stamp(df: DataFrame, as_of, tier_default: str = "direct_crawl") -> DataFrame:
    """Collection time, platform and tier.  Feeds default to ``direct_crawl``."""
    platform = _have(df, "platform") if tier_default == "headless" else F.lit(None).cast("string")
    return df.withColumns({
        "scraped_at": ts_literal(as_of),
        "platform": F.coalesce(platform, _have(df, "source"), F.lit("unknown")),
        "source_tier": F.coalesce(_have(df, "source_tier"), F.lit(tier_default)),
    })


def with_run_context(df: DataFrame, run_id: str, started_at, platform: str) -> DataFrame:
    """Stamp the run that produced the rows."""
    return df.withColumns({
        "run_id": F.lit(run_id), "run_started_at": ts_literal(started_at), "run_platform": F.lit(platform),
    })


def with_reasons(df: DataFrame) -> DataFrame:
    """Default the company and list what is wrong with each row."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    rules = [
        ("url", F.coalesce(is_url("url"), F.lit(False))),
        ("title", F.length(title) >= 2),
        ("description", F.length(text) >= 10),
        ("scraped_at", F.col("scraped_at").isNotNull()),
    ]
    return df.withColumns({
        "company": F.coalesce("company", F.lit("Unknown Company")),
        "reasons": F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules])),
    })


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); rejected rows keep their reasons."""
    checked = with_reasons(df)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def require_fields(df: DataFrame, cols: list[str], min_title: int = 1, url_part: str | None = None) -> DataFrame:
    """Rows whose required fields are filled, as each source demands."""
    tests = [empty_to_null(c).isNotNull() for c in cols]
    if min_title > 1:
        tests.append(F.length("title") >= min_title)
    if url_part:
        tests.append(F.contains("url", F.lit(url_part)))
    return df.filter(reduce(lambda a, b: a & b, tests))


def keyword_any(df: DataFrame, keywords: str | Column) -> DataFrame:
    """Any space-separated keyword occurs in title or description.

    An empty token occurs in every text, so a doubled blank keeps all rows;
    no keywords at all means no filter.
    """
    title, text = F.lower("title"), F.lower("description")
    if isinstance(keywords, str):
        if not keywords:
            return df
        tokens = keywords.lower().split(" ")
        return df.filter(contains_any(title, tokens) | contains_any(text, tokens))
    hit = F.exists(F.split(F.lower(keywords), " "), lambda k: F.contains(title, k) | F.contains(text, k))
    return df.filter(F.coalesce(keywords, F.lit("")).isin("") | hit)


def search_words() -> Column:
    """The lower-case words of title and company."""
    both = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("company", F.lit(""))))
    return F.split(F.trim(F.regexp_replace(both, "[^a-z0-9]+", " ")), " ")


def search_terms(terms: str) -> list[str]:
    return terms.lower().split()


def search(df: DataFrame, terms: str) -> DataFrame:
    """Rows whose title and company hold every term as a whole word. ``search_index`` answers the same without reading all rows."""
    words = search_words()
    return df.filter(reduce(lambda a, b: a & b, [F.array_contains(words, t) for t in search_terms(terms)], F.lit(True)))


def limit_results(df: DataFrame, keys: list[str], order: list, n: int | None = None) -> DataFrame:
    """At most ``n`` listings per source and query, where the user asks for a limit; ``DEFAULT_MAX_RESULTS`` is the usual one."""
    return df if n is None else first_n(df, n, keys, order)


def fallback_union(primary: DataFrame, secondary: DataFrame, key: list[str], n: int = 1) -> DataFrame:
    """Secondary rows only for keys where the primary source gave fewer than ``n``."""
    enough = primary.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).drop("_n")
    return primary.unionByName(secondary.join(enough, key, "left_anti"), allowMissingColumns=True)


def pages_until_enough(pages: DataFrame, key: list[str], n: int) -> DataFrame:
    """Result pages a paged reader would have kept before stopping.

    ``pages`` holds ``page_no`` and ``jobs_found`` per key.  Reading stops after
    a page that fills the quota or comes back empty.
    """
    before = Window.partitionBy(*key).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pages.withColumn("_found", F.coalesce(F.sum("jobs_found").over(before), F.lit(0)))
        .withColumn("_empty", F.coalesce(F.max((F.col("jobs_found") == 0).cast("int")).over(before), F.lit(0)))
        .filter((F.col("_found") < n) & (F.col("_empty") == 0))
        .drop("_found", "_empty")
    )


def union_sources(batches: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def dedup_by_source(df: DataFrame, order: list, known: DataFrame | None = None) -> DataFrame:
    """First listing per source fingerprint, minus those already known."""
    out = keep_first(df, ["source_fp"], order)
    if known is not None:
        out = out.join(known.select("source_fp").distinct(), "source_fp", "left_anti")
    return out


def source_dedup_stats(df: DataFrame) -> DataFrame:
    """Lookups, duplicates and hit ratio of the in-batch source dedup."""
    per_key = df.groupBy("source_fp").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("lookups"),
        F.count(F.lit(1)).alias("unique_jobs"),
    ).select(
        "lookups", "unique_jobs",
        (F.col("lookups") - F.col("unique_jobs")).alias("duplicates"),
        F.when(
            F.col("lookups") > 0, (F.col("lookups") - F.col("unique_jobs")) / F.col("lookups").cast("double")
        ).otherwise(F.lit(0.0)).alias("hit_ratio"),
    )
