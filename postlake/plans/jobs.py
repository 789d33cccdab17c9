"""Composite jobs: ingest, page extraction, maintenance, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake import schema
from postlake.functions.hashing import hash16, with_fingerprints
from postlake.functions.scalars import ts_literal
from postlake.functions.text import page_text
from postlake.functions.urls import domain_of
from postlake.operators import dedup, ledger, lifecycle, listings, metrics, store
from postlake.session import checkpoint_root, materialize
from postlake.sources import pages as page_rules
from postlake.sources import responses as model


def postings_per_domain(rows: DataFrame, order: list | None = None) -> DataFrame:
    """Distinct postings per domain once tracking-URL repeats are gone."""
    firsts = dedup.first_in_batch(
        with_fingerprints(rows.select("seq", "url")
                          .withColumns({c: F.lit(None).cast("string") for c in ("title", "company", "description")}))
        .select("seq", "url", "url_hash"),
        order or ["seq"],
    )
    return firsts.groupBy(domain_of("url").alias("domain")).agg(F.count(F.lit(1)).alias("postings"))


def ingest_outcomes(
    rows: DataFrame, seen: DataFrame, as_of, order: list[str],
    content_key: str = "url_title", in_batch: bool = True, skip_validation: bool = False, by_url: DataFrame | None = None,
) -> DataFrame:
    """Every offered row with its ``outcome``: stored, duplicate or invalid.

    ``order`` names columns that identify a row.  ``in_batch=False`` leaves
    repeats inside one batch alone, so that only history decides, as the
    collected system does.

    Only hashes and the order key go through the history joins; the wide rows
    are shuffled once, on their unique key.  Repeats of a URL are dropped on
    the map side before any join, so one URL holding a third of the batch
    reaches history as a single row.
    """
    stamped = listings.stamp(rows, as_of)
    checked = listings.with_reasons(stamped) if not skip_validation else stamped.withColumn(
        "reasons", F.array().cast("array<string>")
    )
    hashes = ["url_hash", "content_hash", "desc_hash"]
    slim = with_fingerprints(checked, content_key).filter(F.size("reasons") == 0).select(*order, *hashes)
    if in_batch:
        slim = dedup.first_in_batch(slim, order)
    judged = dedup.dedup_verdict(slim, seen, as_of, by_url)
    return checked.join(judged, order, "left").withColumn(
        "outcome",
        F.when(F.size("reasons") > 0, F.lit("invalid"))
        .when(F.col("verdict") == "none", F.lit("stored"))
        .otherwise(F.lit("duplicate")),
    )


def ingest(
    rows: DataFrame, seen: DataFrame, target_path: str, as_of, order: list[str],
    content_key: str = "url_title", in_batch: bool = True, by_url: DataFrame | None = None,
    chars: int = store.PREFIX_CHARS,
) -> dict[str, DataFrame]:
    """Validate, deduplicate, insert, and return what happened.

    Returns ``inserted`` (as stored), ``stored`` (what the seen store takes in), ``seen`` (the new seen store), ``results``
    (outcome per offered row) and ``counts``. ``by_url`` is as in ``dedup_verdict``; ``seen`` is then not all of history.
    Accepted rows are written at ``accepted_path`` and read back, as the insert, the seen store and the counts all take them;
    the caller may drop the path once it is done with the rest.
    """
    results = ingest_outcomes(rows, seen, as_of, order, content_key, in_batch, by_url=by_url)
    accepted, accepted_path = materialize(results.filter(F.col("outcome") == "stored"), "accepted")
    offered = store.to_stored(accepted, as_of)
    inserted = store.upsert_jobs(offered, target_path, order, chars)
    stored_at = accepted.withColumn("stored_at", F.col("scraped_at"))
    return {
        "inserted": inserted,
        "stored": stored_at.select(*[f.name for f in schema.SEEN_STORE]),
        "seen": dedup.mark_seen(seen, stored_at),
        "results": results,
        "counts": store.insert_counts(offered, inserted),
        "accepted_path": accepted_path,
    }


def extract_from_responses(responses: DataFrame) -> DataFrame:
    """Landed model responses to raw listings, early-career ones only."""
    records = model.salvage_records(model.response_payload(responses))
    return model.to_listing(model.normalize_records(model.fresher_only(model.sanitize_records(records))))


def extract_pages(
    pages: DataFrame, responses: DataFrame, cache: DataFrame, as_of, allowed: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Page path: block check, cached or landed model output, else field rules.

    ``pages`` holds page_id, url, site, html; ``responses`` page_url next to the
    response columns; ``cache`` content_hash, jobs (JSON), cached_at. Pages
    without text, or outside ``allowed`` (page_id; what the budget lets pass),
    are not taken to the model; the rules read them.

    ``cache_entries`` are the entries to add to the cache: per answered page
    without a live entry its early-career records, so that the next run hits.
    """
    checkpoint_root(pages.sparkSession)
    # The keys are read several times below; the wide HTML is not carried along.
    keys = (
        page_rules.with_block_flags(pages)
        .select("page_id", "url", "site", "blocked", "site_blocked", hash16("html").alias("content_hash"),
                (F.length(F.trim(page_text("html"))) > 0).alias("readable"))
        .checkpoint()
    )
    blocked = F.col("blocked") | F.col("site_blocked")
    usable = keys.filter(~blocked).drop("blocked", "site_blocked")
    hits, misses = ledger.cache_split(usable, cache, as_of)
    misses = misses.filter("readable")
    if allowed is not None:
        misses = misses.join(allowed.select("page_id"), "page_id", "left_semi")

    cached = hits.select(
        F.lit("cache").alias("api_format"), F.lit("cache").alias("provider"),
        F.col("url").alias("page_url"), F.col("site").alias("source_label"), F.col("jobs").alias("payload"),
    )
    landed = model.response_payload(
        responses.join(misses.select(F.col("url").alias("page_url")), "page_url", "left_semi")
    ).select("api_format", "provider", "page_url", "source_label", "payload")
    records = model.sanitize_records(model.salvage_records(cached.unionByName(landed)))
    fresh = model.fresher_only(records).checkpoint()
    answered = fresh.select(F.col("page_url").alias("url")).distinct()
    left_over = usable.join(answered, "url", "left_anti").select("page_id")
    # Fields come out before the join, so only short columns are shuffled.
    by_rules = page_rules.extract_fields(pages).join(left_over, "page_id", "left_semi").withColumn("source", F.col("site"))
    columns = ["title", "company", "description", "url", "source", "location", "experience", "job_type"]
    # Records go back to JSON under the names they are read with.
    names = {"title": "title", "company": "company", "location": "location", "experience": "experience", "jobType": "job_type",
             "applyLink": "apply_link", "isFresher": "is_fresher", "fresherReason": "fresher_reason",
             "experienceNormalized": "experience_normalized", "rawDescription": "raw_description"}
    record = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    found = fresh.groupBy("page_url").agg(F.array_sort(F.collect_list(record)).alias("records"))  # the records of one page
    entries = misses.select(F.col("url").alias("page_url"), "content_hash").join(found, "page_url").select(
        "page_url", "content_hash", F.to_json("records").alias("jobs"), ts_literal(as_of).alias("cached_at")
    )
    return {
        "cache_entries": entries,
        "blocked": keys.filter(blocked).select("page_id", "url", "site"),
        "extracted": model.to_listing(model.normalize_records(fresh), "page_url"),
        "by_rules": by_rules.select(*columns, F.lit("headless").alias("source_tier")),
    }


def lifecycle_cycle(
    shards: DataFrame, archives: DataFrame, manifests: DataFrame, as_of,
    archive_days: int = K.ARCHIVE_AFTER_DAYS, delete_days: int = K.DELETE_AFTER_DAYS, guard: bool = True,
) -> dict[str, DataFrame]:
    """One maintenance cycle as plans: archive, upload, clean up, usage."""
    old, recent = lifecycle.split_by_age(shards, as_of, archive_days)
    plan = lifecycle.cleanup_plan(archives, manifests, as_of, delete_days, guard)
    files = recent.select(F.lit("hot").alias("tier"), "size_bytes").unionByName(
        plan.filter(F.col("action") != "delete").select(F.lit("warm").alias("tier"), "size_bytes")
    )
    return {
        "manifest": lifecycle.manifest(old),
        "manifest_files": lifecycle.manifest_files(old),
        "pending_uploads": lifecycle.pending_uploads(archives, manifests),
        "cleanup_plan": plan,
        "cleanup_outcome": lifecycle.cleanup_outcome(plan),
        "usage": lifecycle.storage_usage(files),
    }


def daily_cost_report(calls: DataFrame, cache: DataFrame, limit: float = K.DAILY_BUDGET_USD) -> dict[str, DataFrame]:
    return {
        "spend": ledger.budget_report(ledger.cost_ledger(calls), limit),
        "cache": ledger.cache_stats(cache),
    }


def run_kpis(events: DataFrame, as_of, started_at) -> DataFrame:
    return metrics.kpis(metrics.snapshot(events, as_of, started_at))
