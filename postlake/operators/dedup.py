"""Duplicate detection against history and the seen store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.scalars import half_up, ts_literal
from postlake.operators.running import keep_first


def _cutoff(as_of, days: int):
    return ts_literal(as_of) - F.expr(f"INTERVAL {days} DAYS")


def match_url(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Batch rows whose URL was stored before."""
    return batch.join(seen.select("url_hash").distinct(), "url_hash", "left_semi")


def _content_hits(batch: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """Add ``_content_hit``.

    History is first reduced to one row per (content, description) pair with
    its latest sighting, and those to one row per content hash. Both joins are
    then equi-joins on a unique side, so a content hash shared by a third of the
    history cannot multiply rows. Both sides need the same columns of the pairs,
    so history is hashed and shuffled once for the two.
    """
    never = F.lit(-(1 << 63)).cast("bigint")
    pairs = seen.groupBy("content_hash", "desc_hash").agg(F.max(F.coalesce(F.unix_micros("stored_at"), never)).alias("_pair_seen"))
    latest = pairs.groupBy("content_hash").agg(F.max("_pair_seen").alias("_last_seen"))
    fresh = F.col("_last_seen") > F.unix_micros(_cutoff(as_of, K.REFRESH_DAYS))
    return (
        batch.join(latest, "content_hash", "left")
        .join(pairs, ["content_hash", "desc_hash"], "left")
        .withColumn("_content_hit", F.col("_pair_seen").isNotNull() | F.coalesce(fresh, F.lit(False)))
        .drop("_last_seen", "_pair_seen")
    )


def match_content(batch: DataFrame, seen: DataFrame, as_of) -> DataFrame:
    """Same content stored before with the same text, or within seven days."""
    return _content_hits(batch, seen, as_of).filter("_content_hit").drop("_content_hit")


def dedup_verdict(batch: DataFrame, seen: DataFrame, as_of, by_url: DataFrame | None = None) -> DataFrame:
    """Add ``verdict``: ``url`` before ``content`` before ``none``.

    Where history is laid out twice, ``by_url`` is what the URLs are looked up in, and ``seen`` what the contents are.
    """
    urls = (seen if by_url is None else by_url).select("url_hash").distinct().withColumn("_url_hit", F.lit(True))
    return (
        _content_hits(batch, seen, as_of)
        .join(urls, "url_hash", "left")
        .withColumn(
            "verdict",
            F.when(F.col("_url_hit"), F.lit("url")).when(F.col("_content_hit"), F.lit("content")).otherwise(F.lit("none")),
        )
        .drop("_url_hit", "_content_hit")
    )


def first_in_batch(batch: DataFrame, order: list) -> DataFrame:
    """One row per URL inside a batch; the earliest in ``order`` stays."""
    return keep_first(batch, ["url_hash"], order)


def mark_seen(seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Seen store after adding stored rows; the latest sighting replaces."""
    cols = ["url_hash", "content_hash", "desc_hash", "stored_at"]
    both = seen.select(*cols, F.lit(0).alias("_new")).unionByName(stored.select(*cols, F.lit(1).alias("_new")))
    newest = [F.col("_new").desc(), F.col("stored_at").desc(), "content_hash", "desc_hash"]
    return keep_first(both, ["url_hash"], newest).drop("_new")


def prune_seen(seen: DataFrame, as_of, days: int = K.SEEN_RETENTION_DAYS) -> DataFrame:
    return seen.filter(F.col("stored_at") >= _cutoff(as_of, days))


def store_size(seen: DataFrame) -> DataFrame:
    return seen.agg(F.count(F.lit(1)).alias("store_size"))


def dedup_stats(verdicts: DataFrame) -> DataFrame:
    """Processed, skipped by reason, stored and duplicate rate."""
    n = F.count(F.lit(1))
    skipped = F.count_if(F.col("verdict") != "none")
    return verdicts.agg(
        n.alias("processed"),
        F.count_if(F.col("verdict") == "url").alias("skipped_url"),
        F.count_if(F.col("verdict") == "content").alias("skipped_content"),
        F.count_if(F.col("verdict") == "none").alias("stored"),
        F.when(n > 0, half_up(skipped / n * 100)).otherwise(F.lit(0).cast("bigint")).alias("dup_rate_pct"),
    )
