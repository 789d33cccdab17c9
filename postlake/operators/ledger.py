"""Token cost ledger, budget and response cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.scalars import half_up, ts_literal
from postlake.operators.running import running


def rate_per_million(provider) -> Column:
    """USD per million tokens: a constant list, so a projection and no join."""
    p = F.col(provider) if isinstance(provider, str) else provider
    return reduce(
        lambda acc, kv: F.when(p == kv[0], F.lit(kv[1])).otherwise(acc),
        K.COST_PER_1M_TOKENS.items(), F.lit(K.DEFAULT_COST_PER_1M),
    )


def cost_ledger(calls: DataFrame) -> DataFrame:
    """Tokens and cost per day and provider; ``calls`` holds day, provider, tokens."""
    return (
        calls.groupBy("day", "provider")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("bigint").alias("tokens"))
        .withColumn("cost_usd", F.col("tokens") * rate_per_million("provider") / F.lit(1e6))
    )


def budget_report(ledger: DataFrame, limit: float = K.DAILY_BUDGET_USD) -> DataFrame:
    cost, cap = F.col("cost_usd"), F.lit(float(limit))
    pct = F.when(cap > 0, cost / cap * 100).otherwise(F.lit(0.0))
    exceeded = (cap > 0) & (cost >= cap)
    return ledger.withColumns({
        "budget_left": F.greatest(cap - cost, F.lit(0.0)),
        "used_pct": pct,
        "exceeded": exceeded,
        "warning": ~exceeded & (cap > 0) & (pct >= 80),
    })


def budget_gate(calls: DataFrame, order: list, bucket: Column, limit: float = K.DAILY_BUDGET_USD) -> DataFrame:
    """Mark calls made after the day's spend reached the limit.

    A skipped call costs nothing, yet once over the limit a day stays over, so
    the plain prefix sum decides every row.  Whole tokens are summed and priced
    afterwards to keep the comparison exact.
    """
    spent = running(calls, ["day", "provider"], order, bucket, {"tokens_before": ("sum", F.col("tokens"))}, inclusive=False)
    cost = F.col("tokens_before") * rate_per_million("provider") / F.lit(1e6)
    skip = (cost >= limit) if limit > 0 else F.lit(False)
    return spent.withColumn("tokens_before", F.col("tokens_before").cast("bigint")).withColumn("skipped", skip)


def _live(cache: DataFrame, as_of) -> DataFrame:
    cutoff = ts_literal(as_of) - F.expr(f"INTERVAL {K.CACHE_TTL_HOURS} HOURS")
    return cache.filter(F.col("cached_at") >= cutoff)


def cache_split(pages: DataFrame, cache: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached jobs, misses) by content hash within 24 hours.

    Of several entries of a content hash the latest counts.
    """
    latest = F.max_by(F.struct(*[c for c in cache.columns if c != "content_hash"]), "cached_at").alias("entry")
    live = _live(cache, as_of).groupBy("content_hash").agg(latest).select("content_hash", "entry.*")
    hits = pages.join(live, "content_hash", "inner")
    misses = pages.join(live.select("content_hash"), "content_hash", "left_anti")
    return hits, misses


def cache_stats(cache: DataFrame, size: str = "size_bytes") -> DataFrame:
    return cache.agg(
        F.count(F.lit(1)).alias("entries"),
        half_up(F.coalesce(F.sum(size), F.lit(0)) / 1024).alias("size_kb"),
    )
