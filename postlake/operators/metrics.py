"""Run metrics over an event log ``(event_id, ts, event_type, latency_ms, ...)``.

Event types: request_started, request_ok, request_failed, extracted,
deduplicated, stored, persist_failed, rate_limited, proxy_failed, blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.scalars import half_up, ts_literal
from postlake.operators.running import first_n, last_n, running, time_bucket

_COUNTERS = {
    "requests_started": "request_started",
    "requests_succeeded": "request_ok",
    "requests_failed": "request_failed",
    "jobs_extracted": "extracted",
    "jobs_deduplicated": "deduplicated",
    "jobs_stored": "stored",
    "jobs_persist_failed": "persist_failed",
    "rate_limit_hits": "rate_limited",
    "proxy_failures": "proxy_failed",
    "blocked": "blocked",
}


def success_rate(ok: Column, failed: Column) -> Column:
    total = ok + failed
    return F.when(total > 0, half_up(ok / total * 100)).otherwise(F.lit(100).cast("bigint"))


def dedup_ratio(deduplicated: Column, extracted: Column) -> Column:
    return F.when(extracted > 0, half_up(deduplicated / extracted * 100, 1)).otherwise(F.lit(0.0))


def per_minute(n: Column, uptime_minutes: Column) -> Column:
    floor = F.lit(1.0) / F.lit(60.0)
    return half_up(n.cast("double") / F.greatest(floor, uptime_minutes), 1)


def run_metrics(events: DataFrame, as_of, started_at, by: list[str] | None = None) -> DataFrame:
    """Counters, rates and throughput, overall or per group, in one pass."""
    by = by or []
    now, start = ts_literal(as_of), ts_literal(started_at)
    kind = F.col("event_type")
    counts = [F.count_if(kind == v).alias(k) for k, v in _COUNTERS.items()]
    recent = (kind == "request_started") & (F.col("ts") >= now - F.expr("INTERVAL 60 SECONDS")) & (F.col("ts") <= now)
    uptime = (F.unix_micros(now) - F.unix_micros(start)) / F.lit(1e6)
    return (
        events.groupBy(*by)
        .agg(
            *counts,
            F.count_if(recent).alias("requests_per_minute"),
            F.max(F.when(kind == "extracted", F.col("ts"))).alias("last_extracted_at"),
        )
        .withColumns({
            "success_rate_pct": success_rate(F.col("requests_succeeded"), F.col("requests_failed")),
            "dedup_ratio_pct": dedup_ratio(F.col("jobs_deduplicated"), F.col("jobs_extracted")),
            "jobs_per_minute": per_minute(F.col("jobs_extracted"), uptime / 60),
            "uptime_seconds": half_up(uptime),
        })
    )


def _timed(events: DataFrame) -> DataFrame:
    latency = F.col("latency_ms")
    return events.filter(
        (F.col("event_type") == "request_ok") & latency.isNotNull() & (latency >= 0)
    ).select(*[c for c in ("domain", "ts", "event_id", "latency_ms") if c in events.columns])


def latency_stats(events: DataFrame, n: int = K.LATENCY_SAMPLES, by: list[str] | None = None) -> DataFrame:
    """Mean and nearest-rank p95 of the last ``n`` successful requests."""
    if by:
        sample = first_n(_timed(events), n, by, [F.col("ts").desc(), F.col("event_id").desc()])
    else:
        sample = last_n(_timed(events), n, ["ts", "event_id"])
    return sample.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(half_up(F.avg(F.col("latency_ms").cast("double"))), F.lit(0).cast("bigint")).alias("avg_latency_ms"),
        F.coalesce(
            half_up(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)")), F.lit(0).cast("bigint")
        ).alias("p95_latency_ms"),
    )


def gauge_stats(samples: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Peak and latest value of a sampled gauge."""
    latest = F.max_by(F.col(value), F.struct("ts", "event_id"))
    return samples.groupBy(*(by or [])).agg(
        half_up(F.max(value)).alias("peak"), half_up(latest).alias("current"),
    )


def snapshot(
    events: DataFrame, as_of, started_at, gauge: DataFrame | None = None, n: int = K.LATENCY_SAMPLES
) -> DataFrame:
    """The full one-row metrics snapshot.

    Three single-row aggregates are stacked and folded with ``max``; that needs
    no join at all.
    """
    parts = [run_metrics(events, as_of, started_at), latency_stats(events, n)]
    if gauge is not None:
        parts.append(gauge_stats(gauge).select(
            F.col("peak").alias("peak_memory_mb"), F.col("current").alias("current_memory_mb")
        ))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    for c in ("peak_memory_mb", "current_memory_mb"):
        if c not in row.columns:
            row = row.withColumn(c, F.lit(0).cast("bigint"))
    return row.withColumn("snapshot_at", ts_literal(as_of))


def kpis(metrics: DataFrame, duration_seconds=None) -> DataFrame:
    """Headline figures from a snapshot row."""
    started, secs = F.col("requests_started"), F.col("uptime_seconds")
    if duration_seconds is not None:
        secs = F.lit(duration_seconds)
    secs = F.greatest(secs.cast("double"), F.lit(1.0))
    return metrics.select(
        half_up(F.col("jobs_extracted") * 60 / secs, 1).alias("jobs_per_minute"),
        "dedup_ratio_pct", "p95_latency_ms",
        F.when(started > 0, half_up((started - F.col("proxy_failures")) / started * 100, 1))
        .otherwise(F.lit(100.0)).alias("proxy_pass_pct"),
        F.when(started > 0, half_up(F.col("rate_limit_hits") / started * 100, 1))
        .otherwise(F.lit(0.0)).alias("rate_limit_pct"),
    )


def stall_gaps(events: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Seconds since the previous extracted row, per extracted row.

    There is no key to partition by, so the previous time comes from the
    two-level running maximum instead of one global ``lag``.
    """
    got = events.filter(F.col("event_type") == "extracted").select("event_id", "ts")
    before = running(
        got, [], ["ts", "event_id"], time_bucket("ts", bucket_seconds), {"prev_ts": ("max", F.col("ts"))},
        inclusive=False,
    )
    return before.withColumn(
        "gap_seconds", (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1e6)
    )


def tier_breakdown(results: DataFrame) -> DataFrame:
    """Raw and stored rows per tier and source; ``outcome`` is stored/duplicate/invalid."""
    return results.groupBy("source_tier", "source").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(F.col("outcome") == "stored").alias("stored"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "invalid").alias("invalid"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("outcome") == "stored").alias("total_stored"),
        F.count_if(F.col("outcome") == "duplicate").alias("total_duplicates"),
        F.count_if(F.col("outcome") == "invalid").alias("total_invalid"),
    )


def coverage_gate(
    counts: DataFrame, collected: str = "collected",
    threshold: int = max(K.COVERAGE_MIN_JOBS, K.COVERAGE_SKIP_THRESHOLD),
) -> DataFrame:
    """Whether enough was collected to skip the page tier, and why."""
    n = F.greatest(F.coalesce(F.floor(collected), F.lit(0)), F.lit(0)).cast("bigint")
    text = n.cast("string")
    launch, partial = n < threshold, (n > 0) & (n < threshold)
    return counts.withColumns({
        "should_launch": launch,
        "partial_collection": partial,
        "reason": F.when(~launch, F.concat(F.lit(f"{K.COVERAGE_REASONS['enough']} ("), text, F.lit(f" >= {threshold})")))
        .when(partial, F.concat(F.lit(f"{K.COVERAGE_REASONS['partial']} ("), text, F.lit(f"/{threshold})")))
        .otherwise(F.lit(f"{K.COVERAGE_REASONS['none']} (threshold={threshold})")),
    })
