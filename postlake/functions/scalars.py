"""Numbers, sizes, times and status classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.text import as_col


def half_up(c, digits: int = 0) -> Column:
    """Round half up on the binary value; whole numbers come back as bigint."""
    x = as_col(c).cast("double")
    if digits == 0:
        return F.floor(x + 0.5).cast("bigint")
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5).cast("double") / F.lit(scale)


def ts_literal(value) -> Column:
    """A timestamp argument (string, datetime or column) as a column."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def human_size(c) -> Column:
    n = as_col(c)
    return (
        F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1048576, F.format_string("%.1f KB", n / F.lit(1024.0)))
        .otherwise(F.format_string("%.2f MB", n / F.lit(1048576.0)))
    )


def day_key(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd")


def age_days(ts, as_of) -> Column:
    return (F.unix_micros(ts_literal(as_of)) - F.unix_micros(as_col(ts))) / F.lit(8.64e10)


def age_days_rounded(ts, as_of) -> Column:
    return half_up(age_days(ts, as_of), 1)


def ist_hour(ts) -> Column:
    return F.hour(as_col(ts) + F.expr(f"INTERVAL {K.IST_OFFSET_MINUTES} MINUTES"))


def is_business_hours(ts) -> Column:
    start, end = K.BUSINESS_HOURS_IST
    h = ist_hour(ts)
    return (h >= start) & (h < end)


def is_off_hours(ts, start: int = K.OFF_HOURS_IST[0], end: int = K.OFF_HOURS_IST[1]) -> Column:
    h = ist_hour(ts)
    if start > end:  # wraps midnight
        return (h >= start) | (h < end)
    return (h >= start) & (h < end)


def is_rate_limited(status) -> Column:
    return F.coalesce(as_col(status).isin(429, 403, 503), F.lit(False))


def failure_class(status) -> Column:
    s = as_col(status)
    return (
        F.when(s == 429, F.lit("soft_block"))
        .when(s == 403, F.lit("hard_block"))
        .when(s == 407, F.lit("proxy_auth"))
        .when(s.isNull() | (s == 0) | (s >= 500), F.lit("permanent"))
        .otherwise(F.lit("unexpected"))
    )


def backoff_ms(attempt, multiplier, max_backoff_ms, jitter_ms=0.0) -> Column:
    """Exponential wait before the next try, capped per domain."""
    jitter = jitter_ms if isinstance(jitter_ms, Column) else F.lit(float(jitter_ms))
    grown = F.lit(float(K.BACKOFF_BASE_MS)) * F.pow(
        as_col(multiplier).cast("double"), as_col(attempt).cast("double") - 1.0
    )
    return half_up(F.least(grown + jitter, as_col(max_backoff_ms).cast("double")))


def delay_bounds(ts) -> dict[str, Column]:
    """Least and greatest polite delay for a row that carries its policy."""
    mult = F.when(is_business_hours(ts), F.col("business_mult")).otherwise(F.lit(1.0))
    return {
        "delay_min_ms": half_up(F.col("min_delay_ms").cast("double") * mult),
        "delay_max_ms": half_up((F.col("min_delay_ms") + F.col("jitter_ms")).cast("double") * mult),
    }


def latency_ms(start_ms, end_ms) -> Column:
    s, e = as_col(start_ms).cast("double"), as_col(end_ms).cast("double")
    elapsed = e - s
    inf = F.lit(float("inf"))
    ok = s.isNotNull() & ~F.isnan(s) & (s > 0) & (F.abs(s) != inf) & ~F.isnan(elapsed) & (elapsed >= 0) & (elapsed != inf)
    return F.when(ok, elapsed)
