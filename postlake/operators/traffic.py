"""Rate policies, per-domain traffic and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake import schema
from postlake.functions.scalars import backoff_ms, failure_class, half_up, is_rate_limited, ts_literal
from postlake.functions.text import as_col
from postlake.functions.urls import domain_of
from postlake.operators.running import band_counts, last_n, running, time_bucket, trailing_count

# Ten minutes of one domain are one window group, however busy the domain is.
BUCKET_SECONDS = 600

_POLICY = (
    "STRUCT<domain STRING, max_rpm INT, min_delay_ms INT, jitter_ms INT, max_concurrent INT, risk STRING, "
    "business_mult DOUBLE, backoff_mult DOUBLE, max_backoff_ms BIGINT, requires_auth BOOLEAN>"
)


def _policy_literal(values) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(K.POLICY_FIELDS, values)]).cast(_POLICY)


def policy_ordinal(domain, policies=K.RATE_POLICIES) -> Column:
    """1-based ordinal of the policy of a domain; last + 1 means default.

    An exact name wins, else the first declared name the domain ends with
    (with no dot needed in front: "notlinkedin.com" does match).
    """
    return _ordinal_of(domain_of(domain), policies)


def _ordinal_of(d: Column, policies) -> Column:
    out = F.when(d == policies[0][0], F.lit(1))
    for i, p in enumerate(policies[1:], start=2):
        out = out.when(d == p[0], F.lit(i))
    for i, p in enumerate(policies, start=1):
        out = out.when(F.endswith(d, F.lit(p[0])), F.lit(i))
    return out.otherwise(F.lit(len(policies) + 1))


def with_policy(df: DataFrame, domain: str = "domain", policies=K.RATE_POLICIES, default=K.DEFAULT_POLICY) -> DataFrame:
    """Add the policy columns of each row's domain.

    The policy list is a constant of the plan, so this is a projection: no
    join, no shuffle, no broadcast. The host is a column of its own: read off once
    a row, not once for every policy it is compared with.
    """
    table = F.array(*[_policy_literal(p) for p in policies], _policy_literal(default))
    fields = [f for f in K.POLICY_FIELDS if f != "domain"]
    chosen = (
        df.withColumn("_host", domain_of(domain)).withColumn("policy_ordinal", _ordinal_of(F.col("_host"), policies))
        .withColumn("_p", F.element_at(table, F.col("policy_ordinal")))
    )
    name = F.when(F.col("policy_ordinal") > len(policies), F.col("_host")).otherwise(F.col("_p.domain"))
    return chosen.select(
        *df.columns, name.alias("policy_domain"), *[F.col(f"_p.{f}").alias(f) for f in fields], "policy_ordinal"
    )


def match_policies(df: DataFrame, policies: DataFrame, domain: str = "domain") -> DataFrame:
    """Add the columns of each row's policy from a table (ordinal, domain, ...), null where none matches.

    The rule of ``policy_ordinal`` for policies that are data: an exact name wins, else the lowest ordinal whose name the domain
    ends with. Every distinct domain is spread into its endings of a length that some policy has, and those meet the names in
    an equi-join; the work follows distinct domains and their length, not rows times policies. Of repeated names the lowest
    ordinal counts; a policy without a name or ordinal matches nothing.
    """
    named = policies.filter(F.col("ordinal").isNotNull() & (F.length("domain") > 0))
    fields = [c for c in policies.columns if c not in ("ordinal", "domain")]
    firsts = named.groupBy(F.col("domain").alias("_name")).agg(F.min_by(F.struct("ordinal", *fields), "ordinal").alias("_policy"))
    keys = df.select(F.col(domain).alias("_key")).distinct().select("_key", domain_of("_key").alias("_host")).filter(F.length("_host") > 0)
    endings = keys.select("_key", "_host", F.explode(F.sequence(F.lit(1), F.length("_host"))).alias("_n")) \
        .select("_key", F.expr("right(_host, _n)").alias("_name"), (F.col("_n") == F.length("_host")).alias("_exact"))
    best = endings.join(firsts, "_name").groupBy("_key").agg(
        F.min_by("_policy", F.struct(~F.col("_exact"), F.col("_policy.ordinal"))).alias("_policy"), F.min_by("_name", F.struct(
            ~F.col("_exact"), F.col("_policy.ordinal"))).alias("policy_domain"),
    )
    return df.join(best, df[domain] == best["_key"], "left").select(
        *df.columns, "policy_domain", F.col("_policy.ordinal").alias("policy_ordinal"), *[F.col(f"_policy.{f}").alias(f) for f in fields],
    )


def domain_stats(requests: DataFrame, as_of) -> DataFrame:
    """Load, totals and caps per domain.

    Aggregated first, so that the policy lookup runs once per domain.
    """
    now = ts_literal(as_of)
    recent = (F.col("ts") > now - F.expr("INTERVAL 60 SECONDS")) & (F.col("ts") <= now)
    totals = requests.groupBy("domain").agg(
        F.count_if(recent).alias("requests_last_minute"),
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("blocked")).alias("total_blocked"),
        F.max("ts").alias("last_request_at"),
    )
    return with_policy(totals).drop("policy_ordinal", "requires_auth")


def load_band(current, cap) -> Column:
    pct = as_col(current) / as_col(cap)
    return F.when(pct >= 0.9, F.lit("red")).when(pct >= 0.6, F.lit("yellow")).otherwise(F.lit("green"))


def cap_breaches(requests: DataFrame, closed: bool = False) -> DataFrame:
    """Requests sent while the trailing minute was already at the cap.

    The policy comes before the count: a filter on the count cannot move below it, where it would work the policy out anew.
    """
    ruled = with_policy(requests)
    counted = trailing_count(ruled, "domain", 60, closed=closed, name="trailing").filter(F.col("trailing") > F.col("max_rpm"))
    return counted.select(*requests.columns, "trailing", *[c for c in ruled.columns if c not in requests.columns])


def active_over_time(spans: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Open requests per domain after every start and end, never below zero.

    Clamping at zero after each step equals the plain running sum minus the
    lowest point it has reached below zero, so two running aggregates replace
    a row-by-row fold.
    """
    steps = spans.select("domain", "event_id", F.explode(F.array(
        F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("step")),
        F.struct(F.col("end_ts").alias("ts"), F.lit(-1).alias("step")),
    )).alias("s")).select("domain", "event_id", "s.ts", "s.step").filter(F.col("ts").isNotNull())
    return clamp_running(steps, bucket_seconds)


def clamp_running(steps: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``active`` after each step of ``(domain, event_id, ts, step)``."""
    order = ["ts", F.col("step").desc(), "event_id"]
    bucket = time_bucket("ts", bucket_seconds)
    both = running(
        steps, ["domain"], order, bucket, {"_level": ("sum", F.col("step")), "_low": ("lowest_sum", F.col("step"))}
    )
    active = F.col("_level") - F.least(F.col("_low"), F.lit(0))
    return both.withColumn("active", active.cast("bigint")).drop("_level", "_low")


def violations(requests: DataFrame) -> DataFrame:
    return requests.filter(is_rate_limited("status"))


def recent_violations(stats: DataFrame, viol: DataFrame, as_of, minutes: int, name: str = "recent") -> DataFrame:
    """Violations of each domain in the last ``minutes``: counted, then joined."""
    now = ts_literal(as_of)
    counts = (
        viol.filter((F.col("ts") > now - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col("ts") <= now))
        .groupBy("domain").agg(F.count(F.lit(1)).alias(name))
    )
    return stats.join(counts, "domain", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def violations_before(requests: DataFrame, viol: DataFrame, minutes: tuple[int, ...] = (10, 30)) -> DataFrame:
    """Every request with the violations of its domain in the last so many minutes: ``violations_10m``, ``violations_30m``.

    ``recent_violations`` for as many moments as there are requests: a band join that never forms the pairs. Both tables go into
    slots of time, a violation also into the next slot where it still counts there; a running sum of violations that enter and
    leave a width gives its count. A violation exactly ``minutes`` old has left, one at the moment itself counts.
    """
    return band_counts(requests, viol, "domain", {f"violations_{m}m": 60 * m for m in minutes})


def attempt_no(
    log: DataFrame, bucket_seconds: int = BUCKET_SECONDS, cap: int | None = None, carried: DataFrame | None = None,
) -> DataFrame:
    """Failures since the last success of the domain, on failure rows.

    ``log`` holds (domain, ts, event_id, success).  Failures so far minus
    failures at the latest success gives the number inside the current run.
    ``carried`` (domain, fails) counts earlier failures that no success has
    ended yet; ``cap=MAX_BACKOFF_ATTEMPTS`` stops counting as backoff does.
    """
    order, bucket = ["ts", "event_id"], time_bucket("ts", bucket_seconds)
    failed = F.when(F.col("success"), F.lit(0)).otherwise(F.lit(1))
    both = running(
        log, ["domain"], order, bucket, {"_fails": ("sum", failed), "_reset": ("highest_sum", failed, F.col("success"))}
    ).filter(~F.col("success"))
    number = F.col("_fails") - F.coalesce("_reset", F.lit(0))
    if carried is not None:
        earlier = carried.select(F.col("domain").alias("_domain"), F.col("fails").alias("_earlier"))
        both = both.join(earlier, F.col("domain").eqNullSafe(F.col("_domain")), "left").drop("_domain")
        number = number + F.when(F.col("_reset").isNull(), F.coalesce("_earlier", F.lit(0))).otherwise(F.lit(0))
    if cap is not None:
        number = F.least(number, F.lit(cap))
    return both.withColumn("attempt", number.cast("bigint")).drop("_fails", "_reset", "_earlier")


def violation_records(log: DataFrame, n: int | None = None) -> DataFrame:
    """Throttled and blocked requests with reason, attempt and the wait before the next try.

    ``log`` holds (event_id, domain, ts, status). ``n=VIOLATION_HISTORY`` keeps the newest, as the collected system does.
    """
    failed = attempt_no(log.withColumn("success", F.coalesce(F.col("status") == 200, F.lit(False))))
    rows = with_policy(failed.filter(is_rate_limited("status"))).withColumns({
        "reason": failure_class("status"), "backoff_ms": backoff_ms("attempt", "backoff_mult", "max_backoff_ms"),
    })
    if n is not None:
        rows = last_n(rows, n, ["ts", "event_id"])
    columns = {"status_code": "status"}
    return rows.select(*[F.col(columns.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in schema.VIOLATION], "event_id")


def recent_history(viol: DataFrame, n: int = K.RECENT_VIOLATIONS_SHOWN) -> DataFrame:
    """The newest violations, newest first."""
    return last_n(viol, n, ["ts", "event_id"])


def busiest_domains(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.col("total_requests").desc(), "domain")


def rate_limit_report(requests: DataFrame, as_of) -> DataFrame:
    """Per-domain status with load bands and advice."""
    viol = violations(requests)
    stats = domain_stats(requests, as_of)
    stats = recent_violations(stats, viol, as_of, 10, "violations_10m")
    stats = recent_violations(stats, viol, as_of, 30, "violations_30m")
    rpm, cap = F.col("requests_last_minute"), F.col("max_rpm")
    load = rpm / cap
    advice = F.array_compact(F.array(
        F.when(F.col("violations_30m") >= 3, F.lit("slow_down")),
        F.when((F.col("violations_30m") == 0) & (load < 0.4) & (F.col("total_requests") > 20), F.lit("speed_up")),
        F.when((F.col("risk") == "HIGH") & (rpm >= cap * 0.8), F.lit("near_cap")),
    ))
    return stats.withColumns({
        "load_pct": half_up(load * 100),
        "load_band": load_band(rpm, cap),
        "advice": F.array_join(advice, ","),
    })


def known_domains(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every domain seen in either of two tables, once."""
    return a.select("domain").union(b.select("domain")).distinct()
