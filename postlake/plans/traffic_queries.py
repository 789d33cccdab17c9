"""Queries over run metrics, health, rate limits and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions import scalars
from postlake.functions.urls import domain_of
from postlake.operators import alerts, health, metrics, traffic
from postlake.operators.running import last_n, trailing_count
from postlake.plans import sqltext as S
from postlake.plans import views as V
from postlake.plans.registry import ORACLES, query
from postlake.sources.tables import read_table

_START, _NOW = f"TIMESTAMP '{V.RUN_START}'", f"TIMESTAMP '{V.AS_OF}'"


def _us(c):
    return F.unix_micros(c)


# --- run metrics --------------------------------------------------------------------

def _sql_counts(extra_group: str = "") -> str:
    names = ", ".join(f"count(*) FILTER (event_type = '{v}') AS {k}" for k, v in metrics._COUNTERS.items())
    return f"""SELECT {extra_group} {names},
      count(*) FILTER (event_type = 'request_started' AND ts >= {_NOW} - INTERVAL 60 SECOND AND ts <= {_NOW}) AS requests_per_minute,
      max(ts) FILTER (event_type = 'extracted') AS last_extracted_at FROM v_run_events"""


_SQL_RATES = f"""
  CASE WHEN requests_succeeded + requests_failed > 0 THEN {S.half_up('requests_succeeded / (requests_succeeded + requests_failed) * 100')}
    ELSE 100 END AS success_rate_pct,
  CASE WHEN jobs_extracted > 0 THEN {S.half_up('jobs_deduplicated / jobs_extracted * 100', 1)} ELSE 0.0::DOUBLE END AS dedup_ratio_pct,
  {S.half_up(f"CAST(jobs_extracted AS DOUBLE) / greatest(1.0::DOUBLE / 60, (epoch_us({_NOW}) - epoch_us({_START})) / 1e6::DOUBLE / 60)", 1)} AS jobs_per_minute,
  {S.half_up(f"(epoch_us({_NOW}) - epoch_us({_START})) / 1e6::DOUBLE")} AS uptime_seconds
"""
_COUNT_COLS = ", ".join(metrics._COUNTERS)


def _metric_cols(df, *extra):
    return df.select(
        *extra, *metrics._COUNTERS, "requests_per_minute", _us("last_extracted_at").alias("last_extracted_us"),
        "success_rate_pct", "dedup_ratio_pct", "jobs_per_minute", "uptime_seconds",
    )


@query(
    "run_metrics",
    f"""WITH {V.SQL_RUN_EVENTS}, c AS ({_sql_counts()}) SELECT {_COUNT_COLS}, requests_per_minute,
      epoch_us(last_extracted_at) AS last_extracted_us, {_SQL_RATES} FROM c""",
)
def run_metrics(spark, sf):
    return _metric_cols(metrics.run_metrics(V.v_run_events(spark, sf), V.AS_OF, V.RUN_START))


@query(
    "run_metrics_by_domain",
    f"""WITH {V.SQL_RUN_EVENTS}, c AS ({_sql_counts('domain,')} GROUP BY domain) SELECT domain, {_COUNT_COLS}, requests_per_minute,
      epoch_us(last_extracted_at) AS last_extracted_us, {_SQL_RATES} FROM c""",
)
def run_metrics_by_domain(spark, sf):
    return _metric_cols(metrics.run_metrics(V.v_run_events(spark, sf), V.AS_OF, V.RUN_START, by=["domain"]), "domain")


def _sql_latency(partition: str, order: str = "ts DESC, event_id DESC") -> str:
    return f"""SELECT *, row_number() OVER ({partition} ORDER BY {order}) AS rn FROM v_run_events
      WHERE event_type = 'request_ok' AND latency_ms >= 0"""


_SQL_LATENCY_AGG = f"""count(*) AS samples, {S.half_up('avg(CAST(latency_ms AS DOUBLE))')} AS avg_latency_ms,
  CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95_latency_ms"""


@query(
    "latency_stats",
    f"WITH {V.SQL_RUN_EVENTS}, l AS ({_sql_latency('')}) SELECT {_SQL_LATENCY_AGG} FROM l WHERE rn <= 100",
)
def latency_stats(spark, sf):
    return metrics.latency_stats(V.v_run_events(spark, sf))


@query(
    "latency_stats_by_domain",
    f"""WITH {V.SQL_RUN_EVENTS}, l AS ({_sql_latency('PARTITION BY domain')})
    SELECT domain, {_SQL_LATENCY_AGG} FROM l WHERE rn <= 100 GROUP BY domain""",
)
def latency_stats_by_domain(spark, sf):
    return metrics.latency_stats(V.v_run_events(spark, sf), by=["domain"])


@query(
    "gauge_stats",
    f"SELECT {S.half_up('max(value)')} AS peak, {S.half_up('arg_max(value, (ts, event_id))')} AS current FROM events",
)
def gauge_stats(spark, sf):
    return metrics.gauge_stats(V.v_gauge(spark, sf))


_SQL_SNAPSHOT = f"""{V.SQL_RUN_EVENTS}, c AS ({_sql_counts()}), l AS ({_sql_latency('')}),
  ls AS (SELECT {_SQL_LATENCY_AGG} FROM l WHERE rn <= 100),
  g AS (SELECT {S.half_up('max(value)')} AS peak_memory_mb, {S.half_up('arg_max(value, (ts, event_id))')} AS current_memory_mb FROM events),
  snap AS (SELECT *, {_SQL_RATES} FROM c, ls, g)"""


def _snapshot(spark, sf):
    return metrics.snapshot(V.v_run_events(spark, sf), V.AS_OF, V.RUN_START, V.v_gauge(spark, sf))


@query(
    "metrics_snapshot",
    f"""WITH {_SQL_SNAPSHOT} SELECT {_COUNT_COLS}, requests_per_minute, epoch_us(last_extracted_at) AS last_extracted_us,
      success_rate_pct, dedup_ratio_pct, jobs_per_minute, uptime_seconds, samples, avg_latency_ms, p95_latency_ms,
      peak_memory_mb, current_memory_mb FROM snap""",
)
def metrics_snapshot(spark, sf):
    return _metric_cols(
        _snapshot(spark, sf), "samples", "avg_latency_ms", "p95_latency_ms", "peak_memory_mb", "current_memory_mb"
    )


@query(
    "kpis",
    f"""WITH {_SQL_SNAPSHOT} SELECT {S.half_up('jobs_extracted * 60 / CAST(uptime_seconds AS DOUBLE)', 1)} AS jobs_per_minute,
      dedup_ratio_pct, p95_latency_ms, {S.half_up('(requests_started - proxy_failures) / requests_started * 100', 1)} AS proxy_pass_pct,
      {S.half_up('rate_limit_hits / requests_started * 100', 1)} AS rate_limit_pct FROM snap""",
)
def kpis(spark, sf):
    return metrics.kpis(_snapshot(spark, sf))


# --- health ---------------------------------------------------------------------------

def _sql_check(name, value, warn, crit, crit_text, warn_text, worse=">="):
    return f"""SELECT {{keys}} '{name}' AS name, NOT ({value} {worse} {warn}) AS passed,
      CASE WHEN {value} {worse} {crit} THEN 'critical' ELSE 'warning' END AS severity,
      CASE WHEN {value} {worse} {crit} THEN {crit_text} WHEN {value} {worse} {warn} THEN {warn_text} ELSE 'OK' END AS reason,
      CAST({value} AS VARCHAR) AS value, CASE WHEN {value} {worse} {crit} THEN '{crit}' ELSE '{warn}' END AS threshold FROM {{src}}"""


_MIN = S.half_up(f"(epoch_us({_NOW}) - epoch_us(last_extracted_at)) / 6e7::DOUBLE")
_CHECKS = " UNION ALL ".join([
    _sql_check("success_rate", "success_rate_pct", 70, 40,
               "success_rate_pct || ' of 100 requests succeed; critical below 40'",
               "success_rate_pct || ' of 100 requests succeed; warning below 70'", "<"),
    _sql_check("no_progress", f"({_MIN})", 20, 45,
               f"'nothing extracted in the last ' || {_MIN} || ' minutes; critical from 45'",
               f"'nothing extracted in the last ' || {_MIN} || ' minutes; warning from 20'"),
    _sql_check("memory_usage", "current_memory_mb", 2500, 3500,
               "current_memory_mb || ' MB in use; critical from 3500'",
               "current_memory_mb || ' MB in use; warning from 2500'"),
    _sql_check("rate_limit_hits", "rate_limit_hits", 10, 30,
               "rate_limit_hits || ' requests were throttled; critical from 30'", "rate_limit_hits || ' requests were throttled; warning from 10'"),
    _sql_check("proxy_failures", "proxy_failures", 5, 20,
               "proxy_failures || ' requests failed at a proxy; critical from 20'", "proxy_failures || ' requests failed at a proxy; warning from 5'"),
    "SELECT {keys} 'zero_jobs_early' AS name, true AS passed, 'warning' AS severity, 'OK' AS reason, "
    "CAST(jobs_extracted AS VARCHAR) AS value, '0' AS threshold FROM {src}",
])


@query("health_checks", f"WITH {_SQL_SNAPSHOT} {_CHECKS.format(keys='', src='snap')}")
def health_checks(spark, sf):
    return health.health_checks(_snapshot(spark, sf))


_SQL_SUMMARY = """'run is ' || severity || ': ' || reasons || '; '
  || regexp_replace(CAST(jobs_per_minute AS VARCHAR), '[.]0$', '') || ' jobs/min, dedup '
  || regexp_replace(CAST(dedup_ratio_pct AS VARCHAR), '[.]0$', '') || '% (' || jobs_deduplicated || '/' || jobs_extracted
  || '), stored ' || jobs_stored"""


@query(
    "health_report",
    f"""WITH {_SQL_SNAPSHOT}, checks AS ({_CHECKS.format(keys='', src='snap')}),
    f AS (SELECT CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' WHEN count(*) > 0 THEN 'degraded'
        ELSE 'healthy' END AS severity, string_agg(severity || ' (' || reason || ')', ', ' ORDER BY
        list_position(['success_rate', 'no_progress', 'memory_usage', 'rate_limit_hits', 'proxy_failures', 'zero_jobs_early'], name)) AS reasons
      FROM checks WHERE NOT passed)
    SELECT severity, {_SQL_SUMMARY} AS summary FROM f, snap""",
)
def health_report(spark, sf):
    return health.health_report(_snapshot(spark, sf)).select("severity", "summary")


def _domain_snapshots(spark, sf):
    return metrics.run_metrics(V.v_run_events(spark, sf), V.AS_OF, V.RUN_START, by=["domain"]).withColumns({
        "snapshot_at": F.lit(V.AS_OF).cast("timestamp"), "current_memory_mb": F.lit(0).cast("bigint"),
    })


@query(
    "health_alerts_by_domain",
    f"""WITH {V.SQL_RUN_EVENTS}, c AS ({_sql_counts('domain,')} GROUP BY domain),
    snap AS (SELECT *, CAST(0 AS BIGINT) AS current_memory_mb, {_SQL_RATES} FROM c),
    checks AS ({_CHECKS.format(keys='domain,', src='snap')}),
    f AS (SELECT domain, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' ELSE 'degraded' END AS severity
      FROM checks WHERE NOT passed GROUP BY domain)
    SELECT CASE f.severity WHEN 'critical' THEN 'critical' ELSE 'warning' END AS alert_severity, f.severity AS message, jobs_extracted,
      success_rate_pct || '%' AS success_rate, rate_limit_hits, current_memory_mb AS memory_mb, uptime_seconds AS uptime_sec
    FROM f JOIN snap USING (domain)""",
)
def health_alerts_by_domain(spark, sf):
    return health.alert_rows(health.health_report(_domain_snapshots(spark, sf))).withColumn(
        "message", F.regexp_extract("message", "^run is ([a-z]+):", 1))


@query(
    "stall_gaps",
    f"""WITH {V.SQL_RUN_EVENTS} SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6::DOUBLE
      AS gap_seconds FROM v_run_events WHERE event_type = 'extracted'""",
)
def stall_gaps(spark, sf):
    return metrics.stall_gaps(V.v_run_events(spark, sf)).select("event_id", "gap_seconds")


# --- traffic ----------------------------------------------------------------------------

@query(
    "trailing_requests",
    f"""WITH {V.SQL_TRAFFIC} SELECT event_id, count(*) OVER (PARTITION BY domain ORDER BY ts
      RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS trailing FROM v_traffic""",
)
def trailing_requests(spark, sf):
    return trailing_count(V.v_traffic(spark, sf), "domain", 3600).select("event_id", "trailing")


@query(
    "trailing_requests_open",
    f"""WITH {V.SQL_TRAFFIC} SELECT event_id, count(*) OVER (PARTITION BY domain ORDER BY ts
      RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS trailing FROM v_traffic""",
)
def trailing_requests_open(spark, sf):
    return trailing_count(V.v_traffic(spark, sf), "domain", 3600, closed=False).select("event_id", "trailing")


_POLICY_COLS = [f for f in K.POLICY_FIELDS if f not in ("domain", "requires_auth")]
_INT_POLICY = {"max_rpm", "min_delay_ms", "jitter_ms", "max_concurrent", "max_backoff_ms"}


def _sql_policy_cols() -> str:
    return ", ".join(
        f"CAST(p_{c} AS {'BIGINT' if c in _INT_POLICY else 'VARCHAR' if c == 'risk' else 'DOUBLE'}) AS {c}" for c in _POLICY_COLS
    )


def _policy_out():
    return [F.col(c).cast("bigint").alias(c) if c in _INT_POLICY else F.col(c) for c in _POLICY_COLS]


_SQL_PNAME = f"CASE WHEN ord > {len(K.RATE_POLICIES)} THEN clean_domain ELSE p_domain END"


@query(
    "policy_lookup",
    f"""WITH {V.SQL_TRAFFIC}, {S.POL}, j AS {S.policy_join('v_traffic')}
    SELECT event_id, {_SQL_PNAME} AS policy_domain, {_sql_policy_cols()} FROM j""",
)
def policy_lookup(spark, sf):
    return traffic.with_policy(V.v_traffic(spark, sf)).select("event_id", "policy_domain", *_policy_out())


@query(
    "delay_bounds",
    f"""WITH {V.SQL_TRAFFIC}, {S.POL}, j AS {S.policy_join('v_traffic')},
    m AS (SELECT *, CASE WHEN hour(ts + INTERVAL 330 MINUTES) BETWEEN 9 AND 18 THEN CAST(p_business_mult AS DOUBLE) ELSE 1.0 END AS mult FROM j)
    SELECT event_id, {S.half_up('p_min_delay_ms * mult')} AS delay_min_ms, {S.half_up('(p_min_delay_ms + p_jitter_ms) * mult')} AS delay_max_ms FROM m""",
)
def delay_bounds(spark, sf):
    return traffic.with_policy(V.v_traffic(spark, sf)).withColumns(scalars.delay_bounds("ts")).select(
        "event_id", "delay_min_ms", "delay_max_ms"
    )


@query(
    "backoff_waits",
    f"""WITH {V.SQL_TRAFFIC}, {S.POL}, j AS {S.policy_join('v_traffic')}
    SELECT event_id, {S.half_up('least(30000 * pow(CAST(p_backoff_mult AS DOUBLE), event_id % 5), p_max_backoff_ms)')} AS backoff_ms FROM j""",
)
def backoff_waits(spark, sf):
    rows = traffic.with_policy(V.v_traffic(spark, sf))
    return rows.select(
        "event_id", scalars.backoff_ms(F.col("event_id") % 5 + 1, "backoff_mult", "max_backoff_ms").alias("backoff_ms")
    )


_SQL_STATS = f"""{V.SQL_TRAFFIC}, {S.POL}, t AS (SELECT domain,
    count(*) FILTER (ts > {_NOW} - INTERVAL 60 SECOND AND ts <= {_NOW}) AS requests_last_minute, count(*) AS total_requests,
    count(*) FILTER (blocked) AS total_blocked, max(ts) AS last_request_at FROM v_traffic GROUP BY domain),
  stats AS {S.policy_join('t')}"""


@query(
    "domain_stats",
    f"""WITH {_SQL_STATS} SELECT domain, requests_last_minute, total_requests, total_blocked, epoch_us(last_request_at) AS last_us,
      CAST(p_max_rpm AS BIGINT) AS max_rpm, CAST(p_max_concurrent AS BIGINT) AS max_concurrent, p_risk AS risk FROM stats""",
)
def domain_stats(spark, sf):
    return traffic.domain_stats(V.v_traffic(spark, sf), V.AS_OF).select(
        "domain", "requests_last_minute", "total_requests", "total_blocked", _us("last_request_at").alias("last_us"),
        F.col("max_rpm").cast("bigint").alias("max_rpm"), F.col("max_concurrent").cast("bigint").alias("max_concurrent"), "risk",
    )


# The test log is thin, so its time axis is squeezed 600-fold to reach the caps.
_SQL_SQUEEZED = f"make_timestamp(epoch_us({_START}) + CAST(floor((epoch_us(ts) - epoch_us({_START})) / 600) AS BIGINT))"


@query(
    "cap_breaches",
    f"""WITH {V.SQL_TRAFFIC}, dense AS (SELECT event_id, domain, {_SQL_SQUEEZED} AS ts FROM v_traffic),
    w AS (SELECT *, count(*) OVER (PARTITION BY domain ORDER BY ts
      RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS in_window FROM dense),
    {S.POL}, j AS {S.policy_join('w')}
    SELECT event_id, in_window, CAST(p_max_rpm AS BIGINT) AS max_rpm FROM j WHERE in_window > p_max_rpm""",
)
def cap_breaches(spark, sf):
    start = _us(F.lit(V.RUN_START).cast("timestamp"))
    squeezed = start + F.floor((_us("ts") - start) / 600).cast("bigint")
    dense = V.v_traffic(spark, sf).withColumn("ts", F.timestamp_micros(squeezed))
    return traffic.cap_breaches(dense).select(
        "event_id", F.col("trailing").alias("in_window"), F.col("max_rpm").cast("bigint").alias("max_rpm")
    )


_SQL_STEPS = f"""{V.SQL_TRAFFIC}, steps AS (
    SELECT event_id, domain, ts, 1 AS step FROM v_traffic WHERE status <> 407 UNION ALL
    SELECT event_id, domain, ts + to_seconds(latency_ms) AS ts, -1 AS step FROM v_traffic)"""


@query(
    "active_requests",
    f"""WITH {_SQL_STEPS}, lv AS (SELECT *, sum(step) OVER w AS lvl FROM steps WINDOW w AS (PARTITION BY domain
      ORDER BY ts, step DESC, event_id ROWS UNBOUNDED PRECEDING)),
    lo AS (SELECT *, min(lvl) OVER (PARTITION BY domain ORDER BY ts, step DESC, event_id ROWS UNBOUNDED PRECEDING) AS low FROM lv)
    SELECT event_id, CAST(step AS BIGINT) AS step, CAST(lvl - least(low, 0) AS BIGINT) AS active FROM lo""",
)
def active_requests(spark, sf):
    # Starts of proxy failures were never logged, so their ends run below zero.
    spans = V.v_traffic(spark, sf).select(
        "event_id", "domain", F.when(F.col("status") != 407, F.col("ts")).alias("start_ts"),
        F.timestamp_micros(_us("ts") + F.col("latency_ms") * 1000000).alias("end_ts"),
    )
    return traffic.active_over_time(spans).select("event_id", F.col("step").cast("bigint").alias("step"), "active")


@query(
    "attempt_numbers",
    f"""WITH {V.SQL_TRAFFIC}, g AS (SELECT *, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY domain
      ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_traffic)
    SELECT event_id, row_number() OVER (PARTITION BY domain, island ORDER BY ts, event_id) AS attempt
    FROM g WHERE status <> 200""",
)
def attempt_numbers(spark, sf):
    log = V.v_traffic(spark, sf).withColumn("success", F.col("status") == 200)
    return traffic.attempt_no(log).select("event_id", F.col("attempt").cast("bigint").alias("attempt"))


@query(
    "recent_violations",
    f"""WITH {_SQL_STATS} SELECT domain, (SELECT count(*) FROM v_traffic v WHERE v.domain = stats.domain AND status IN (429, 403, 503)
      AND v.ts > {_NOW} - INTERVAL 3000 MINUTE AND v.ts <= {_NOW}) AS recent FROM stats""",
)
def recent_violations(spark, sf):
    rows = V.v_traffic(spark, sf)
    stats = traffic.domain_stats(rows, V.AS_OF)
    return traffic.recent_violations(stats, traffic.violations(rows), V.AS_OF, 3000).select("domain", "recent")


@query(
    "violation_records",
    f"""WITH {V.SQL_TRAFFIC}, {S.POL}, j AS {S.policy_join('v_traffic')}, a AS ({ORACLES['attempt_numbers']})
    SELECT event_id, j.domain, CASE j.status WHEN 429 THEN 'soft_block' WHEN 403 THEN 'hard_block' ELSE 'permanent' END AS reason,
      CAST(j.status AS BIGINT) AS status_code, epoch_us(j.ts) AS ts_us, attempt,
      {S.half_up('least(30000 * pow(CAST(p_backoff_mult AS DOUBLE), attempt - 1), p_max_backoff_ms)')} AS backoff_ms
    FROM j JOIN a USING (event_id) WHERE j.status IN (429, 403, 503)""",
)
def violation_records(spark, sf):
    return traffic.violation_records(V.v_traffic(spark, sf)).select(
        "event_id", "domain", "reason", F.col("status_code").cast("bigint").alias("status_code"), _us("ts").alias("ts_us"), "attempt", "backoff_ms"
    )


@query(
    "violation_history",
    f"""WITH {V.SQL_TRAFFIC} SELECT event_id, domain FROM v_traffic WHERE status IN (429, 403, 503)
      ORDER BY ts DESC, event_id DESC LIMIT 20""",
)
def violation_history(spark, sf):
    return traffic.recent_history(traffic.violations(V.v_traffic(spark, sf))).select("event_id", "domain")


@query(
    "last_violations_per_domain",
    f"""WITH {V.SQL_TRAFFIC} SELECT domain, event_id FROM v_traffic WHERE status IN (429, 403, 503)
      QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 5""",
)
def last_violations_per_domain(spark, sf):
    return last_n(traffic.violations(V.v_traffic(spark, sf)), 5, ["ts", "event_id"], ["domain"]).select("domain", "event_id")


@query(
    "busiest_domains",
    f"WITH {V.SQL_TRAFFIC} SELECT domain, count(*) AS total_requests FROM v_traffic GROUP BY 1 ORDER BY 2 DESC, 1",
)
def busiest_domains(spark, sf):
    return traffic.busiest_domains(traffic.domain_stats(V.v_traffic(spark, sf), V.AS_OF)).select("domain", "total_requests")


@query(
    "known_domains",
    f"""WITH {V.SQL_TRAFFIC}, p AS (SELECT {S.domain_of('url')} AS domain FROM pages)
    SELECT domain FROM v_traffic UNION SELECT domain FROM p""",
)
def known_domains(spark, sf):
    pages = read_table(spark, sf, "pages").select(domain_of("url").alias("domain"))
    return traffic.known_domains(V.v_traffic(spark, sf), pages)


_SQL_REPORT = f"""{_SQL_STATS},
  v AS (SELECT domain, count(*) FILTER (ts > {_NOW} - INTERVAL 10 MINUTE) AS v10, count(*) FILTER (ts > {_NOW} - INTERVAL 30 MINUTE) AS v30
    FROM v_traffic WHERE status IN (429, 403, 503) AND ts <= {_NOW} GROUP BY domain),
  r AS (SELECT s.*, coalesce(v10, 0) AS v10, coalesce(v30, 0) AS v30, requests_last_minute / CAST(p_max_rpm AS DOUBLE) AS load
    FROM stats s LEFT JOIN v ON s.domain = v.domain)"""


@query(
    "rate_limit_report",
    f"""WITH {_SQL_REPORT} SELECT domain, total_requests, total_blocked, v10 AS violations_10m, v30 AS violations_30m,
      {S.half_up('load * 100')} AS load_pct, CASE WHEN load >= 0.9 THEN 'red' WHEN load >= 0.6 THEN 'yellow' ELSE 'green' END AS load_band,
      concat_ws(',', CASE WHEN v30 >= 3 THEN 'slow_down' END, CASE WHEN v30 = 0 AND load < 0.4 AND total_requests > 20 THEN 'speed_up' END,
        CASE WHEN p_risk = 'HIGH' AND requests_last_minute >= p_max_rpm * 0.8 THEN 'near_cap' END) AS advice FROM r""",
)
def rate_limit_report(spark, sf):
    return traffic.rate_limit_report(V.v_traffic(spark, sf), V.AS_OF).select(
        "domain", "total_requests", "total_blocked", "violations_10m", "violations_30m", "load_pct", "load_band", "advice"
    )


@query(
    "alert_cooldown",
    f"""WITH RECURSIVE {V.SQL_ALERTS}, a AS (SELECT *, channel || ':' || severity AS key FROM v_alerts),
    sent AS (SELECT key, min(ts) AS ts FROM a GROUP BY key
      UNION ALL SELECT key, nxt AS ts FROM (SELECT s.key, (SELECT min(a.ts) FROM a WHERE a.key = s.key
        AND a.ts >= s.ts + INTERVAL 15 MINUTE) AS nxt FROM sent s) WHERE nxt IS NOT NULL)
    SELECT key, epoch_us(ts) AS ts_us FROM sent""",
)
def alert_cooldown(spark, sf):
    return alerts.suppress_cooldown(V.v_alerts(spark, sf)).select("key", _us("ts").alias("ts_us"))


# --- policies as data, violations before every request ------------------------------------

@query(
    "policy_table",
    """WITH pol AS (SELECT c_custkey AS ordinal, c_custkey % 997 || '.example.com' AS name, 1 + c_custkey % 9 AS max_rpm FROM customer),
    hosts AS (SELECT o_orderkey, 'shop' || o_custkey % 2003 || CASE WHEN o_orderkey % 5 = 0 THEN '.example.org' ELSE '.example.com' END AS domain
      FROM orders),
    exact AS (SELECT o_orderkey, domain, CASE WHEN o_orderkey % 7 = 0 THEN substring(domain, 5) ELSE domain END AS host FROM hosts),
    d AS (SELECT DISTINCT host FROM exact),
    m AS (SELECT host, coalesce((SELECT min(ordinal) FROM pol WHERE name = host), (SELECT min(ordinal) FROM pol WHERE ends_with(host, name)))
      AS ordinal FROM d)
    SELECT o_orderkey, host, m.ordinal AS policy_ordinal, p.name AS policy_domain, CAST(p.max_rpm AS BIGINT) AS max_rpm
      FROM exact JOIN m USING (host) LEFT JOIN pol p ON p.ordinal = m.ordinal""",
)
def policy_table(spark, sf):
    """A policy for every customer, by exact name or ending, looked up for the host of every order."""
    policies = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ordinal"), F.concat((F.col("c_custkey") % 997).cast("string"), F.lit(".example.com")).alias("domain"),
        (F.col("c_custkey") % 9 + 1).cast("bigint").alias("max_rpm"),
    )
    end = F.when(F.col("o_orderkey") % 5 == 0, F.lit(".example.org")).otherwise(F.lit(".example.com"))
    number = F.concat((F.col("o_custkey") % 2003).cast("string"), end)
    host = F.when(F.col("o_orderkey") % 7 == 0, number).otherwise(F.concat(F.lit("shop"), number))
    rows = read_table(spark, sf, "orders").select("o_orderkey", host.alias("host"))
    return traffic.match_policies(rows, policies, "host")


@query(
    "violations_before_requests",
    f"""WITH {V.SQL_TRAFFIC}, dense AS (SELECT event_id, domain, {_SQL_SQUEEZED} AS ts, blocked FROM v_traffic)
    SELECT event_id, CAST(count(*) FILTER (blocked) OVER (PARTITION BY domain ORDER BY ts
        RANGE BETWEEN INTERVAL '599.999999 seconds' PRECEDING AND CURRENT ROW) AS BIGINT) AS violations_10m,
      CAST(count(*) FILTER (blocked) OVER (PARTITION BY domain ORDER BY ts
        RANGE BETWEEN INTERVAL '1799.999999 seconds' PRECEDING AND CURRENT ROW) AS BIGINT) AS violations_30m FROM dense""",
)
def violations_before_requests(spark, sf):
    start = _us(F.lit(V.RUN_START).cast("timestamp"))
    log = V.v_traffic(spark, sf).withColumn("ts", F.timestamp_micros(start + F.floor((_us("ts") - start) / 600).cast("bigint")))
    return traffic.violations_before(log.select("event_id", "domain", "ts"), traffic.violations(log)).drop("domain", "ts")
