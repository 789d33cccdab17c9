"""Metrics, health, traffic reports, gates, ledger and cache."""

import pytest
from pyspark.sql import functions as F

from postlake.operators import health, ledger, listings, metrics, traffic
from postlake.operators.frontier import frontier

START = "2024-01-01 00:00:00"



def events_of(spark, started, modulo, base, jitter, extracted, deduplicated, rate_limited, proxy_failed):
    i = F.col("id")
    failed = i % modulo == 0
    latency = base + (i * 31 + 7) % jitter
    requests = spark.range(started).select(
        i.alias("event_id"), F.explode(F.array(
            F.lit("request_started"), F.when(failed, F.lit("request_failed")).otherwise(F.lit("request_ok")))).alias("event_type"),
        latency.cast("bigint").alias("latency_ms"),
    )
    for name, n in (("extracted", extracted), ("deduplicated", deduplicated), ("rate_limited", rate_limited), ("proxy_failed", proxy_failed)):
        requests = requests.unionByName(spark.range(n).select(
            (i + 1000000).alias("event_id"), F.lit(name).alias("event_type"), F.lit(None).cast("bigint").alias("latency_ms")))
    return requests.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + F.col("event_id")))


# requests, failure modulo, latency base and jitter, extracted, deduplicated, rate-limit hits, proxy failures, seconds
@pytest.mark.parametrize("profile,want", [
    ((180, 12, 90, 55, 120, 30, 8, 6, 120), (165, 15, 92, 25.0, 60.0, 96.7, 4.4, 117, 142)),
    ((1500, 11, 110, 90, 920, 280, 70, 45, 420), (1363, 137, 91, 30.4, 131.4, 97.0, 4.7, 156, 196)),
    ((6000, 10, 125, 140, 3600, 1260, 420, 190, 1200), (5400, 600, 90, 35.0, 180.0, 96.8, 7.0, 193, 255)),
])
def test_run_profiles(spark, profile, want):
    started, modulo, base, jitter, extracted, dup, limited, proxy, secs = profile
    events = events_of(spark, started, modulo, base, jitter, extracted, dup, limited, proxy)
    as_of = F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.lit(secs))
    snap = metrics.snapshot(events, as_of, START)
    row, kpi = snap.first(), metrics.kpis(snap).first()
    assert (row.requests_succeeded, row.requests_failed, row.success_rate_pct, row.dedup_ratio_pct) == want[:4]
    assert (kpi.jobs_per_minute, kpi.proxy_pass_pct, kpi.rate_limit_pct) == want[4:7]
    assert (row.avg_latency_ms, row.p95_latency_ms) == want[7:]


def test_empty_log(spark):
    row = metrics.snapshot(events_of(spark, 0, 2, 1, 1, 0, 0, 0, 0), START, START).first()
    assert (row.requests_started, row.success_rate_pct, row.dedup_ratio_pct, row.p95_latency_ms, row.samples) == (0, 100, 0.0, 0, 0)


SNAP = dict(requests_succeeded=90, requests_failed=10, success_rate_pct=90, jobs_extracted=10, jobs_deduplicated=1,
            jobs_stored=9, jobs_per_minute=60.0, dedup_ratio_pct=30.4, rate_limit_hits=0, proxy_failures=0,
            current_memory_mb=100, uptime_seconds=7200, since=60)


def snaps(spark, *changes):
    data = [{**SNAP, **c} for c in changes]
    df = spark.createDataFrame(data)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    ints = [c for c, v in SNAP.items() if isinstance(v, int)]
    return df.withColumns({c: F.col(c).cast("bigint") for c in ints}).withColumns({
        "snapshot_at": now,
        "last_extracted_at": F.when(F.col("since") >= 0, now - F.make_dt_interval(secs=F.col("since").cast("decimal(18,6)"))),
    })


@pytest.mark.parametrize("change,check,passed,severity", [
    ({}, "success_rate", True, "warning"),
    ({"success_rate_pct": 69}, "success_rate", False, "warning"),
    ({"success_rate_pct": 40}, "success_rate", False, "warning"),
    ({"success_rate_pct": 39}, "success_rate", False, "critical"),
    ({"success_rate_pct": 0, "requests_succeeded": 0, "requests_failed": 4}, "success_rate", True, "warning"),
    ({"since": 19 * 60}, "no_progress", True, "warning"),
    ({"since": 20 * 60}, "no_progress", False, "warning"),
    ({"since": 45 * 60}, "no_progress", False, "critical"),
    ({"since": 45 * 60, "uptime_seconds": 1199}, "no_progress", True, "warning"),
    ({"since": -1}, "no_progress", False, "critical"),
    ({"current_memory_mb": 2500}, "memory_usage", False, "warning"),
    ({"current_memory_mb": 3500}, "memory_usage", False, "critical"),
    ({"rate_limit_hits": 10}, "rate_limit_hits", False, "warning"),
    ({"rate_limit_hits": 30}, "rate_limit_hits", False, "critical"),
    ({"proxy_failures": 5}, "proxy_failures", False, "warning"),
    ({"proxy_failures": 20}, "proxy_failures", False, "critical"),
    ({"jobs_extracted": 0, "uptime_seconds": 600}, "zero_jobs_early", False, "warning"),
    ({"jobs_extracted": 0, "uptime_seconds": 500}, "zero_jobs_early", True, "warning"),
])
def test_health_limits(spark, change, check, passed, severity):
    row = health.health_checks(snaps(spark, change)).filter(F.col("name") == check).first()
    assert (row.passed, row.severity) == (passed, severity)


def test_health_report_and_alerts(spark):
    reports = health.health_report(snaps(spark, {}, {"success_rate_pct": 60}, {"rate_limit_hits": 31, "proxy_failures": 6}))
    got = {r.severity: r.summary for r in reports.collect()}
    assert got["healthy"] == ("all checks passed: 10 listings, 90% of requests succeeded, "
                              "60 jobs/min, dedup 30.4% (1/10), stored 9")
    assert got["degraded"].startswith("run is degraded: warning (60 of 100 requests succeed; warning below 70); ")
    assert "critical (31 requests were throttled; critical from 30), warning (6 requests failed at a proxy; warning from 5)" in got["critical"]
    alerts = {r.alert_severity for r in health.alert_rows(reports).collect()}
    assert alerts == {"warning", "critical"}


@pytest.mark.parametrize("n,launch,partial,reason", [
    (30, False, False, "skip-threshold-reached (30 >= 25)"), (25, False, False, "skip-threshold-reached (25 >= 25)"),
    (10, True, True, "partial-api-collection (10/25)"), (0, True, False, "no-api-jobs-collected (threshold=25)"),
])
def test_coverage_gate(spark, n, launch, partial, reason):
    row = metrics.coverage_gate(spark.createDataFrame([(n,)], "collected bigint")).first()
    assert (row.should_launch, row.partial_collection, row.reason) == (launch, partial, reason)


@pytest.mark.parametrize("domain,name,rpm", [
    ("https://custom.example.com/api", "custom.example.com", 10), ("in.linkedin.com", "in.linkedin.com", 4),
    ("jobs.linkedin.com", "linkedin.com", 4), ("notlinkedin.com", "linkedin.com", 4), ("www.internshala.com", "internshala.com", 15),
    ("x.in.indeed.com", "indeed.com", 8),
])
def test_policy_lookup(spark, domain, name, rpm):
    row = traffic.with_policy(spark.createDataFrame([(domain,)], "domain string")).first()
    assert (row.policy_domain, row.max_rpm) == (name, rpm)


def test_rate_limit_advice(spark):
    def requests(domain, n, blocked, first):
        return [(first + i, domain, 3600 - i * 10, 429 if i < blocked else 200) for i in range(n)]

    data = requests("naukri.com", 30, 3, 0) + requests("shine.com", 30, 0, 100) + requests("linkedin.com", 4, 0, 200)
    df = spark.createDataFrame(data, "event_id bigint, domain string, sec bigint, status int").withColumns({
        "ts": F.timestamp_seconds("sec"), "blocked": F.col("status") == 429})
    got = {r.domain: (r.requests_last_minute, r.load_band, r.advice)
           for r in traffic.rate_limit_report(df, F.timestamp_seconds(F.lit(3600))).collect()}
    assert got["naukri.com"] == (6, "yellow", "slow_down")
    assert got["shine.com"] == (6, "green", "") and got["linkedin.com"] == (4, "red", "near_cap")


def test_budget_gate_stays_over(spark):
    calls = spark.createDataFrame(
        [(i, "2024-01-01", "anthropic", 60000) for i in range(4)] + [(9, "2024-01-02", "ollama", 10 ** 9)],
        "call_id bigint, day string, provider string, tokens bigint")
    bucket = F.floor(F.col("call_id") / 2).cast("bigint")
    got = {r.call_id: r.skipped for r in ledger.budget_gate(calls, ["call_id"], bucket, 1.0).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 9: False}
    assert not any(r.skipped for r in ledger.budget_gate(calls, ["call_id"], bucket, 0).collect())
    report = {r.provider: (r.cost_usd, r.exceeded, r.budget_left) for r in ledger.budget_report(ledger.cost_ledger(calls), 1.0).collect()}
    assert report["anthropic"] == (2.4, True, 0.0) and report["ollama"] == (0.0, False, 1.0)


def test_fallback_and_paging(spark):
    a = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 3)], "q string, v int")
    b = spark.createDataFrame([("q1", 10), ("q2", 20), ("q3", 30)], "q string, v int")
    assert sorted(r.v for r in listings.fallback_union(a, b, ["q"], 2).collect()) == [1, 2, 3, 20, 30]
    pages = spark.createDataFrame([("q", 1, 10), ("q", 2, 40), ("q", 3, 5), ("r", 1, 3), ("r", 2, 0), ("r", 3, 9)],
                                  "q string, page_no int, jobs_found int")
    kept = {(r.q, r.page_no) for r in listings.pages_until_enough(pages, ["q"], 50).collect()}
    assert kept == {("q", 1), ("q", 2), ("r", 1), ("r", 2)}


def test_frontier_urls(spark):
    q = spark.createDataFrame([("data analyst", None), ("a&b", "New Delhi")], "keywords string, location string")
    got = {(r.keywords, r.site, r.page_no): r.seed_url for r in frontier(q).collect()}
    assert len(got) == 2 * (5 * 4 + 1 + 10 + 4 + 3 + 1 + 4)
    assert got["data analyst", "indeed", 1] == "https://in.indeed.com/jobs?q=data+analyst&sort=date&limit=10"
    assert got["data analyst", "indeed", 3] == "https://in.indeed.com/jobs?q=data+analyst&start=20&sort=date&limit=10"
    assert got["data analyst", "wellfound", 1] == "https://wellfound.com/jobs?search=data+analyst"
    assert got["data analyst", "shine", 2] == "https://www.shine.com/job-search/data-analyst-jobs/page-2/?q=data%20analyst&experience=0"
    assert got["data analyst", "naukri", 1] == "https://www.naukri.com/data-analyst-jobs-in-india"
    assert got["a&b", "foundit", 2] == "https://www.foundit.in/srp/results?query=a%26b&location=New+Delhi&start=15"
    assert got["a&b", "linkedin", 4].endswith("&pageNum=0&start=75&sortBy=DD")


def test_frontier_fills_a_site_once_per_query(spark):
    """Above the unfolding of pages nothing is encoded or trimmed, and no site's template is left."""
    q = spark.createDataFrame([("data analyst", None), ("a&b", ""), ("x", "New Delhi"), (None, "Pune")], "keywords string, location string")
    text = frontier(q)._jdf.queryExecution().optimizedPlan().toString()
    pages = text[:text.index("Generate explode(sequence")]
    assert "https://" not in pages and "regexp_replace" not in pages and "encode" not in pages
    got = {(r.keywords, r.site, r.page_no): r.seed_url for r in frontier(q).collect()}
    assert len(got) == 4 * 43
    assert got["a&b", "indeed", 1] == "https://in.indeed.com/jobs?q=a%26b&sort=date&limit=10"
    assert got["x", "indeed", 2] == "https://in.indeed.com/jobs?q=x&l=New+Delhi&start=10&sort=date&limit=10"
    assert got["a&b", "timesjobs", 3].endswith("&txtKeywords=a%26b&txtLocation=&sequence=3&startPage=1")
    assert got["x", "shine", 1] == "https://www.shine.com/job-search/x-jobs/?q=x&experience=0"
    assert got["x", "cutshort", 2] == "https://cutshort.io/jobs?keywords=x&experience=0-1&page=2"
    assert got["a&b", "google", 2] == "https://www.google.com/search?q=a%26b+jobs+in+India&ibp=htl%3Bjobs&start=10"
    assert got[None, "indeed", 1] is None
