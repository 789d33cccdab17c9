"""Skew-safe windows, attempts, concurrency and cooldown against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.operators import alerts, traffic
from postlake.operators.running import band_counts, keep_first, last_n, running, time_bucket, trailing_count


def log(spark, seed, n=400, span=20000, hot=0.5):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(4)}"
        data.append((i, key, rnd.randrange(span) if rnd.random() < 0.9 else 600 * rnd.randrange(30), rnd.random() < 0.3))
    df = spark.createDataFrame(data, "event_id bigint, domain string, sec bigint, success boolean")
    return data, df.withColumn("ts", F.timestamp_seconds("sec"))


def by_key(data):
    groups = defaultdict(list)
    for row in data:
        groups[row[1]].append(row)
    return {k: sorted(v, key=lambda r: (r[2], r[0])) for k, v in groups.items()}


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("seconds", [60, 600])
def test_trailing_count(spark, closed, seconds):
    data, df = log(spark, 1)
    got = {r.event_id: r.trailing for r in trailing_count(df, "domain", seconds, closed, slots=3).collect()}
    assert len(got) == len(data)
    for i, key, sec, _ in data:
        low = sec - seconds if closed else sec - seconds + 1
        assert got[i] == sum(1 for r in data if r[1] == key and low <= r[2] <= sec)


def frame_starts(df):
    """Where the window frames of the plan start."""
    return set(re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("closed", [True, False])
def test_trailing_count_reads_no_window_anew(spark, closed):
    """Hundreds of rows in every window: a frame that slides would be summed up once a row."""
    data, df = log(spark, 11, n=1500, span=3000)
    out = trailing_count(df, "domain", 600, closed, slots=1)
    assert frame_starts(out) == {"unboundedpreceding$()"}
    got = {r.event_id: (r.domain, r.sec, r.success, r.trailing) for r in out.collect()}
    for i, key, sec, success in data:
        n = sum(1 for r in data if r[1] == key and sec - 600 + (not closed) <= r[2] <= sec)
        assert got[i] == (key, sec, success, n)


def test_violations_before_read_no_window_anew(spark):
    data, df = log(spark, 12, n=1500, span=9000)
    failed = df.filter("success")
    out = band_counts(df.select("event_id", "domain", "ts"), failed, "domain", {"a": 600, "b": 1800}, slots=1)
    assert frame_starts(out) == {"unboundedpreceding$()"}
    got = {r.event_id: (r.a, r.b) for r in out.collect()}
    for i, key, sec, _ in data:
        assert got[i] == tuple(sum(1 for r in data if r[3] and r[1] == key and sec - w < r[2] <= sec) for w in (600, 1800))


def test_cap_breaches_look_policies_up_before_the_count(spark):
    _, df = log(spark, 13)
    text = traffic.cap_breaches(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "linkedin.com" not in text[:text.index("Window")]


@pytest.mark.parametrize("bucket", [500, 100000])
def test_running_sum_max_min(spark, bucket):
    data, df = log(spark, 2)
    specs = {"s": ("sum", F.col("event_id")), "hi": ("max", F.col("event_id")), "lo": ("min", F.col("event_id"))}
    out = running(df, ["domain"], ["ts", "event_id"], time_bucket("ts", bucket), specs)
    before = running(df, ["domain"], ["ts", "event_id"], time_bucket("ts", bucket), specs, inclusive=False)
    got = {r.event_id: (r.s, r.hi, r.lo) for r in out.collect()}
    prev = {r.event_id: (r.s, r.hi, r.lo) for r in before.collect()}
    for rows in by_key(data).values():
        ids = []
        for r in rows:
            assert prev[r[0]] == ((sum(ids), max(ids), min(ids)) if ids else (0, None, None))
            ids.append(r[0])
            assert got[r[0]] == (sum(ids), max(ids), min(ids))


def test_attempt_numbers(spark):
    data, df = log(spark, 3)
    got = {r.event_id: r.attempt for r in traffic.attempt_no(df, bucket_seconds=700).collect()}
    want = {}
    for rows in by_key(data).values():
        n = 0
        for r in rows:
            n = 0 if r[3] else n + 1
            if not r[3]:
                want[r[0]] = n
    assert got == want
    capped = {r.event_id: r.attempt for r in traffic.attempt_no(df, bucket_seconds=700, cap=K.MAX_BACKOFF_ATTEMPTS).collect()}
    assert capped == {k: min(n, 5) for k, n in want.items()}


def test_active_never_below_zero(spark):
    data, df = log(spark, 4)
    steps = df.select("domain", "event_id", "ts", F.when(F.col("success"), F.lit(1)).otherwise(F.lit(-1)).alias("step"))
    got = {r.event_id: r.active for r in traffic.clamp_running(steps, 700).collect()}
    for rows in by_key(data).values():
        level = 0
        for r in sorted(rows, key=lambda r: (r[2], 0 if r[3] else 1, r[0])):
            level = max(0, level + (1 if r[3] else -1))
            assert got[r[0]] == level


def test_start_and_end_leave_nothing_open(spark):
    spans = spark.createDataFrame([(1, "d", 10, 20), (2, "d", None, 30)], "event_id bigint, domain string, a bigint, b bigint")
    spans = spans.select("event_id", "domain", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    assert [r.active for r in traffic.active_over_time(spans).orderBy("ts").collect()] == [1, 0, 0]


def fold(times, cooldown):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("seed,n,span", [(5, 300, 40000), (6, 600, 20000), (7, 40, 900000), (8, 1, 10)])
def test_cooldown_matches_the_fold(spark, seed, n, span):
    rnd = random.Random(seed)
    data = [(i, rnd.choice("ab"), rnd.choice(["warning", "critical"]), rnd.randrange(span) // rnd.choice([1, 1, 900]) * 1)
            for i in range(n)]
    df = spark.createDataFrame(data, "event_id bigint, channel string, severity string, sec bigint")
    out = alerts.suppress_cooldown(df.withColumn("ts", F.timestamp_seconds("sec")), 15).collect()
    got, want = defaultdict(list), defaultdict(list)
    for r in out:
        got[r.key].append(r.sec)
    groups = defaultdict(list)
    for _, c, s, t in data:
        groups[f"{c}:{s}"].append(t)
    for k, ts in groups.items():
        want[k] = fold(ts, 900)
    assert {k: sorted(v) for k, v in got.items()} == dict(want)


def test_exactly_one_cooldown_apart(spark):
    df = spark.createDataFrame([(1, 0), (2, 899), (3, 900), (4, 1799), (5, 1800)], "event_id bigint, sec bigint")
    df = df.select("event_id", F.lit("c").alias("channel"), F.lit("w").alias("severity"), F.timestamp_seconds("sec").alias("ts"))
    assert sorted(r.event_id for r in alerts.suppress_cooldown(df, 15).collect()) == [1, 3, 5]


def test_keep_first_and_last_n(spark):
    data, df = log(spark, 9)
    first = {r.domain: r.event_id for r in keep_first(df, ["domain"], ["ts", "event_id"]).collect()}
    assert first == {k: v[0][0] for k, v in by_key(data).items()}
    last = {r.event_id for r in last_n(df, 3, ["ts", "event_id"], ["domain"]).collect()}
    assert last == {r[0] for v in by_key(data).values() for r in v[-3:]}
    overall = sorted(data, key=lambda r: (r[2], r[0]))[-7:]
    assert {r.event_id for r in last_n(df, 7, ["ts", "event_id"]).collect()} == {r[0] for r in overall}
