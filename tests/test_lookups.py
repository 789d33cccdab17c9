"""Policies as a table, counts in a band of time, and the search index, against plain Python."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.operators import listings, search_index, traffic
from postlake.operators.running import band_counts


def test_policy_table_equals_the_constant_one(spark):
    names = ["linkedin.com", "in.linkedin.com", "notlinkedin.com", "www.indeed.com", "INDEED.com", "x.org", "", None, "m", "m"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "domain string, i int")
    table = spark.createDataFrame(
        [(i, p[0], p[1]) for i, p in enumerate(K.RATE_POLICIES, start=1)], "ordinal int, domain string, max_rpm int"
    )
    got = {r.i: (r.policy_ordinal, r.max_rpm) for r in traffic.match_policies(df, table).collect()}
    n = len(K.RATE_POLICIES)
    want = {r.i: (r.policy_ordinal, r.max_rpm) if r.policy_ordinal and r.policy_ordinal <= n else (None, None)
            for r in traffic.with_policy(df).collect()}
    assert got == want and len(got) == len(names)


def test_policies_with_odd_rows(spark):
    df = spark.createDataFrame([("a.b.com",), ("b.com",)], "domain string")
    table = spark.createDataFrame(
        [(3, "b.com", 3), (2, "", 2), (None, "a.b.com", 1), (5, "b.com", 5), (4, ".com", 4), (9, None, 9)],
        "ordinal int, domain string, max_rpm int",
    )
    got = {r.domain: (r.policy_ordinal, r.policy_domain) for r in traffic.match_policies(df, table).collect()}
    assert got == {"a.b.com": (3, "b.com"), "b.com": (3, "b.com")}
    assert traffic.match_policies(df, table.limit(0)).filter("policy_ordinal IS NULL").count() == 2


def test_policies_meet_endings_in_equi_joins(spark):
    df = spark.range(10).select(F.concat(F.lit("h"), "id").alias("domain"))
    plan = traffic.match_policies(df, df.select(F.lit(1).alias("ordinal"), "domain"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and plan.count("Join") == 2


def _log(rng, n):
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(i, rng.choice(keys), rng.choice([None, *([rng.randrange(0, 20000)] * 9)])) for i in range(n)]


def test_band_counts_are_exact(spark):
    rng = random.Random(3)
    moments, events = _log(rng, 600), _log(rng, 900)
    moments += [(9000, "edge", 7200), (9001, "edge", 7201), (9002, "edge", 6600)]
    events += [(9003, "edge", 6600), (9004, "edge", 6600)]
    def frame(rows):
        return spark.createDataFrame(rows, "event_id long, domain string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    out = {r.event_id: (r.violations_10m, r.violations_30m) for r in traffic.violations_before(frame(moments), frame(events)).collect()}
    met = [(d, s) for _, d, s in events if d is not None and s is not None]

    def count(d, s, width):
        return sum(e == d and s - width < t <= s for e, t in met) if d is not None and s is not None else 0
    assert {k: tuple(x or 0 for x in v) for k, v in out.items()} == {i: (count(d, s, 600), count(d, s, 1800)) for i, d, s in moments}
    assert None not in {x for v in out.values() for x in v}


def test_a_hot_domain_is_counted_in_slots(spark):
    df = spark.createDataFrame([(1, "a")], "event_id long, domain string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    plan = band_counts(df, df, "domain", {"n": 600})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "_slot" in plan.split("hashpartitioning(_key", 1)[1].split("\n", 1)[0]


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["common"] * 40
    data = [(i, " ".join(rng.choices(words, k=6)), rng.choice(["Acme, Inc.", "ACME", None, ""])) for i in range(400)]
    df = spark.createDataFrame([*data, (400, None, None), (None, "common w1", "x")], "seq long, title string, company string")
    path = tempfile.mkdtemp(prefix="postlake-test-") + "/index"
    search_index.append(df.filter("seq < 150"), path, "seq", buckets=8)
    search_index.append(df.filter("seq >= 150 OR seq IS NULL"), path, "seq", buckets=8)
    search_index.append(df.filter("seq = 7"), path, "seq", buckets=8)  # a repeated load
    return df, path


@pytest.mark.parametrize("terms", ["common", "Common w3", "w1 common acme", "inc w5 w5", "nowhere", "common nowhere", "a.b"])
def test_the_index_answers_as_the_scan_does(spark, indexed, terms):
    df, path = indexed
    got = sorted(r.id for r in search_index.search(spark, path, terms, buckets=8).collect())
    assert got == sorted(r.seq for r in listings.search(df.filter("seq IS NOT NULL"), terms).collect())


def test_no_terms_and_no_index_give_nothing(spark, indexed):
    assert search_index.search(spark, indexed[1], "  ", buckets=8).count() == 0
    assert search_index.search(spark, indexed[1] + "-absent", "common").count() == 0


def test_the_index_reads_only_the_words_partitions(spark, indexed):
    plan = search_index.search(spark, indexed[1], "common w3", buckets=8)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(bucket" in x and "EqualTo(word," in x for x in scans)
