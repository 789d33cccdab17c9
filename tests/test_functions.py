"""Column functions on hand-made edge rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from postlake.functions import hashing, scalars, text, urls


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [
    ("Sr. Software Engineer (Remote) - Full Time", "software engineer"),
    ("Senior  Data Analyst ", "data analyst"),
    ("trailing sr", "trailing sr"),
    ("Intern Trainee", ""),
    ("Entry-Level Developer", "developer"),
    ("Seniority matters", "seniority matters"),
    ("", ""),
])
def test_normalize_title(spark, raw, want):
    assert one(spark, raw, text.normalize_title) == want


@pytest.mark.parametrize("raw,want", [
    ("Infosys Limited", "infosys"),
    ("Google India Pvt. Ltd.", "google"),
    ("inca foods inc", "foods"),
    ("Acme Technologies Global Services", "acme"),
])
def test_normalize_company(spark, raw, want):
    assert one(spark, raw, text.normalize_company) == want


@pytest.mark.parametrize("raw,city_only,want", [
    ("Bengaluru", False, "bangalore"),
    ("Bengaluru, Karnataka", False, "bengaluru karnataka"),
    ("Bengaluru, Karnataka", True, "bangalore"),
    ("New Delhi", False, "delhi"),
    ("Pune", False, "pune"),
])
def test_normalize_location(spark, raw, city_only, want):
    assert one(spark, raw, lambda c: text.normalize_location(c, city_only)) == want


@pytest.mark.parametrize("raw,want", [
    ("https://A.com/Job/1?UTM_Source=x&id=7#top", "https://a.com/job/1?id=7"),
    ("https://a.com/job/1/#only", "https://a.com/job/1"),
    ("https://a.com", "https://a.com/"),
    ("https://a.com/", "https://a.com/"),
    ("http://a.com:80/x//", "http://a.com/x"),
    ("https://a.com:443?ref=1", "https://a.com/"),
    ("https://a.com:8080/x?b=2&ref=1&&c=3", "https://a.com:8080/x?b=2&c=3"),
    ("https://a.com/x?b=2&&c=3", "https://a.com/x?b=2&&c=3"),
    ("https://a.com/x?", "https://a.com/x?"),
    (" Not A Url ", "not a url"),
])
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, urls.canonical_url) == want


def test_source_fingerprint(spark):
    row = spark.createDataFrame(
        [("Indeed  RSS", "https://X.com/Job/AB-1/?utm=test#t", None), ("a", "https://x.com/v?jk=K%201&id=", None),
         ("a", "nope", None), ("a", "https://x.com/v", " P9 ")], "s string, u string, p string"
    ).select(urls.source_fingerprint("s", "u", "p").alias("f")).collect()
    assert [r.f for r in row] == [
        "indeed-rss::https://x.com/job/ab-1::ab-1", "a::https://x.com/v::k 1", "a::nope::", "a::https://x.com/v::p9",
    ]


@pytest.mark.parametrize("raw,want", [
    ("https://www.Indeed.com/x", "indeed.com"), ("www.naukri.com", "naukri.com"), ("custom.example.com", "custom.example.com"),
    ("httpfoo.com", "httpfoo.com"), ("https://u:p@h.example.com:99/x", "h.example.com"),
])
def test_domain(spark, raw, want):
    assert one(spark, raw, urls.domain_of) == want


@pytest.mark.parametrize("raw,want", [
    ("urn:li:jobPosting:3812345678", "3812345678"), ("/jobs/view/55/?x", "55"), (" 12345678 ", "12345678"), ("1234567", None),
])
def test_numeric_job_id(spark, raw, want):
    assert one(spark, raw, urls.numeric_job_id) == want


def test_hashes(spark):
    df = spark.createDataFrame([("https://a.com/x", "Dev", "Acme", "Great job", None)],
                               "url string, title string, company string, description string, location string")
    row = hashing.with_fingerprints(df).withColumn("fp", hashing.row_fingerprint()).first()
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert row.url_hash == h("https://a.com/x")[:16]
    assert row.content_hash == h("https://a.com/x::dev")[:16]
    assert row.desc_hash == h("great job")[:16]
    assert row.fp == h("https://a.com/x||Dev||Acme")
    with pytest.raises(ValueError):
        hashing.with_fingerprints(df, "nope")


def test_blanks_beyond_ascii(spark):
    assert one(spark, " <b>a</b> 　b﻿ ", text.strip_tags) == "a b"
    assert one(spark, " x ", text.ws_trim) == "x"


def test_page_text_keeps_whole_text(spark):
    html = "<nav>menu</nav><SCRIPT>var a='<p>';</SCRIPT><p>one</p><img src=x>two" + " word" * 5000
    out = one(spark, html, text.page_text)
    assert out.startswith("one two word") and out.count("word") == 5000


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (102656, "100.3 KB"), (1048576, "1.00 MB")])
def test_human_size(spark, n, want):
    assert one(spark, n, scalars.human_size, "bigint") == want


def test_latency_and_backoff(spark):
    df = spark.createDataFrame([(1000, 1035), (None, 2000), (0, 5), (10, 5)], "s bigint, e bigint")
    assert [r[0] for r in df.select(scalars.latency_ms("s", "e")).collect()] == [35.0, None, None, None]
    b = spark.createDataFrame([(1, 1.0, 300000), (3, 2.0, 300000), (9, 3.0, 600000)], "a int, m double, x bigint")
    assert [r[0] for r in b.select(scalars.backoff_ms("a", "m", "x")).collect()] == [30000, 120000, 600000]


@pytest.mark.parametrize("raw,want", [
    ("Engineer at Acme | Site", "Acme"), ("Acme", "Acme"), ("Dev AT  Big Co", "Big Co"),
])
def test_title_company(spark, raw, want):
    assert one(spark, raw, text.title_company) == want
