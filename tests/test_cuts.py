"""Texts are whole by default; the cuts of the collected system are arguments."""

import time

import pytest
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions import text
from postlake.operators import listings
from postlake.sources import apis, feeds
from postlake.sources import pages as P

LONG = "word " * 2000 + "end"


def one(df, column):
    return df.select(column).collect()[0][0]


@pytest.mark.parametrize("dialect", feeds.DIALECTS)
def test_feed_descriptions(spark, dialect):
    body = f"<rss><channel><item><title>t</title><link>https://a/b</link><description>{LONG}</description></item></channel></rss>"
    df = spark.createDataFrame([(body,)], "body string")
    assert one(feeds.rss_items(df, dialect), "description") == LONG
    cut = one(feeds.rss_items(df, dialect, max_chars=K.DESCRIPTION_MAX_CHARS), "description")
    assert cut.strip() == LONG[:5000].strip()


def test_api_descriptions(spark):
    board = spark.createDataFrame([('{"data":[{"title":"t","jobId":"1","jobDescription":"%s"}]}' % LONG,)], "body string")
    assert one(apis.api_board(board), "description") == LONG
    assert one(apis.api_board(board, max_chars=K.DESCRIPTION_MAX_CHARS), "description") == LONG[:5000]
    some = spark.createDataFrame(
        [('{"data":[{"job_title":"t","job_apply_link":"u","job_description":"%s"}]}' % LONG,)], "body string")
    assert one(apis.api_aggregator(some), "description") == LONG
    assert one(apis.api_aggregator(some, max_chars=K.DESCRIPTION_MAX_CHARS), "description") == LONG[:5000]


def test_jsonld_description(spark):
    block = '{"@type":"JobPosting","title":"t","description":"%s"}' % LONG
    df = spark.createDataFrame([("u", f'<script type="application/ld+json">{block}</script>')], "url string, html string")
    assert one(P.jsonld_postings(df), "description") == LONG
    assert one(P.jsonld_postings(df, max_chars=K.DESCRIPTION_MAX_CHARS), "description") == LONG[:5000]


def test_equal_openings_are_different_texts(spark):
    df = spark.createDataFrame([("x " * 400 + "a",), ("x " * 400 + "b",)], "d string")
    whole = {r[0] for r in df.select(text.normalize_description("d")).collect()}
    opening = {r[0] for r in df.select(text.normalize_description("d", K.DESCRIPTION_HASH_CHARS)).collect()}
    assert len(whole) == 2 and len(opening) == 1


def test_block_phrase_anywhere_in_the_body(spark):
    html = "<header>menu</header><p>" + "filler " * 1000 + "access denied</p>"
    df = spark.createDataFrame(
        [(1, "u", "x", html), (2, "u", "x", "<header>Access denied</header>"), (3, "u", "x", "<script>captcha</script>ok")],
        "page_id int, url string, site string, html string")
    assert [r.blocked for r in P.classify_blocked(df).orderBy("page_id").collect()] == [True, True, False]
    body = text.visible_body("html")
    head = df.select(P.is_blocked_page(F.lit(""), body, K.BLOCK_BODY_CHARS).alias("b")).collect()
    assert [r.b for r in head] == [False, True, False]


def test_content_gate_caps_are_asked_for(spark):
    df = spark.createDataFrame([("anthropic", "<p>" + "w " * 5000 + "</p>"), ("anthropic", "<p>short</p>")], "provider string, html string")
    assert sorted(len(r.content) for r in P.content_gate(df).collect()) == [5, 9999]
    kept = P.content_gate(df, capped=True, min_html=K.MIN_BODY_CHARS, min_text=K.MIN_CLEAN_CHARS).collect()
    assert [len(r.content) for r in kept] == [K.LOW_CAP]


def test_result_limit_is_asked_for(spark):
    df = spark.range(80).select(F.lit("s").alias("source"), "id")
    assert listings.limit_results(df, ["source"], ["id"]).count() == 80
    assert listings.limit_results(df, ["source"], ["id"], K.DEFAULT_MAX_RESULTS).count() == 50


@pytest.mark.parametrize("part", ["<nav ", "<nav>", "</nav>", "<title>", "<", "<script"])
def test_time_of_page_rules_grows_with_the_page(spark, part):
    def seconds(size):
        df = spark.createDataFrame([(part * (size // len(part)),)], "html string")
        started = time.time()
        df.select(text.page_text("html"), text.visible_body("html"), text.page_title("html")).collect()
        return time.time() - started

    seconds(1000)
    assert seconds(400_000) < max(12 * seconds(100_000), 3.0)
