"""Deduplication, validation and storing."""

import tempfile

import pytest
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.hashing import with_fingerprints
from postlake.functions.urls import source_fingerprint
from postlake.operators import dedup, listings, store
from postlake.plans import jobs
from postlake.sources import tables

AS_OF = "2024-06-01 00:00:00"
COLS = "seq bigint, url string, title string, company string, description string, source string, location string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), COLS)


def seen_of(df, stored_at=AS_OF):
    return df.select("url_hash", "content_hash", "desc_hash", F.lit(stored_at).cast("timestamp").alias("stored_at"))


JOB = (1, "https://a.com/j/1", "Dev", "Acme", "Build nice things", "x", "Pune")


def test_new_then_stored_then_copy_then_other_url(spark):
    job = with_fingerprints(rows(spark, JOB))
    empty = seen_of(job).limit(0)
    verdict = lambda b, s: [r.verdict for r in dedup.dedup_verdict(b, s, AS_OF).collect()]
    assert verdict(job, empty) == ["none"]
    seen = dedup.mark_seen(empty, seen_of(job))
    assert verdict(job, seen) == ["url"]
    other = with_fingerprints(rows(spark, (2, "https://a.com/j/2", *JOB[2:])))
    assert verdict(other, seen) == ["none"]


@pytest.mark.parametrize("age_days,text,want", [
    (1, "Build nice things", "content"), (30, "Build nice things", "content"),
    (6, "Something else now", "content"), (7, "Something else now", "none"), (8, "Something else now", "none"),
])
def test_content_rule_of_the_cross_board_key(spark, age_days, text, want):
    mode = "title_company_location"
    seen = seen_of(with_fingerprints(rows(spark, JOB), mode)).withColumn(
        "stored_at", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=F.lit(age_days))
    )
    other = with_fingerprints(rows(spark, (2, "https://b.com/9", "Sr Dev", "ACME Ltd", text, "y", "Pune, MH")), mode)
    assert dedup.dedup_verdict(other, seen, AS_OF).first().verdict == want


def test_any_history_hit_wins(spark):
    """One old entry with other text and one with the same text: duplicate."""
    mode = "title_company_location"
    history = with_fingerprints(rows(
        spark, JOB, (2, "https://a.com/j/2", "Dev", "Acme", "other words here", "x", "Pune")), mode)
    seen = seen_of(history, "2024-01-01 00:00:00")
    again = with_fingerprints(rows(spark, (3, "https://c.com/1", *JOB[2:])), mode)
    assert dedup.dedup_verdict(again, seen, AS_OF).first().verdict == "content"


def test_source_dedup_with_planted_copies(spark):
    base = [("job %d " % i, "Src", f"https://x.com/job/{i}", None) for i in range(300)]
    copies = [(t.upper(), "SRC", u + "#tracking", None) for t, _, u, _ in base[:200]]
    data = [(i, *r) for i, r in enumerate(base + copies)]
    df = spark.createDataFrame(data, "seq int, title string, source string, url string, pid string").withColumn(
        "source_fp", source_fingerprint("source", "url", "pid"))
    stats = listings.source_dedup_stats(df).first()
    assert (stats.lookups, stats.unique_jobs, stats.duplicates, stats.hit_ratio) == (500, 300, 200, 0.4)
    kept = listings.dedup_by_source(df, ["seq"])
    assert kept.count() == 300 and kept.agg(F.max("seq")).first()[0] == 299
    assert listings.dedup_by_source(df, ["seq"], known=df).count() == 0


def test_validate_reasons(spark):
    df = spark.createDataFrame(
        [("https://a.com/1", "ok", "long enough text", None), ("bare", "x", "short", ""), ("https:///x", None, None, "c")],
        "url string, title string, description string, company string")
    valid, rejected = listings.validate(df.withColumn("scraped_at", F.lit(AS_OF).cast("timestamp")))
    assert [(r.company, r.title) for r in valid.collect()] == [("Unknown Company", "ok")]
    assert sorted(r.reasons for r in rejected.collect()) == [["url", "title", "description"]] * 2


def test_keyword_empty_token_keeps_all(spark):
    df = spark.createDataFrame([("a", "b"), ("java dev", "x")], "title string, description string")
    assert listings.keyword_any(df, "java").count() == 1
    assert listings.keyword_any(df, "java ").count() == 2
    assert listings.keyword_any(df, "").count() == 2
    assert listings.keyword_any(df, F.lit("JAVA zz")).count() == 1


def test_seen_prune_is_strict(spark):
    df = spark.createDataFrame([("a", "2024-05-02 00:00:00"), ("b", "2024-05-01 23:59:59")], "url_hash string, t string")
    assert [r.url_hash for r in dedup.prune_seen(df.withColumn("stored_at", F.to_timestamp("t")), AS_OF).collect()] == ["a"]


def batch_rows(spark):
    return rows(
        spark, JOB, (2, "https://a.com/j/1?utm_source=z", *JOB[2:]), (3, "nope", *JOB[2:]),
        (4, "https://a.com/j/4", "Ops", "Acme", "Run nice things", "y", None),
    )


def test_ingest_twice_stores_nothing_new(spark):
    target = tempfile.mkdtemp(prefix="postlake-jobs-") + "/jobs"
    seen = seen_of(with_fingerprints(rows(spark, JOB))).limit(0)
    first = jobs.ingest(batch_rows(spark), seen, target, AS_OF, ["seq"])
    assert {(r.seq, r.outcome) for r in first["results"].collect()} == {
        (1, "stored"), (2, "duplicate"), (3, "invalid"), (4, "stored")}
    assert first["inserted"].count() == 2
    again = jobs.ingest(batch_rows(spark), first["seen"], target, AS_OF, ["seq"])
    assert again["inserted"].count() == 0 and store.read_jobs(spark, target).count() == 2
    # Without the seen store the fingerprint alone still stops the rows.
    forgot = jobs.ingest(batch_rows(spark), seen, target, AS_OF, ["seq"])
    counts = forgot["counts"].first()
    assert (counts.offered, counts.inserted, counts.conflict_skipped) == (2, 0, 2)


def test_in_batch_switch(spark):
    seen = seen_of(with_fingerprints(rows(spark, JOB))).limit(0)
    out = jobs.ingest_outcomes(batch_rows(spark), seen, AS_OF, ["seq"], in_batch=False)
    assert out.filter("outcome = 'stored'").count() == 3


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_partition_count_does_not_matter(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        seen = seen_of(with_fingerprints(rows(spark, JOB))).limit(0)
        out = jobs.ingest_outcomes(batch_rows(spark).repartition(5), seen, AS_OF, ["seq"])
        assert sorted(r.seq for r in out.filter("outcome = 'stored'").collect()) == [1, 4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_registered_source(spark):
    tables.register_source("mine", lambda p: p.select(
        F.col("body").alias("title"), F.lit("c").alias("company"), F.lit("d").alias("description"), F.lit("u").alias("url")))
    out = tables.run_source("mine", spark.createDataFrame([("t",)], "body string")).first()
    assert (out.title, out.source, out.location) == ("t", "mine", None)
    assert "mine" in tables.registered_sources()
    with pytest.raises(ValueError):
        tables.register_source("mine", lambda p: p)


def test_history_is_hashed_once_for_both_content_lookups(spark):
    """The pairs of content and text feed the lookup by pair and the one by content through one shuffle."""
    rows = [("u1", "c1", "d1", 3), ("u2", "c1", "d2", 20), ("u3", "c2", "d1", None)]
    seen = spark.createDataFrame(rows, "url_hash string, content_hash string, desc_hash string, days int").select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("url_hash", "content_hash", "desc_hash")], (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=F.col("days"))).alias("stored_at"))
    batch = spark.createDataFrame(
        [(1, "u1", "x", "x"), (2, "n", "c1", "d9"), (3, "n", "c2", "d1"), (4, "n", "c2", "d9"), (5, "n", "x", "d1")],
        "seq int, url_hash string, content_hash string, desc_hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup.dedup_verdict(batch, seen, AS_OF)
        assert {r.seq: r.verdict for r in out.collect()} == {1: "url", 2: "content", 3: "content", 4: "none", 5: "none"}
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phrases_that_share_no_word_go_in_one_pass(spark):
    from postlake.functions.text import _passes, normalize_company, normalize_title

    assert len(_passes(K.TITLE_NOISE)) == 5 and len(_passes(["a b", "b c", "d"])) == 2
    texts = ["Senior Data Engineer (Remote) full-time", "mid level level entry", "immediate joiner immediate joining", "sr sr x srx jr. y",
             "Acme Private Limited limited pvt. ltd", "contractual contract contracts", "a remote b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_title("t").alias("a"), normalize_company("t").alias("b"))
    # as one pass a phrase, longest first, left them
    assert [r.a for r in df.collect()] == ["data engineer", "level entry", "", "x y", "acme private limited limited pvt ltd", "contracts", "a b", ""]
    assert df.collect()[4].b == "acme"


def test_accepted_rows_are_worked_out_once(spark):
    """What the seen store takes in is read back, not judged a second time."""
    seen = seen_of(with_fingerprints(batch_rows(spark).limit(0)))
    done = jobs.ingest(batch_rows(spark), seen, tempfile.mkdtemp() + "/jobs", AS_OF, ["seq"])
    text = done["stored"]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in text and "Join" not in text
    assert done["stored"].count() == done["inserted"].count() > 0


def test_base_texts_of_offered_and_stored_rows_are_worked_out_once(spark):
    """A title's base text stands in the plan once a row, not once for each mention in the rule and its conditions."""
    df = rows(spark, JOB).select("title", "url", "company", "description").withColumn("seq", F.monotonically_increasing_id())
    out = with_fingerprints(df).select("seq", "url_hash", "content_hash", "desc_hash")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(coalesce(title#") == 1 and plan.count("lower(coalesce(description#") == 1


def test_the_test_for_phrases_misses_none(spark):
    """Titles of noise words and their neighbours, with every pass against the rule behind its test."""
    import itertools
    from functools import reduce as fold

    from postlake.functions import text

    for phrases, rule in ((K.TITLE_NOISE, text.normalize_title), (K.COMPANY_NOISE, text.normalize_company)):
        words = sorted({w for p in phrases for w in p.strip("()").replace(".", " ").replace("-", " ").split()}) + ["x", "srx", "incas", "pvt."]
        texts = [" ".join(w) for n in (1, 2) for w in itertools.product(words, repeat=n)] + [f"a{w} {w}b" for w in words] + ["", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        passes = fold(lambda acc, p: F.regexp_replace(acc, p, " "), text._passes(phrases), text.base_text("t"))
        always = F.trim(F.regexp_replace(passes, " {2,}", " "))
        assert df.filter(~rule("t").eqNullSafe(always)).collect() == []


def test_base_text_leaves_single_blanks_alone(spark):
    import re

    from postlake.functions import text

    assert len(re.findall(text.NOT_WORDS, "one two three, four  five six")) == 2
    texts = ["", " ", "a", " a", "a ", " a b ", "a  b", "a - b", "a. b", "a .b", "é a", "a é b", "É", "a\tb\n c", "İx K y", "a_b 1 2", "\u00a0a \u00a0b", "😀 a 😀b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.trim(F.regexp_replace(F.lower("t"), r"\W+", " "))
    assert df.filter(~text.base_text("t").eqNullSafe(plain)).collect() == []
