"""Sinks, archives and streams over several micro-batches."""

import datetime
import json
import math
import os
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlake.functions.hashing import with_fingerprints
from postlake.operators import alerts, dedup, lifecycle, metrics, traffic
from postlake.operators.listings import stamp, with_run_context
from postlake.operators.seen_store import SeenStore
from postlake.operators.store import held_prefixes, read_jobs, to_stored, touched, upsert_jobs
from postlake.session import scratch_path
from postlake.sources import tables
from postlake.streaming import streams


def fresh_dir():
    return tempfile.mkdtemp(prefix="postlake-test-")


# --- storage --------------------------------------------------------------------------

def test_dataset_shards_and_csv(spark):
    path = fresh_dir()
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b,\"q\"", "2024-01-02 10:00:00")], "title string, t string")
    df = df.withColumn("scraped_at", F.to_timestamp("t")).drop("t")
    tables.write_dataset(df.coalesce(1), path + "/d", fmt="json")
    tables.write_dataset(df.coalesce(1), path + "/d", fmt="json")
    assert sorted(os.listdir(path + "/d"))[-2:] == ["scraped_date=2024-01-01", "scraped_date=2024-01-02"]
    shards = tables.scan_shards(spark, path + "/d/*/*.json").collect()
    assert len(shards) == 4 and sum(r.record_count for r in shards) == 4 and all(r.size_bytes > 0 for r in shards)
    tables.export_csv(df, path + "/c")
    back = spark.read.option("header", True).option("escape", '"').csv(path + "/c")
    assert sorted(r.title for r in back.collect()) == ["a", 'b,"q"']


def test_run_log(spark):
    path = fresh_dir() + "/log.jsonl"
    with open(path, "w") as f:
        f.write(json.dumps({"timestamp": "2024-01-01T00:00:01Z", "level": "info", "message": "m", "runId": "r", "jobs": 3}) + "\n")
        f.write("half a line {\n")
    row = tables.read_run_log(spark, path).select(
        "*", F.try_variant_get(F.col("extra")["jobs"], "$", "int").alias("jobs")).collect()
    assert [(r.level, r.message, r.run_id, r.jobs, r.ts.second) for r in row] == [("info", "m", "r", 3, 1)]


def test_archive_dry_run_and_real_agree(spark):
    root = fresh_dir()
    hot = spark.createDataFrame([(i, f"2024-01-{i:02d} 00:00:00") for i in range(1, 11)], "id int, t string")
    hot = hot.withColumn("scraped_at", F.to_timestamp("t")).drop("t")
    dry = lifecycle.archive(hot, root + "/a", "2024-01-11 00:00:00", days=7, dry_run=True)
    assert (dry["archived"], dry["kept"], dry["hot_path"]) == (4, 6, None) and not os.path.exists(root + "/a")
    real = lifecycle.archive(hot, root + "/a", "2024-01-11 00:00:00", days=7)
    assert (real["archived"], real["kept"]) == (4, 6)
    assert spark.read.parquet(real["hot_path"]).count() == 6
    back = spark.read.json(root + "/a")
    assert back.count() == 4 and {"year", "month", "day"} <= set(back.columns)
    assert all(f.endswith(".gz") for _, _, fs in os.walk(root + "/a") for f in fs if f.startswith("part-"))


@pytest.mark.parametrize("guard,want", [(False, {"new": "keep", "old": "delete", "late": "delete"}),
                                        (True, {"new": "keep", "old": "delete", "late": "not_uploaded"})])
def test_cleanup_uses_rounded_age(spark, guard, want):
    arch = spark.createDataFrame(
        [("new", 5, "2024-01-02 02:00:00"), ("old", 6, "2023-12-01 00:00:00"), ("late", 7, "2024-01-01 01:00:00")],
        "archive_path string, size_bytes bigint, t string").withColumn("mtime", F.to_timestamp("t"))
    mani = spark.createDataFrame([("old", 3, "2024-01-01 00:00:00")], "archive_path string, total_records bigint, u string")
    mani = mani.withColumn("uploaded_at", F.to_timestamp("u"))
    # "late" is 89.96 days old, which rounds to 90.0.
    plan = lifecycle.cleanup_plan(arch, mani, "2024-03-31 00:00:00", guard=guard)
    assert {r.archive_path: r.action for r in plan.collect()} == want
    assert [r.archive_path for r in lifecycle.oldest_first(plan).collect()] == ["old", "late", "new"]


# --- streams ---------------------------------------------------------------------------

def as_stream(spark, parts, schema):
    """A file stream with one micro-batch per part, in order."""
    path = fresh_dir()
    for i, part in enumerate(parts):
        tmp = f"{path}/tmp-{i}"
        part.coalesce(1).write.parquet(tmp)
        (name,) = [f for f in os.listdir(tmp) if f.endswith(".parquet")]
        os.utime(f"{tmp}/{name}", (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/tmp-*")


def split(df, n, order="event_id"):
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // n)
    return [df.sparkSession.createDataFrame(rows[i:i + size], df.schema) for i in range(0, len(rows), size)]


def request_log(spark, n=120):
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 97 + 1_000_000).alias("ts"),
        F.when(F.col("id") % 3 == 0, F.lit("b")).otherwise(F.lit("hot")).alias("domain"),
        (F.hash("id") % 4 == 0).alias("success"))
    return df


def closed(spark, df, batches, delay):
    """A finished input: its parts and the row that ends it."""
    parts = split(df, batches) if isinstance(batches, int) else batches
    return as_stream(spark, [*parts, streams.end_of_input(df, delay)], df.schema)


@pytest.mark.parametrize("batches", [1, 4])
def test_attempts_continue_over_batches(spark, batches):
    df = request_log(spark)
    stream = streams.attempts(closed(spark, df, batches, "5 minutes"), delay="5 minutes")
    got = {r.event_id: r.attempt for r in streams.run_to_table(spark, stream, "t4").collect()}
    assert got == {r.event_id: r.attempt for r in traffic.attempt_no(df).collect()}


@pytest.mark.parametrize("batches", [1, 5])
def test_cooldown_continues_over_batches(spark, batches):
    df = request_log(spark, 200).select(
        "event_id", "ts", F.col("domain").alias("channel"), F.lit("warning").alias("severity"))
    stream = streams.cooldown(closed(spark, df, batches, "5 minutes"), delay="5 minutes")
    got = {r.event_id for r in streams.run_to_table(spark, stream, "t5").collect()}
    assert got == {r.event_id for r in alerts.suppress_cooldown(df).collect()}


def at_seconds(spark, times):
    return spark.createDataFrame([(k, t, "d", False) for k, t in enumerate(times)], "event_id bigint, sec bigint, domain string, success boolean").select(
        "event_id", F.timestamp_seconds(F.col("sec") + 1_000_000).alias("ts"), "domain", "success")


@pytest.mark.parametrize("dealt", [[[0, 50, 30], [200, 150], [400], [10, 390]], [[0], [50], [30], [200], [150], [400], [390], [10]]])
def test_late_rows_take_their_place_or_go(spark, dealt):
    """Rows inside the delay are numbered in their place, whatever part they come in; the row behind the watermark is left out."""
    times = [t for part in dealt for t in part]
    df = at_seconds(spark, times)
    ids = iter(range(len(times)))
    parts = [df.filter(F.col("event_id").isin([next(ids) for _ in part])) for part in dealt]
    stream = streams.attempts(closed(spark, df, parts, "100 seconds"), delay="100 seconds")
    got = {int(r.ts.timestamp()) - 1_000_000: r.attempt for r in streams.run_to_table(spark, stream, "late").collect()}
    want = sorted(t for t in times if t != 10)
    assert got == {t: k for k, t in enumerate(want, start=1)}


def test_a_late_alert_never_moves_the_cooldown_back(spark):
    """A late alert of minute 90 after those of 100 and 104: inside the delay it goes out first, behind the watermark not at all."""
    df = spark.createDataFrame([(k, m * 60, "chat", "warning") for k, m in enumerate([100, 104, 90, 106, 116])],
                               "event_id bigint, sec bigint, channel string, severity string")
    df = df.select("event_id", F.timestamp_seconds("sec").alias("ts"), "channel", "severity")
    parts = [df.filter(F.col("event_id") == k) for k in range(5)]
    for delay, want in (("1 hour", [2, 3]), ("1 minute", [0, 4])):
        stream = streams.cooldown(closed(spark, df, parts, delay), delay=delay)
        assert sorted(r.event_id for r in streams.run_to_table(spark, stream, "late").collect()) == want


def seen_rows(spark, ids, at):
    df = spark.createDataFrame([(i,) for i in ids], "i int").select(
        F.sha2(F.col("i").cast("string"), 256).alias("url_hash"), F.sha2(F.concat(F.lit("c"), "i"), 256).alias("content_hash"),
        F.lit("d").alias("desc_hash"))
    return df.withColumn("stored_at", F.lit(at).cast("timestamp"))


def test_seen_store_shows_a_batch_what_came_before_it(spark):
    seen = SeenStore(spark, fresh_dir() + "/s")
    assert seen.rows().count() == 0
    for epoch, day in enumerate(["2024-01-01", "2024-01-02", "2024-02-15"]):
        seen.add(seen_rows(spark, range(10 * epoch, 10 * epoch + 10), f"{day} 00:00:00"), epoch)
    seen.add(seen_rows(spark, range(20, 30), "2024-02-15 00:00:00"), 2)  # a replay
    batch = seen_rows(spark, range(30), "2024-01-03 00:00:00")
    for epoch, now, want in ((0, "2024-01-03", 0), (1, "2024-01-03", 10), (2, "2024-01-03", 20), (3, "2024-02-01", 29 - 9)):
        by_url, by_content = seen.lookups(batch, epoch, f"{now} 00:00:00")
        assert by_url.distinct().count() == want == by_content.distinct().count()
    assert seen.rows().count() == 30 and seen.rows("2024-02-15 00:00:00").count() == 10
    seen.expire("2024-02-01 00:00:00")
    assert seen.rows().count() == 20


def test_a_batch_reads_and_writes_what_it_touches(spark):
    path = fresh_dir() + "/s"
    seen = SeenStore(spark, path, chars=2)

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    written = []
    for epoch in range(4):
        before = size()
        seen.add(seen_rows(spark, range(40 * epoch, 40 * epoch + 40), "2024-01-01 00:00:00"), epoch)
        written.append(size() - before)
    assert max(written) < 1.5 * min(written)
    batch = seen_rows(spark, [5, 500], "2024-01-02 00:00:00")
    for lookup in seen.lookups(batch, 9, "2024-01-02 00:00:00"):
        plan = lookup._jdf.queryExecution().executedPlan().toString()
        assert "prefix" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert 1 <= lookup.count() < 12  # of 160


def test_insert_reads_only_touched_prefixes(spark):
    target, rows = fresh_dir() + "/jobs", [(i, f"https://a.com/{i}", f"T{i}", "Acme", "A long description", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "seq int, url string, title string, company string, description string, source string")
    offered = to_stored(stamp(df, "2024-01-01 00:00:00"), "2024-01-01 00:00:00")
    assert upsert_jobs(offered.filter("seq < 40"), target, ["seq"], chars=2).count() == 40
    assert upsert_jobs(offered, target, ["seq"], chars=2).count() == 20
    assert upsert_jobs(offered, target, ["seq"], chars=2).count() == 0 and read_jobs(spark, target).count() == 60
    assert "prefix" not in read_jobs(spark, target).columns
    few = held_prefixes(offered.filter("seq = 1"), "fingerprint", 2)
    plan = touched(spark.read.parquet(target), "prefix", few)._jdf.queryExecution().executedPlan().toString()
    assert len(few) == 1 and "prefix" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


@pytest.mark.parametrize("batches", [1, 3])
def test_rolling_metrics_stream_equals_batch(spark, batches):
    events = request_log(spark, 300).select(
        "event_id", "ts", F.when(F.col("event_id") % 7 == 0, F.lit("extracted")).when(F.col("event_id") % 7 == 1, F.lit("deduplicated"))
        .when(F.col("success"), F.lit("request_ok")).otherwise(F.lit("request_failed")).alias("event_type"),
        F.when(F.col("event_id") % 11 != 3, F.pmod(F.hash("event_id"), F.lit(50)) - 5).cast("bigint").alias("latency_ms"))
    stream = streams.rolling_metrics(as_stream(spark, split(events, batches), events.schema), width="1 hour", slide="10 minutes")
    got = {r.window_start: r.asDict() for r in streams.run_to_table(spark, stream, "t1").collect()}
    data = events.collect()
    final = max(r.ts for r in data) - datetime.timedelta(minutes=10)
    starts = {r.ts.replace(minute=r.ts.minute // 10 * 10, second=0) - datetime.timedelta(minutes=10 * k) for r in data for k in range(6)}
    want = {s for s in starts if s + datetime.timedelta(hours=1) <= final}
    assert set(got) == want and want
    for s in want:
        own = [r for r in data if s <= r.ts < s + datetime.timedelta(hours=1)]
        kinds = Counter(r.event_type for r in own)
        times = sorted(r.latency_ms for r in own if r.event_type == "request_ok" and r.latency_ms is not None and r.latency_ms >= 0)
        extracted, repeated = kinds["extracted"], kinds["deduplicated"]
        row = got[s]
        assert (row["requests_succeeded"], row["requests_failed"]) == (kinds["request_ok"], kinds["request_failed"])
        assert row["avg_latency_ms"] == (math.floor(sum(times) / len(times) + 0.5) if times else 0)
        assert row["p95_latency_ms"] == (times[math.ceil(0.95 * len(times)) - 1] if times else 0)
        assert row["jobs_per_minute"] == math.floor(extracted / 60 * 10 + 0.5) / 10
        assert row["dedup_ratio_pct"] == (math.floor(repeated / extracted * 1000 + 0.5) / 10 if extracted else 0)
    assert metrics._COUNTERS["requests_failed"] == "request_failed"


def test_stream_dedup_keeps_one_row_per_url(spark):
    df = spark.range(60).select(
        "id", F.timestamp_seconds(F.col("id") * 3600).alias("ts"),
        F.concat(F.lit("https://a.com/"), (F.col("id") % 7).cast("string"), F.lit("?utm_source=x")).alias("url"),
        F.lit("t").alias("title"), F.lit("c").alias("company"), F.lit("d").alias("description"))
    stream = streams.dedup_stream(as_stream(spark, split(df, 3, "id"), df.schema)).select("url_hash")
    assert streams.run_to_table(spark, stream, "t3").count() == 7


def test_idle_keys_time_out_and_return(spark):
    """A key goes quiet, is reported, comes back and is reported again."""
    data = [(0, "a", 0), (1, "b", 30), (2, "b", 4000), (3, "a", 4100), (4, "b", 9000), (5, "b", 9100)]
    df = spark.createDataFrame(data, "event_id bigint, domain string, sec bigint").withColumn(
        "ts", F.timestamp_seconds(F.col("sec") + 1_000_000))
    stream = streams.idle_keys(as_stream(spark, split(df, 6), df.schema), "domain", minutes=10, delay="1 minutes")
    got = sorted((r.domain, r.last_us // 1000000 - 1_000_000) for r in streams.run_to_table(spark, stream, "t9").collect())
    assert got == [("a", 0), ("a", 4100), ("b", 30), ("b", 4000)]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_ingest(spark, batches):
    data = [(i, f"https://a.com/{i % 10}", f"Title {i % 10}", "Acme", "A long description", "s", "Pune") for i in range(30)]
    df = spark.createDataFrame(data, "seq bigint, url string, title string, company string, description string, source string, location string")
    target, counts = fresh_dir() + "/jobs", []
    writer = streams.ingest_writer(
        as_stream(spark, split(df, batches, "seq"), df.schema), target, fresh_dir() + "/seen", "2024-01-01 00:00:00", ["seq"],
        report=lambda c, epoch: counts.append(c.first().inserted))
    streams.run_available(spark, writer, "t7")
    assert spark.read.parquet(target).count() == 10 and sum(counts) == 10
    assert with_fingerprints(spark.read.parquet(target)).select("url_hash").distinct().count() == 10


def test_snapshots_are_written_at_intervals(spark):
    df = request_log(spark, 200)
    out = fresh_dir() + "/snapshots"
    counted = streams.domain_counts(
        as_stream(spark, split(df, 2), df.schema).withColumn("blocked", ~F.col("success")))
    query = streams.start_snapshots(counted, out, fresh_dir() + "/progress", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(out).filter("requests > 0").count() > 0


def test_report_sink_and_run_context(spark):
    path = fresh_dir() + "/report"
    rows = with_run_context(spark.createDataFrame([(1,)], "n int"), "run-1", "2024-01-01 00:00:00", "board")
    tables.write_report(rows, path)
    back = spark.read.json(path).first()
    assert (back.n, back.run_id, back.run_platform) == (1, "run-1", "board")


def test_table_grows_columns(spark):
    path = fresh_dir() + "/jobs"
    spark.createDataFrame([("u", "t")], "url string, title string").write.parquet(path)
    old = read_jobs(spark, path).first()
    assert (old.url, old.experience, old.source_tier) == ("u", None, None)
    assert read_jobs(spark, path + "-none").count() == 0


# --- the seven-day content rule -----------------------------------------------------------

def _walk(rows, refresh, text):
    """(seq) of rows that go through, by a plain fold over rows of (key, seconds, text, seq)."""
    kept, out = {}, []
    for key, sec, t, seq in sorted(rows, key=lambda r: (r[1], r[3])):
        own = [e for e in kept.get(key, []) if sec - e[0] <= 30 * 86400]
        if not any(sec - e[0] < refresh or (text and e[1] == t) for e in own):
            kept.setdefault(key, []).append((sec, t))
            out.append(seq)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_refreshed_content_in_parts(spark, parts):
    rng = random.Random(5)
    data = [(rng.choice("ABCDEFGH"), rng.randrange(86400, 90 * 86400), rng.choice("xyz"), i) for i in range(1500)]
    data += [("H", 7 * 86400 * k, "w", 2000 + k) for k in range(1, 6)]
    df = spark.createDataFrame(data, "content_hash string, sec long, desc_hash string, seq long").withColumns({
        "ts": F.timestamp_seconds(F.col("sec")), "url_hash": F.concat("content_hash", F.col("seq").cast("string")),
    })
    rows, out = df.select("ts", "url_hash", "content_hash", "desc_hash", "seq"), fresh_dir() + "/out"
    slices = F.floor(F.unix_seconds("ts") / (90 * 86400 / parts)).cast("int")
    streams.run_in_slices(
        spark, rows, slices, parts,
        lambda s: streams.refreshed_content(s).writeStream.outputMode("append").format("parquet").option("path", out), "refresh",
    )
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == _walk(data, 7 * 86400, True)


def test_urls_return_after_the_retention(spark):
    day = 86400
    data = [("u", 1, "", 1), ("u", 30 * day + 1, "", 2), ("u", 30 * day + 2, "", 3), ("v", 5, "", 4), ("v", 5, "", 5), ("u", 40 * day, "", 6)]
    df = spark.createDataFrame(data, "url_hash string, sec long, desc_hash string, seq long").withColumn("content_hash", F.lit("c"))
    rows = df.select(F.timestamp_seconds("sec").alias("ts"), "url_hash", "content_hash", "desc_hash", "seq")
    out = fresh_dir() + "/out"
    streams.run_in_slices(
        spark, rows, (F.col("seq") >= 6).cast("int"), 2,
        lambda s: streams.first_urls(s).writeStream.outputMode("append").format("parquet").option("path", out), "urls",
    )
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [1, 3, 4] == _walk(data, 30 * day + 1, False)


def test_keys_share_state_rows(spark):
    """More keys than state rows, one of them null; numbers beyond 2**53 stay exact beside a row without one."""
    n, big = 1500, 2 ** 60
    data = [(f"u{i % n}" if i % n else None, 86400 + i, big + i if i != 7 else None) for i in range(2 * n)]
    df = spark.createDataFrame(data, "url_hash string, sec long, seq long")
    rows = df.select(F.timestamp_seconds("sec").alias("ts"), "url_hash", F.lit("c").alias("content_hash"), F.lit("d").alias("desc_hash"), "seq")
    path, out = fresh_dir() + "/in", fresh_dir() + "/out"
    rows.repartition(4).write.parquet(path)
    writer = streams.first_urls(spark.readStream.schema(rows.schema).parquet(path)).writeStream.format("parquet").option("path", out)
    query = writer.option("checkpointLocation", fresh_dir()).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(held) <= 1024
    got = spark.read.parquet(out).collect()
    assert Counter((r.url_hash, r.seq) for r in got) == Counter((u, s) for u, _, s in data[:n])
    assert sorted(r.ts.timestamp() for r in got) == [sec for _, sec, _ in data[:n]]


def test_the_stream_agrees_with_the_batch_verdict(spark):
    """What the stream stored is history for the batch rule; later rows get the same answer from both."""
    as_of, day = datetime.datetime(2024, 1, 31), 86400
    old = [(f"u{i}", f"c{i % 20}", f"t{i % 3}", i % 40, i) for i in range(200)]
    new = [(f"n{i}" if i % 5 else f"u{i}", f"c{i}", f"t{i % 4}", -1, 1000 + i) for i in range(25)]
    df = spark.createDataFrame(old + new, "url_hash string, content_hash string, desc_hash string, age long, seq long")
    rows = df.select(F.timestamp_seconds(F.lit(as_of.timestamp() - 0) - F.col("age") * day).alias("ts"),
                     "url_hash", "content_hash", "desc_hash", "seq")
    first, out = fresh_dir() + "/first", fresh_dir() + "/out"
    streams.run_in_slices(
        spark, rows, (F.col("seq") >= 1000).cast("int"), 2,
        lambda s: streams.first_urls(s).writeStream.outputMode("append").format("parquet").option("path", first), "first",
    )
    source = spark.readStream.schema(rows.schema).parquet(first)
    streams.run_available(spark, streams.refreshed_content(source).writeStream.format("parquet").option("path", out), "fresh")
    stored = spark.read.parquet(out)
    now = datetime.datetime.fromtimestamp(as_of.timestamp() + day)
    seen = dedup.prune_seen(stored.filter("seq < 1000").withColumnRenamed("ts", "stored_at"), now)
    batch = rows.filter("seq >= 1000")
    met = dedup.match_url(batch, rows.filter("seq < 1000").filter(F.col("ts") >= F.lit(now) - F.expr("INTERVAL 30 DAYS")))
    verdicts = dedup.dedup_verdict(batch.join(met.select("seq"), "seq", "left_anti"), seen, now)
    want = sorted(r.seq for r in verdicts.filter("verdict = 'none'").collect())
    assert sorted(r.seq for r in stored.filter("seq >= 1000").collect()) == want and 0 < len(want) < 25


def test_rows_of_slices_are_worked_out_once(spark):
    """A part that is drawn anew for each slice would lose rows and repeat others."""
    out = scratch_path(spark, "slices")
    streams.run_in_slices(
        spark, spark.range(1000), F.pmod(F.hash(F.expr("uuid()")), F.lit(3)), 3,
        lambda s: s.writeStream.outputMode("append").format("parquet").option("path", out), "slices",
    )
    got = [r.id for r in spark.read.schema("id bigint").parquet(out).collect()]
    assert sorted(got) == list(range(1000))
