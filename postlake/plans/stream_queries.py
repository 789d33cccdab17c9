"""Streams run to completion over the event and page tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.hashing import with_fingerprints
from postlake.operators import metrics
from postlake.plans import sqltext as S
from postlake.plans import traffic_queries  # noqa: F401 - its SQL is reused
from postlake.plans import views as V
from postlake.plans.dedup_queries import BOARDS, _sql_hashes, sql_history
from postlake.plans.registry import ORACLES, query
from postlake.plans.text_queries import SQL_FP
from postlake.session import scratch_path
from postlake.streaming import streams

# A window is final once the watermark, ten minutes behind the latest event,
# has passed its end.
_SQL_FINAL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


# Streams below are fed in parts of ten days; of each part's last five minutes, rows with an even id come a part later.
_PART_DAYS = 10


def _part_of(ts: str) -> Column:
    width = _PART_DAYS * 86400
    second = F.unix_seconds(F.col(ts)) - F.unix_seconds(F.lit(V.RUN_START).cast("timestamp"))
    late = (F.pmod(second, F.lit(width)) >= width - 300) & (F.col("event_id") % 2 == 0)
    return F.least(F.greatest(F.floor(second / width) + late.cast("int"), F.lit(0)), F.lit(_PARTS - 1))


_PARTS = 4


_TIMED = "event_type = 'request_ok' AND latency_ms >= 0"


def _sql_windows(group: str, step: int) -> str:
    names = ", ".join(f"count(*) FILTER (event_type = '{v}') AS {k}" for k, v in metrics._COUNTERS.items())
    return f"""w AS (SELECT *, unnest(range({60 // step})) AS k FROM v_run_events),
    g AS (SELECT (epoch_us(ts) // {step * 1000000} - k) * {step * 1000000} AS start_us, {group} {names},
      coalesce({S.half_up(f"avg(CAST(latency_ms AS DOUBLE)) FILTER ({_TIMED})")}, 0) AS avg_latency_ms,
      coalesce(CAST(quantile_disc(latency_ms, 0.95) FILTER ({_TIMED}) AS BIGINT), 0) AS p95_latency_ms FROM w GROUP BY ALL)"""


_RATE = f"""CASE WHEN requests_succeeded + requests_failed > 0
  THEN {S.half_up('requests_succeeded / (requests_succeeded + requests_failed) * 100')} ELSE 100 END AS success_rate_pct,
  CASE WHEN jobs_extracted > 0 THEN {S.half_up('jobs_deduplicated / jobs_extracted * 100', 1)} ELSE 0.0::DOUBLE END AS dedup_ratio_pct,
  {S.half_up('CAST(jobs_extracted AS DOUBLE)', 1)} AS jobs_per_minute, avg_latency_ms, p95_latency_ms"""


@query(
    "stream_rolling_metrics",
    f"""WITH {V.SQL_RUN_EVENTS}, {_sql_windows('', 10)} SELECT start_us, {', '.join(metrics._COUNTERS)}, {_RATE} FROM g
      WHERE make_timestamp(start_us + 60000000) <= {_SQL_FINAL}""",
)
def stream_rolling_metrics(spark, sf):
    out = streams.run_to_table(spark, streams.rolling_metrics(V.v_run_events(spark, sf, stream=True)), "rolling")
    rates = ["success_rate_pct", "dedup_ratio_pct", "jobs_per_minute", "avg_latency_ms", "p95_latency_ms"]
    return out.select(F.unix_micros("window_start").alias("start_us"), *metrics._COUNTERS, *rates)


@query(
    "stream_domain_counts",
    f"""WITH {V.SQL_TRAFFIC} SELECT epoch_us(ts) // 60000000 * 60000000 AS start_us, domain, count(*) AS requests,
      count(*) FILTER (blocked) AS blocked FROM v_traffic GROUP BY 1, 2
      HAVING make_timestamp(epoch_us(any_value(ts)) // 60000000 * 60000000 + 60000000) <= {_SQL_FINAL}""",
)
def stream_domain_counts(spark, sf):
    out = streams.run_to_table(spark, streams.domain_counts(V.v_traffic(spark, sf, stream=True)), "domains")
    return out.select(F.unix_micros("window_start").alias("start_us"), "domain", "requests", "blocked")


@query("stream_dedup", f"WITH {V.SQL_LISTINGS}, {SQL_FP} SELECT DISTINCT url_hash FROM fp")
def stream_dedup(spark, sf):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("seq") % 86400)
    rows = V.v_listings(spark, sf, stream=True).withColumn("ts", at)
    return streams.run_to_table(spark, streams.dedup_stream(rows, columns=[]).select("url_hash"), "dedup")


@query(
    "stream_dedup_content",
    f"WITH {sql_history(BOARDS)} SELECT DISTINCT content_hash, desc_hash FROM (SELECT content_hash, desc_hash FROM seen UNION ALL SELECT content_hash, desc_hash FROM batch)",
)
def stream_dedup_content(spark, sf):
    """Every document and its second sighting, one after the other: each pair of content and text goes through once."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("seq") % 86400)
    met = V.v_doc_listings(spark, sf).withColumn("part", F.lit(0)).unionByName(V.v_doc_recrawl(spark, sf).withColumn("part", F.lit(1)))
    out = scratch_path(spark, "dedup-content")
    streams.run_in_slices(
        spark, met.withColumn("ts", at), F.col("part"), 2,
        lambda s: streams.dedup_stream(s, columns=[], content_key=BOARDS).select("content_hash", "desc_hash")
        .writeStream.outputMode("append").format("parquet").option("path", out), "dedup-content",
    )
    return spark.read.schema("content_hash string, desc_hash string").parquet(out)


_KEPT_US, _REFRESH_US = 30 * 86_400_000_000, 7 * 86_400_000_000


def _sql_not_met(name: str, src: str, key: str, text: str, refresh: int) -> str:
    """Rows of ``src`` that go through: a walk from each key's first row to the next one that is not met yet."""
    return f"""{name}_n AS (SELECT *, {text} AS t, row_number() OVER (PARTITION BY {key} ORDER BY us, seq) AS o FROM {src}),
    {name} AS (SELECT * EXCLUDE (t, o), o, [{{'us': us, 't': t}}] AS kept FROM {name}_n WHERE o = 1
      UNION ALL SELECT r.* EXCLUDE (t, o), r.o, list_append(w.kept, {{'us': r.us, 't': r.t}}) FROM {name} w JOIN {name}_n r
        ON r.{key} = w.{key} AND r.o > w.o AND r.us >= w.us + {refresh}
        AND len(list_filter(w.kept, lambda x: x.t = r.t AND r.us - x.us <= {_KEPT_US})) = 0
      QUALIFY row_number() OVER (PARTITION BY r.{key} ORDER BY r.o) = 1)"""


def _postings(spark, sf):
    """Every document up to 39 days before the run, and met again within two days after it."""
    day = (F.col("seq") % 40).cast("int")
    docs = V.v_doc_listings(spark, sf).withColumn("ts", F.lit(V.AS_OF).cast("timestamp") - F.make_dt_interval(days=day))
    again = V.v_doc_recrawl(spark, sf).withColumn(
        "ts", F.lit(V.AS_OF).cast("timestamp") + F.make_dt_interval(hours=(F.col("seq") % 48 + 1).cast("int"))
    )
    both = docs.unionByName(again.withColumn("seq", F.col("seq") + V.RECRAWL))
    return with_fingerprints(both, BOARDS).select("ts", "url_hash", "content_hash", "desc_hash", "seq")


@query(
    "stream_dedup_refresh",
    f"""WITH RECURSIVE {sql_history(BOARDS)}, met AS (
      SELECT epoch_us(TIMESTAMP '{V.AS_OF}') - seq % 40 * 86400000000 AS us, url_hash, content_hash, desc_hash, seq
        FROM ({_sql_hashes('v_doc_listings', BOARDS)}) UNION ALL
      SELECT epoch_us(TIMESTAMP '{V.AS_OF}') + (seq % 48 + 1) * 3600000000, url_hash, content_hash, desc_hash, seq + {V.RECRAWL}
        FROM batch),
    {_sql_not_met('urls', 'met', 'url_hash', "''", _KEPT_US + 1)},
    firsts AS (SELECT us, url_hash, content_hash, desc_hash, seq FROM urls),
    {_sql_not_met('fresh', 'firsts', 'content_hash', 'desc_hash', _REFRESH_US)}
    SELECT seq, us FROM fresh""",
)
def stream_dedup_refresh(spark, sf):
    """What the seen store would take in, row by row, over 41 days in four parts."""
    rows, first = _postings(spark, sf), scratch_path(spark, "first-urls")
    now = F.lit(V.AS_OF).cast("timestamp")
    after = F.when(F.col("ts") <= now + F.expr("INTERVAL 1 DAY"), 2).otherwise(3)
    part = F.when(F.col("ts") <= now - F.expr("INTERVAL 20 DAYS"), 0).when(F.col("ts") <= now, 1).otherwise(after)
    streams.run_in_slices(
        spark, rows, part, 4,
        lambda s: streams.first_urls(s).writeStream.outputMode("append").format("parquet").option("path", first), "first-urls",
    )
    out = streams.run_to_table(spark, streams.refreshed_content(spark.readStream.schema(rows.schema).parquet(first)), "refreshed")
    return out.select("seq", F.unix_micros("ts").alias("us"))


def _sql_idle(rows: str, minutes: int) -> str:
    """Last time before every gap of a domain, final once the watermark has passed the end of the gap."""
    return f"""r AS ({rows}), g AS (SELECT domain, ts, lead(ts) OVER (PARTITION BY domain ORDER BY ts) AS nxt FROM r)
    SELECT domain, epoch_us(ts) AS last_us FROM g WHERE (nxt IS NULL OR nxt - ts >= INTERVAL {minutes} MINUTE)
      AND ts + INTERVAL {minutes} MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM r)"""


def _idle(spark, rows, build, label):
    out = scratch_path(spark, label)
    streams.run_in_slices(
        spark, rows, _part_of("ts"), _PARTS, lambda s: build(s).writeStream.outputMode("append").format("parquet").option("path", out), label
    )
    return spark.read.schema("domain string, last_us bigint").parquet(out)


@query(
    "stream_idle_domains",
    f"WITH {V.SQL_RUN_EVENTS}, " + _sql_idle("SELECT domain, ts FROM v_run_events WHERE event_type = 'extracted'", 20),
)
def stream_idle_domains(spark, sf):
    return _idle(spark, V.v_run_events(spark, sf), streams.no_progress, "idle")


@query("stream_idle_keys", f"WITH {V.SQL_TRAFFIC}, " + _sql_idle("SELECT domain, ts FROM v_traffic", 10))
def stream_idle_keys(spark, sf):
    return _idle(spark, V.v_traffic(spark, sf), lambda s: streams.idle_keys(s, "domain"), "idle-keys")


def _to_the_end(spark, rows, build, label):
    """All rows of a finished input, in parts and then closed."""
    out = scratch_path(spark, label)
    streams.run_in_slices(
        spark, rows, _part_of("ts"), _PARTS, lambda s: build(s).writeStream.outputMode("append").format("parquet").option("path", out), label,
        closing=streams.end_of_input(rows),
    )
    return spark.read.parquet(out)


@query("stream_attempt_numbers", ORACLES["attempt_numbers"])
def stream_attempt_numbers(spark, sf):
    log = V.v_traffic(spark, sf).withColumn("success", F.col("status") == 200)
    return _to_the_end(spark, log, streams.attempts, "attempts").select("event_id", "attempt")


@query("stream_alert_cooldown", ORACLES["alert_cooldown"])
def stream_alert_cooldown(spark, sf):
    sent = _to_the_end(spark, V.v_alerts(spark, sf), streams.cooldown, "alerts")
    return sent.select(F.concat_ws(":", "channel", "severity").alias("key"), F.unix_micros("ts").alias("ts_us"))


@query(
    "stream_ingest",
    f"""WITH {V.SQL_LISTINGS}, {SQL_FP}, ok AS (SELECT * FROM fp WHERE length(title) >= 2 AND length(description) >= 10)
    SELECT sha256(url || '||' || title || '||' || company) AS fingerprint FROM ok
      QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY seq) = 1""",
)
def stream_ingest(spark, sf):
    """Listings in three parts by number; each part is dated by its own rows."""
    target, seen = scratch_path(spark, "jobs"), scratch_path(spark, "seen")
    part = F.when(F.col("seq") >= V.RECRAWL, 2).otherwise((F.col("seq") % V.RECRAWL >= 100).cast("int"))
    at = F.lit(V.AS_OF).cast("timestamp") + F.make_dt_interval(hours=part)
    rows = V.v_listings(spark, sf).withColumn("crawled_at", at)
    streams.run_in_slices(
        spark, rows, part, 3, lambda s: streams.ingest_writer(s, target, seen, V.AS_OF, ["seq"], clock="crawled_at"), "ingest"
    )
    return spark.read.parquet(target).select("fingerprint")
