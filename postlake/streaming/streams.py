"""Streaming forms of the rolling metrics, dedup, attempts, alerts and ingest.

Event time drives everything.  Built-in state covers windows and duplicate
removal; what depends on the order of rows inside a key waits in Spark's keyed
state until the watermark has passed it.  Ingest runs per micro-batch with the
batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postlake import constants as K
from postlake.functions.hashing import with_fingerprints
from postlake.functions.scalars import half_up
from postlake.operators import metrics
from postlake.operators.seen_store import SeenStore
from postlake.operators.store import PREFIX_CHARS
from postlake.plans import jobs
from postlake.session import drop_path, scratch_path

DEFAULT_DELAY = "10 minutes"


# --- built-in state ----------------------------------------------------------------

def rolling_metrics(
    events: DataFrame, by: list[str] | None = None, delay: str = DEFAULT_DELAY,
    width: str = "60 seconds", slide: str = "10 seconds",
) -> DataFrame:
    """Counters, rates, throughput and latency per sliding window, overall or per key.

    The latency part of a window's state holds a count for each value, which merges before the shuffle and over micro-batches;
    the mean and the nearest-rank p95 are read from all successes of the window, not from a sample.
    """
    kind = F.col("event_type")
    counts = [F.count_if(kind == v).alias(k) for k, v in metrics._COUNTERS.items()]
    if "latency_ms" not in events.columns:
        events = events.withColumn("latency_ms", F.lit(None).cast("bigint"))
    timed = F.when((kind == "request_ok") & (F.col("latency_ms") >= 0), F.col("latency_ms"))
    minutes = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(60e6)
    return (
        events.withColumn("_timed", timed).withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide), *(by or []))
        .agg(*counts, F.avg(F.col("_timed").cast("double")).alias("_mean"),
             F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _timed)").alias("_p95"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            *(by or []), *metrics._COUNTERS,
            metrics.success_rate(F.col("requests_succeeded"), F.col("requests_failed")).alias("success_rate_pct"),
            metrics.dedup_ratio(F.col("jobs_deduplicated"), F.col("jobs_extracted")).alias("dedup_ratio_pct"),
            metrics.per_minute(F.col("jobs_extracted"), minutes).alias("jobs_per_minute"),
            F.coalesce(half_up("_mean"), F.lit(0).cast("bigint")).alias("avg_latency_ms"),
            F.coalesce(half_up("_p95"), F.lit(0).cast("bigint")).alias("p95_latency_ms"),
        )
    )


def domain_counts(requests: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Requests and blocks per domain and minute."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy(F.window("ts", "60 seconds"), "domain")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if("blocked").alias("blocked"))
        .select(F.col("window.start").alias("window_start"), "domain", "requests", "blocked")
    )


def dedup_stream(
    rows: DataFrame, days: int = K.SEEN_RETENTION_DAYS, columns: list[str] | None = None, content_key: str | None = None,
) -> DataFrame:
    """First row per URL; a URL is forgotten after the retention time.

    With ``content_key`` the same content with the same text counts as met before too, under whatever URL.

    ``columns`` go through the state's shuffle next to ``ts`` and ``url_hash``; by default all do.
    """
    content = ["content_hash", "desc_hash"] if content_key else []
    hashed = with_fingerprints(rows, content_key or "url_title")
    if columns is not None:
        hashed = hashed.select(*dict.fromkeys(["ts", "url_hash", *content, *columns]))
    first = hashed.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["url_hash"])
    return first.dropDuplicatesWithinWatermark(content) if content else first


_POSTING = ["us", "url_hash", "content_hash", "desc_hash", "seq"]

# Groups of keys that share a state row, fixed for a stream's checkpoint. A call of Python costs milliseconds, a key in it
# microseconds; a micro-batch writes the groups anew that it touches.
KEY_GROUPS = 1024


def _not_yet_met(
    rows: DataFrame, key: str, text: str | None, refresh: int, days: int, delay: str, groups: int = KEY_GROUPS,
) -> DataFrame:
    """Rows of postings that their key's memory does not hold; each is remembered for ``days`` and then forgotten.

    A row is met again while a remembered row of its key is younger than ``refresh`` (microseconds), or has the same ``text``.
    Remembered rows of a key lie at least ``refresh`` apart, so a key holds ``days`` / ``refresh`` + 1 of them at most, and those
    that the watermark has not passed yet. Micro-batches are judged as they arrive, the rows of one by (ts, seq); rows behind the
    watermark are left out by Spark. Keys are dealt by hash to ``groups``, each with the memory of its keys as one state: it
    loses what is forgotten whenever rows arrive, and Spark times it out when its last row is older than ``days``.
    """
    kept_for = days * 86_400_000_000
    columns = ["ts", *_POSTING[1:]]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(group: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(chunks)).sort_values(["us", "_none", "seq"], kind="stable")
        known = list(zip(*state.get)) if state.exists else []
        memory: dict = {}
        for own, us, words in known:
            memory.setdefault(own, []).append((us, words))
        at, texts = [], batch[text].tolist() if text else [""] * len(batch)
        for k, (own, us, words) in enumerate(zip(batch[key].tolist(), batch["us"].tolist(), texts)):
            met = memory.setdefault(own, [])
            if met and us < met[-1][0] + refresh or any(words == w and us - t <= kept_for for t, w in met):
                continue
            met.append((us, words))
            at.append(k)
        over = state.getCurrentWatermarkMs() * 1000 - kept_for  # no row that is still to come meets what is not younger
        kept = [(own, us, words) for own, met in memory.items() for us, words in met if us > over]
        if kept:
            if at or len(kept) < len(known):
                state.update(tuple(list(c) for c in zip(*kept)))
            state.setTimeoutTimestamp((max(us for _, us, _ in kept) + kept_for) // 1000 + 1)
        elif state.exists:
            state.remove()
        if at:
            yield batch.iloc[at][[*_POSTING, "_none"]]

    seq = F.col("seq")
    if kinds["seq"] in ("tinyint", "smallint", "int", "bigint"):  # a null among them would make pandas read them as floats
        seq = F.coalesce(seq, F.lit(0).cast(kinds["seq"]))
    slim = rows.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        "ts", F.unix_micros("ts").alias("us"), *_POSTING[1:-1], seq.alias("seq"), F.col("seq").isNull().alias("_none"),
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"),
    )
    out = slim.groupBy("_group").applyInPandasWithState(
        run, ", ".join([*(f"{c} {kinds.get(c, 'bigint')}" for c in _POSTING), "_none boolean"]),
        f"keys array<{kinds[key]}>, times array<bigint>, texts array<string>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return out.withColumns({"ts": F.timestamp_micros("us"), "seq": F.when(~F.col("_none"), F.col("seq"))}).select(*columns)


def first_urls(rows: DataFrame, days: int = K.SEEN_RETENTION_DAYS, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Postings (ts, url_hash, content_hash, desc_hash, seq) whose URL was not met within ``days``."""
    return _not_yet_met(rows, "url_hash", None, days * 86_400_000_000 + 1, days, delay)


def refreshed_content(
    rows: DataFrame, days: int = K.SEEN_RETENTION_DAYS, refresh_days: int = K.REFRESH_DAYS, delay: str = DEFAULT_DELAY,
) -> DataFrame:
    """Postings to store: content that is new, or comes with a new text and was last stored ``refresh_days`` ago or earlier.

    The rule of ``dedup.dedup_verdict`` on a stream. It reads what ``first_urls`` wrote, as a query of its own: a row that the
    URL rule drops never reaches the content's memory. Only stored rows are remembered, so a posting that keeps coming back
    is refreshed every ``refresh_days``. All rows of one content in one micro-batch meet in one task, without their texts.
    """
    return _not_yet_met(rows, "content_hash", "desc_hash", refresh_days * 86_400_000_000, days, delay)


# --- idle keys ----------------------------------------------------------------------

def idle_keys(events: DataFrame, key: str, minutes: int = K.IDLE_KEY_MINUTES, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Keys with no event for ``minutes``: one row per gap, with the last time before it.

    A session of a key ends ``minutes`` after its last event, so every closed session is one gap, however the rows were
    dealt to micro-batches. Parts of a session are merged before the shuffle; the state is one row per open session.
    """
    sessions = events.withWatermark("ts", delay).groupBy(F.session_window("ts", f"{minutes} minutes"), key)
    return sessions.agg(F.max("ts").alias("last")).select(key, F.unix_micros("last").alias("last_us"))


def no_progress(events: DataFrame, key: str = "domain", minutes: int = K.HEALTH_THRESHOLDS["no_progress_warn_min"]) -> DataFrame:
    """Keys that stopped yielding extracted rows."""
    return idle_keys(events.filter(F.col("event_type") == "extracted"), key, minutes)


# --- keyed state in event-time order ---------------------------------------------------

_STATE = "carried bigint, us array<bigint>, ids array<bigint>, flags array<boolean>"


def _in_order(rows: DataFrame, keys: list[str], flag: Column, value: str, step: Callable, delay: str) -> DataFrame:
    """Rows of each key go through ``step`` in event-time order, once the watermark has passed them.

    ``step(carried, us, flags)`` gets ripe rows in the order of (ts, event_id) and what it carried last time; it returns what to
    carry on, the places of the rows to hand out and a value for each. Rows that are not ripe wait in the key's state, for which
    a timer is set; rows behind the watermark are dropped by Spark. A key's state is what it carries and its rows of the last
    ``delay``. Rows without a time or an event_id only move the watermark, so such a row can end a finished input.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [*keys, "us", "event_id", value]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried, us, ids, flags = state.get if state.exists else (None, [], [], [])
        parts = [(np.array(us, dtype=np.int64), np.array(ids, dtype=np.int64), np.array(flags, dtype=bool))]
        if not state.hasTimedOut:
            for chunk in chunks:
                chunk = chunk[chunk["event_id"].notna() & chunk["us"].notna()]
                parts.append((chunk["us"].to_numpy(np.int64), chunk["event_id"].to_numpy(np.int64), chunk["flag"].fillna(False).to_numpy(bool)))
        us, ids, flags = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((ids, us))
        us, ids, flags = us[order], ids[order], flags[order]
        n = int(np.searchsorted(us, state.getCurrentWatermarkMs() * 1000, "right"))
        if n:
            carried, at, values = step(carried, us[:n], flags[:n])
            yield pd.DataFrame({**{k: [v] * len(at) for k, v in zip(keys, key)}, "us": us[at], "event_id": ids[at], value: values})
        if n < len(us):
            state.update((carried, us[n:].tolist(), ids[n:].tolist(), flags[n:].tolist()))
            state.setTimeoutTimestamp(-(-int(us[n]) // 1000))
        elif carried is None:
            if state.exists:
                state.remove()
        else:
            state.update((carried, [], [], []))

    slim = rows.withWatermark("ts", delay).select(*keys, "ts", F.unix_micros("ts").alias("us"), "event_id", flag.alias("flag"))
    out = slim.groupBy(*keys).applyInPandasWithState(
        run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"us bigint, event_id bigint, {value} bigint"]), _STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return out.select(*names).withColumn("ts", F.timestamp_micros("us")).drop("us")


def attempts(log: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """(domain, event_id, attempt, ts) of failures: failures of the domain since its last success, in event-time order."""
    def step(carried: int | None, us: np.ndarray, success: np.ndarray) -> tuple:
        fails = np.cumsum(~success) + (carried or 0)
        at_success = np.maximum.accumulate(np.where(success, fails, 0))
        number = fails - at_success
        at = np.flatnonzero(~success)
        return int(number[-1]) or None, at, number[at]

    return _in_order(log, ["domain"], F.col("success"), "attempt", step, delay)


def cooldown(stream: DataFrame, minutes: int = K.ALERT_COOLDOWN_MINUTES, delay: str = DEFAULT_DELAY) -> DataFrame:
    """(channel, severity, event_id, ts) of the alerts that go out: none of a key within ``minutes`` of the last that did."""
    quiet = minutes * 60_000_000

    def step(carried: int | None, us: np.ndarray, _: np.ndarray) -> tuple:
        at = []
        k = 0 if carried is None else int(np.searchsorted(us, carried + quiet))
        while k < len(us):
            at.append(k)
            carried = int(us[k])
            k = int(np.searchsorted(us, carried + quiet))
        return carried, np.array(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)

    return _in_order(stream, ["channel", "severity"], F.lit(False), "sent", step, delay).drop("sent")


def end_of_input(rows: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """One row that moves the watermark behind all of ``rows``: nothing but a time, later than any by twice the delay."""
    last = rows.agg((F.max("ts") + F.expr(f"INTERVAL {delay}") * 2 + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    return last.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


# --- per micro-batch --------------------------------------------------------------------

def ingest_writer(
    rows: DataFrame, target_path: str, state_path: str, as_of, order: list[str],
    content_key: str = "url_title", report: Callable[[DataFrame, int], None] | None = None, clock: str | None = None,
    chars: int = PREFIX_CHARS,
) -> DataStreamWriter:
    """Micro-batch ingest: validate, deduplicate, insert if absent.

    ``clock`` names the column of collection times: a micro-batch is dated by its latest one, so dates move on with the
    data and a replay finds the same date. Without it every batch is dated ``as_of``.

    A batch reads the folders of the target and of the seen store that its hashes fall into, and appends to both: what a batch
    reads of them follows the prefixes it touches, what it writes follows its own rows. A replayed batch looks up the rows of
    earlier batches, and the insert skips fingerprints that already arrived, so nothing is stored twice. ``chars`` is the
    length of the prefixes, fixed for a target and its seen store.
    """
    spark = rows.sparkSession
    seen = SeenStore(spark, state_path, chars)

    def step(batch: DataFrame, epoch: int) -> None:
        latest = batch.agg(F.date_format(F.max(clock), "yyyy-MM-dd HH:mm:ss")).first()[0] if clock else None
        now = latest or as_of
        by_url, by_content = seen.lookups(with_fingerprints(batch, content_key), epoch, now)
        done = jobs.ingest(batch, by_content, target_path, now, order, content_key, by_url=by_url, chars=chars)
        seen.add(done["stored"], epoch)
        seen.expire(now)
        if report:
            report(done["counts"], epoch)
        drop_path(spark, done["accepted_path"])

    return rows.writeStream.foreachBatch(step)


# --- running ----------------------------------------------------------------------------

def run_available(spark: SparkSession, writer: DataStreamWriter, label: str) -> None:
    """Work through everything that is there, then stop."""
    query = writer.option("checkpointLocation", scratch_path(spark, f"{label}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()


def run_in_slices(
    spark: SparkSession, rows: DataFrame, slice_of, slices: int, start: Callable[[DataFrame], DataStreamWriter], label: str,
    closing: DataFrame | None = None,
) -> None:
    """Let rows arrive in ``slices`` parts and work through each before the next one comes, as one continued stream.

    The rows are worked out once and wait as files by part; what a part costs follows its own rows.

    ``closing`` arrives last: ``end_of_input`` of a finished input lets everything go that waits for the watermark.
    """
    landing, progress = scratch_path(spark, f"{label}-landing"), scratch_path(spark, f"{label}-progress")
    waiting = scratch_path(spark, f"{label}-waiting")
    rows.withColumn("_part", slice_of.cast("int")).filter(F.col("_part").between(0, slices - 1)) \
        .write.partitionBy("_part").parquet(waiting)
    kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(waiting)
    parts = [kept.filter(F.col("_part") == part).drop("_part") for part in range(slices)]
    for part in [*parts, closing] if closing is not None else parts:
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(rows.schema).parquet(landing)
        start(stream).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    drop_path(spark, waiting)


def run_to_table(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream to a table in the shared folder and read it back."""
    out = scratch_path(spark, label)
    run_available(spark, stream.writeStream.outputMode(mode).format("parquet").option("path", out), label)
    return spark.read.schema(stream.schema).parquet(out)


def start_snapshots(stream: DataFrame, path: str, checkpoint: str, every: str = "2 minutes"):
    """Write a stream of snapshots at fixed times until stopped."""
    return (
        stream.writeStream.outputMode("append").format("json").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )
