"""Sinks, archives and reports written to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from postlake.functions.hashing import hash16
from postlake.operators import lifecycle
from postlake.plans import jobs
from postlake.plans import views as V
from postlake.plans.registry import query
from postlake.plans.storage_queries import SQL_CACHE, SQL_COST, SQL_PLAN, cache_view
from postlake.session import scratch_path
from postlake.sources import tables
from postlake.sources.tables import read_table
from postlake.streaming import streams


def _stored(spark, sf):
    """Documents as stored rows of 30 days, with the text's own line breaks and quotes."""
    at = F.lit(V.AS_OF).cast("timestamp") - F.make_dt_interval(days=(F.col("doc_id") % 30).cast("int"))
    return read_table(spark, sf, "documents").select(
        "doc_id", "text", hash16(F.col("doc_id").cast("string")).alias("fingerprint"), at.alias("scraped_at")
    )


_SQL_STORED = f"""stored AS (SELECT doc_id, text, TIMESTAMP '{V.AS_OF}' - to_days(CAST(doc_id % 30 AS INTEGER)) AS scraped_at FROM documents)"""


@query(
    "dataset_round_trip",
    f"WITH {_SQL_STORED} SELECT strftime(scraped_at, '%Y-%m-%d') AS day, doc_id, sha256(text) AS text_hash FROM stored",
)
def dataset_round_trip(spark, sf):
    path = scratch_path(spark, "dataset")
    tables.write_dataset(_stored(spark, sf), path)
    return spark.read.parquet(path).select(
        F.date_format("scraped_date", "yyyy-MM-dd").alias("day"), "doc_id", F.sha2("text", 256).alias("text_hash")
    )


@query(
    "shard_scan",
    """SELECT CAST(doc_id % 7 AS BIGINT) AS shard, count(*) AS record_count FROM documents GROUP BY 1
    UNION ALL SELECT 99, 0""",
)
def shard_scan(spark, sf):
    """One folder per shard, one of them without any line; files of a shard add up."""
    path = scratch_path(spark, "shards")
    docs = read_table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("shard"), F.to_json(F.struct("doc_id", "lang")).alias("value"))
    docs.write.partitionBy("shard").text(path)
    spark.createDataFrame([("",)], "value string").coalesce(1).write.option("lineSep", " ").text(f"{path}/shard=99")
    return (
        tables.scan_shards(spark, f"{path}/*/*.txt").withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint"))
        .groupBy("shard").agg(F.sum("record_count").alias("record_count"))
    )


@query("csv_round_trip", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    tables.export_csv(_stored(spark, sf).select("doc_id", "text"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("doc_id long, text string").csv(path)
    return back.select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(
    "archive_twice",
    f"""WITH {_SQL_STORED} SELECT doc_id, strftime(scraped_at, '%Y-%m-%d') AS day FROM stored
      WHERE scraped_at <= TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY""",
)
def archive_twice(spark, sf):
    """The same hot table archived twice, as after a run that failed before its hand-over: every row is there once."""
    root, hot = scratch_path(spark, "archive"), _stored(spark, sf)
    for _ in range(2):
        lifecycle.archive(hot, root, V.AS_OF)
    back = spark.read.schema("doc_id long, year string, month string, day string").json(root)
    return back.select("doc_id", F.concat_ws("-", "year", "month", "day").alias("day"))


@query("report_round_trip", "SELECT lang, source, count(*) AS documents FROM documents GROUP BY ALL")
def report_round_trip(spark, sf):
    path = scratch_path(spark, "report")
    tables.write_report(read_table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")), path)
    return spark.read.schema("lang string, source string, documents long").json(path)


@query(
    "run_log_round_trip",
    """SELECT event_id, epoch_us(ts) AS ts_us, event_type AS event FROM events WHERE event_id % 10 <> 0
    UNION ALL SELECT event_id, epoch_us(ts), 'last' FROM events WHERE event_id % 10 = 0""",
)
def run_log_round_trip(spark, sf):
    """Log lines with own fields; every tenth names its event twice, and broken lines stand between them."""
    path = scratch_path(spark, "log")
    rows = read_table(spark, sf, "events").select(
        "event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), "event_type"
    )
    name = F.when(F.col("event_id") % 10 == 0, F.lit('"old","event":"last"')).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    line = F.concat(F.lit('{"timestamp":"'), "at", F.lit('","event":'), name, F.lit(',"event_id":'), F.col("event_id").cast("string"), F.lit("}"))
    rows.select(F.explode(F.array(line, F.lit("{broken"))).alias("value")).write.text(path)
    return tables.read_run_log(spark, path).select(
        F.try_variant_get(F.try_element_at("extra", F.lit("event_id")), "$", "bigint").alias("event_id"), F.unix_micros("ts").alias("ts_us"),
        F.try_variant_get(F.try_element_at("extra", F.lit("event")), "$", "string").alias("event"),
    )


@query("stream_snapshots", "SELECT event_id, event_type FROM events")
def stream_snapshots(spark, sf):
    out, progress = scratch_path(spark, "snapshots"), scratch_path(spark, "snapshots-progress")
    running = streams.start_snapshots(read_table(spark, sf, "events", stream=True).select("event_id", "event_type"), out, progress, every="1 second")
    running.processAllAvailable()
    running.stop()
    return spark.read.schema("event_id long, event_type string").json(out)


_OLD = f"mtime <= TIMESTAMP '{V.STORAGE_AS_OF}' - INTERVAL 7 DAY"
_SUMS = "count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes"


@query(
    "lifecycle_outputs",
    f"""WITH {SQL_PLAN}, old AS (SELECT *, strftime(mtime, '%Y-%m-%d') AS old_day FROM v_shards WHERE {_OLD})
    SELECT 'manifest' AS output, old_day AS name, {_SUMS} FROM old GROUP BY old_day
    UNION ALL SELECT 'manifest_files', 'all', {_SUMS} FROM old
    UNION ALL SELECT 'pending_uploads', archive_path, {_SUMS} FROM wm WHERE uploaded_at IS NULL GROUP BY archive_path
    UNION ALL SELECT 'cleanup_plan', action, {_SUMS} FROM plan GROUP BY action
    UNION ALL SELECT 'cleanup_outcome', 'deleted', {_SUMS} FROM plan WHERE action = 'delete'
    UNION ALL SELECT 'usage', 'hot', {_SUMS} FROM v_shards WHERE NOT ({_OLD})
    UNION ALL SELECT 'usage', 'warm', {_SUMS} FROM plan WHERE action <> 'delete'""",
)
def lifecycle_outputs(spark, sf):
    """All six outputs of one maintenance cycle over the order files, summed up by name."""
    out = jobs.lifecycle_cycle(V.v_shards(spark, sf), *V.v_archives(spark, sf), V.STORAGE_AS_OF)

    def summed(name, rows, label, size="size_bytes"):
        sums = rows.groupBy(label.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))
        return sums.select(F.lit(name).alias("output"), "name", "n", "bytes")

    manifest = out["manifest"].select(
        F.lit("manifest").alias("output"), F.col("day").alias("name"), F.col("shards").alias("n"), F.col("total_original_bytes").alias("bytes")
    )
    outcome = out["cleanup_outcome"].select(
        F.lit("cleanup_outcome").alias("output"), F.lit("deleted").alias("name"), F.col("deleted").alias("n"), F.col("freed_bytes").alias("bytes")
    )
    usage = out["usage"].filter("tier <> 'total'").select(
        F.lit("usage").alias("output"), F.col("tier").alias("name"), F.col("files").alias("n"), F.col("size_bytes").alias("bytes")
    )
    parts = [
        manifest, summed("manifest_files", out["manifest_files"], F.lit("all")),
        summed("pending_uploads", out["pending_uploads"], F.col("archive_path")), summed("cleanup_plan", out["cleanup_plan"], F.col("action")),
        outcome, usage,
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "registered_source",
    f"""SELECT doc_id AS seq, 'Job ' || doc_id AS title, 'Firm ' || source AS company, 'registered' AS source FROM documents""",
)
def registered_source(spark, sf):
    """A source of one's own: registered, run over payloads and brought to the listing columns."""
    if "registered" not in tables.registered_sources():
        tables.register_source("registered", lambda payloads: payloads.select(
            F.concat(F.lit("Job "), "number").alias("title"), F.concat(F.lit("Firm "), "board").alias("company"),
            F.col("body").alias("description"), F.concat(F.lit("https://r.example.com/"), "number").alias("url"),
            F.lit("registered").alias("source"),
        ))
    payloads = read_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("number"), F.col("source").alias("board"), F.col("text").alias("body")
    )
    rows = tables.run_source("registered", payloads)
    return rows.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("seq"), "title", "company", "source")


@query(
    "daily_costs",
    f"""WITH {SQL_COST}, {SQL_CACHE} SELECT 'spend' AS part, provider AS name, count(*) AS n, count(*) FILTER (cost_usd >= 1.0) AS over_limit
      FROM led GROUP BY provider UNION ALL SELECT 'cache', 'entries', count(*), 0 FROM cache""",
)
def daily_costs(spark, sf):
    """Both parts of the daily report: days and days over the limit per provider, and the size of the cache."""
    out = jobs.daily_cost_report(V.v_ledger(spark, sf), cache_view(spark, sf))
    spend = out["spend"].groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count_if("exceeded").alias("over_limit"))
    return spend.select(F.lit("spend").alias("part"), F.col("provider").alias("name"), "n", "over_limit").unionByName(
        out["cache"].select(F.lit("cache").alias("part"), F.lit("entries").alias("name"), F.col("entries").alias("n"), F.lit(0).cast("long").alias("over_limit"))
    )
