"""Storage lifecycle: manifests, archives, upload selection, cleanup, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.scalars import age_days, age_days_rounded, day_key, human_size
from postlake.session import path_exists, scratch_path


def split_by_age(shards: DataFrame, as_of, days: int = K.ARCHIVE_AFTER_DAYS) -> tuple[DataFrame, DataFrame]:
    """(old enough to archive, too recent)."""
    old = age_days("mtime", as_of) >= days
    return shards.filter(old), shards.filter(~old)


def manifest(shards: DataFrame) -> DataFrame:
    """Totals per day.  The file list is its own table, see ``manifest_files``:
    nesting it would put a whole day into one row."""
    return shards.groupBy(day_key("mtime").alias("day")).agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("record_count").cast("bigint").alias("total_records"),
        F.sum("size_bytes").cast("bigint").alias("total_original_bytes"),
        F.min("shard").alias("first_shard"),
        F.max("shard").alias("last_shard"),
    ).withColumn("archive_path", archive_path(F.col("day"), F.col("first_shard"), F.col("last_shard")))


def archive_path(day: Column, first: Column, last: Column) -> Column:
    return F.concat(
        F.lit("archives/"), F.substring(day, 1, 4), F.lit("/"), F.substring(day, 6, 2), F.lit("/"),
        day, F.lit("_jobs_"), first, F.lit("-"), last, F.lit(".tar.gz"),
    )


def manifest_files(shards: DataFrame) -> DataFrame:
    """One row per archived file, keyed by day."""
    return shards.select(day_key("mtime").alias("day"), "shard", "size_bytes", "record_count", "mtime")


def compression_ratio(archive_bytes: Column, original_bytes: Column) -> Column:
    return F.format_string("%.1f%%", (F.lit(1.0) - archive_bytes / original_bytes) * 100)


def inventory(archives: DataFrame) -> DataFrame:
    """One line per archive plus the grand total (archive is then ``TOTAL``)."""
    return (
        archives.groupBy("archive", "total_records", "archive_size_bytes")
        .agg(F.count(F.lit(1)).alias("archives"))
        .rollup("archive")
        .agg(
            F.sum(F.col("total_records") * F.col("archives")).cast("bigint").alias("total_records"),
            F.sum(F.col("archive_size_bytes") * F.col("archives")).cast("bigint").alias("size_bytes"),
            F.sum("archives").cast("bigint").alias("archives"),
            F.grouping_id().alias("_g"),
        )
        .select(
            F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("archive")).alias("archive"),
            "total_records", "size_bytes", "archives", human_size("size_bytes").alias("size_text"),
        )
    )


def with_manifest(archives: DataFrame, manifests: DataFrame) -> DataFrame:
    """Archives with their manifest facts; none means 0 records, not uploaded."""
    return archives.join(
        manifests.select("archive_path", "total_records", "uploaded_at"), "archive_path", "left"
    ).withColumn("total_records", F.coalesce("total_records", F.lit(0)).cast("bigint"))


def pending_uploads(archives: DataFrame, manifests: DataFrame) -> DataFrame:
    return with_manifest(archives, manifests).filter(F.col("uploaded_at").isNull())


def cleanup_plan(
    archives: DataFrame, manifests: DataFrame, as_of, days: int = K.DELETE_AFTER_DAYS, guard: bool = False,
) -> DataFrame:
    """Action per archive: keep, skip until uploaded, or delete."""
    age = age_days_rounded("mtime", as_of)
    not_uploaded = F.lit(guard) & F.col("uploaded_at").isNull()
    return (
        with_manifest(archives, manifests)
        .withColumn("age_days", age)
        .withColumn(
            "action",
            F.when(F.col("age_days") < days, F.lit("keep"))
            .when(not_uploaded, F.lit("not_uploaded"))
            .otherwise(F.lit("delete")),
        )
    )


def oldest_first(plan: DataFrame) -> DataFrame:
    return plan.orderBy(F.col("age_days").desc(), "archive_path")


def cleanup_outcome(plan: DataFrame) -> DataFrame:
    freed = F.sum(F.when(F.col("action") == "delete", F.col("size_bytes")))
    return plan.agg(
        F.count_if(F.col("action") == "delete").alias("deleted"),
        F.count_if(F.col("action") == "keep").alias("kept_by_age"),
        F.count_if(F.col("action") == "not_uploaded").alias("kept_by_upload"),
        F.coalesce(freed, F.lit(0)).cast("bigint").alias("freed_bytes"),
    )


def storage_usage(files: DataFrame) -> DataFrame:
    """Bytes and files per tier and in total."""
    return files.rollup("tier").agg(
        F.sum("size_bytes").cast("bigint").alias("size_bytes"),
        F.count(F.lit(1)).alias("files"),
        F.grouping_id().alias("_g"),
    ).select(
        F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col("tier")).alias("tier"), "size_bytes", "files",
    )


def archive(
    hot: DataFrame, archive_root: str, as_of, days: int = K.ARCHIVE_AFTER_DAYS, dry_run: bool = False, key: str = "fingerprint",
) -> dict:
    """Move old rows of the hot table to gzip day partitions.

    ``hot`` holds ``scraped_at`` and ``key``.  The archive is written first; only
    after it succeeded does the caller get the remaining hot rows, written to a
    new folder to swap in.  A row whose key its day already holds is not written
    again, so a run that is repeated after a failure adds nothing twice.
    Returns the counts and that folder.
    """
    aged = hot.withColumn("_old", age_days("scraped_at", as_of) >= days)
    counts = aged.agg(
        F.count_if("_old").alias("archived"), F.count_if(~F.col("_old")).alias("kept")
    ).first()
    result = {"archived": counts["archived"], "kept": counts["kept"], "hot_path": None}
    if dry_run or counts["archived"] == 0:
        return result
    old = aged.filter("_old").drop("_old").withColumns({
        "year": F.date_format("scraped_at", "yyyy"),
        "month": F.date_format("scraped_at", "MM"),
        "day": F.date_format("scraped_at", "dd"),
    })
    spark = hot.sparkSession
    parts = ["year", "month", "day"]
    if path_exists(spark, archive_root):
        there = spark.read.schema(f"{key} string, year string, month string, day string").option("recursiveFileLookup", False).json(archive_root)
        touched = old.select(*parts).distinct()
        old = old.join(there.join(touched, parts, "left_semi").select(key, *parts), [key, *parts], "left_anti")
    by_day = old.hint("rebalance", "year", "month", "day")
    by_day.write.mode("append").partitionBy("year", "month", "day").option("compression", "gzip").json(archive_root)
    result["hot_path"] = scratch_path(hot.sparkSession, "hot")
    aged.filter(~F.col("_old")).drop("_old").write.parquet(result["hot_path"])
    return result

