"""The stored listing table: insert rows whose fingerprint is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schema
from postlake.functions.hashing import row_fingerprint
from postlake.functions.scalars import ts_literal
from postlake.operators.running import keep_first
from postlake.session import drop_path, materialize, path_exists, scratch_path

#: Characters of a hash that name its folder: 16 folders by default, more for a large table with small batches.
PREFIX_CHARS = 1


def to_stored(df: DataFrame, as_of) -> DataFrame:
    """Stored columns with their defaults, fingerprint and dates."""

    def have(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    filled = df.withColumns({
        "platform": F.coalesce(have("platform"), have("source"), F.lit("unknown")),
        "source": F.coalesce(have("source"), have("platform"), F.lit("unknown")),
        "company": F.coalesce(have("company"), F.lit("Unknown Company")),
        "fingerprint": row_fingerprint(),
        "created_at": ts_literal(as_of),
        "scraped_date": F.to_date("scraped_at"),
    })
    return filled.select(*[
        (F.col(f.name) if f.name in filled.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.STORED_LISTING
    ], *[c for c in filled.columns if c == "seq"])


def new_rows(rows: DataFrame, target: DataFrame | None, order: list) -> DataFrame:
    """Rows to insert: first per fingerprint, absent from the target."""
    first = keep_first(rows, ["fingerprint"], order)
    if target is None:
        return first
    return first.join(target.select("fingerprint"), "fingerprint", "left_anti")


def insert_counts(rows: DataFrame, inserted: DataFrame) -> DataFrame:
    """Offered, inserted and skipped-on-conflict rows."""
    offered = rows.select(F.lit(1).alias("offered"), F.lit(0).alias("inserted"))
    took = inserted.select(F.lit(0).alias("offered"), F.lit(1).alias("inserted"))
    return offered.unionByName(took).agg(
        F.coalesce(F.sum("offered"), F.lit(0)).cast("bigint").alias("offered"),
        F.coalesce(F.sum("inserted"), F.lit(0)).cast("bigint").alias("inserted"),
    ).withColumn("conflict_skipped", F.col("offered") - F.col("inserted"))


def upsert_jobs(rows: DataFrame, target_path: str, order: list, chars: int = PREFIX_CHARS) -> DataFrame:
    """Append new rows to the table at ``target_path`` and return them as read back.

    The target is laid out by date and by the first ``chars`` characters of the fingerprint, which are known from the row alone:
    the anti-join reads the folders of the prefixes that the batch holds, and of those the fingerprints only. A table has one
    ``chars`` for good; rows of a table without prefixes are all looked at.

    The offered rows are written before the anti-join and the insert set after it, so that neither a lost executor nor a second
    action evaluates the anti-join against the grown table.
    """
    spark = rows.sparkSession
    offered, offered_path = materialize(keep_first(rows, ["fingerprint"], order).drop("seq"), "offered")
    staged = scratch_path(spark, "insert")
    fresh = offered
    if path_exists(spark, target_path):
        there = touched(_stored(spark, target_path), "prefix", held_prefixes(offered, "fingerprint", chars))
        fresh = offered.join(there.select("fingerprint"), "fingerprint", "left_anti").select(*offered.columns)
    fresh.write.parquet(staged)
    fresh = spark.read.schema(schema.STORED_LISTING).parquet(staged)
    # Rebalancing splits a heavy day over several files and merges light ones.
    fresh.withColumn("prefix", F.substring("fingerprint", 1, chars)).hint("rebalance", "scraped_date", "prefix") \
        .write.mode("append").partitionBy("scraped_date", "prefix").parquet(target_path)
    drop_path(spark, offered_path)
    return fresh


def held_prefixes(df: DataFrame, column: str, chars: int) -> list[str]:
    """The prefixes of a hash column that occur: at most 16 to the power of ``chars``."""
    return [r[0] for r in df.select(F.substring(column, 1, chars)).distinct().collect()]


def touched(table: DataFrame, prefix: str, held: list[str]) -> DataFrame:
    """The partitions of ``held`` prefixes, and those without one."""
    return table.filter(F.col(prefix).isin(held) | F.col(prefix).isNull())


def _stored(spark, target_path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.STORED_LISTING.fields, T.StructField("prefix", T.StringType())])).parquet(target_path)


def read_jobs(spark, target_path: str) -> DataFrame:
    """The stored table; an absent one reads as empty, absent columns as null."""
    if not path_exists(spark, target_path):
        return spark.createDataFrame([], schema.STORED_LISTING)
    return _stored(spark, target_path).drop("prefix")


def count_jobs(target: DataFrame) -> DataFrame:
    return target.agg(F.count(F.lit(1)).alias("jobs"))
