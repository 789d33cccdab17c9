"""Shards of nearly equal size by sampled splitters.

Records are ordered by (text hash, doc_id, row). Splitters are quantiles of a size-weighted key sample; ranges that turn out
overfull are sampled again and subdivided, so a key that holds a third of all rows ends in several ranges. The exact bytes of
each range then place every record: shard k holds the k-th n-th part of all bytes, along the order.

Defined results: a null text counts no bytes and shares the group of the empty text; null ids sort first; repeated rows are
told apart by their row number; equal texts stay in one shard unless their group exceeds ``group_share`` of a shard; an empty
table gives no rows. Extra columns are carried only when named in ``columns``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import materialize, named

#: Bytes that every record costs besides its text.
RECORD_BYTES = 16
#: Ranges per shard, and rows per range for tables whose shards are large: the driver keeps one boundary per range.
RANGES_PER_SHARD, ROWS_PER_RANGE = 8, 1_000_000
SAMPLES_PER_RANGE = 8
#: A range above this multiple of the mean is subdivided, in at most so many rounds.
OVERFULL, ROUNDS = 1.5, 4
ORDER = ("key", "doc_id", "row")


def _weighted_sample(rows: DataFrame, n: int) -> list[tuple]:
    """``n`` composite keys drawn without replacement, with chances in proportion to size (exponential clocks)."""
    u = (F.pmod(F.xxhash64(*ORDER, F.lit(7)), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = rows.select(*ORDER, (-F.log(u) / F.col("size")).alias("clock")).orderBy("clock").limit(n)
    return sorted(((r["key"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], r["row"]) for r in drawn.toLocalIterator()))


def _splitters(sample: list[tuple], ranges: int) -> list[tuple]:
    """Quantiles of the sample. A key drawn for one boundary starts a range; drawn again, it is split inside."""
    picked = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    out, keys = set(), set()
    for k in picked:
        out.add(k if k[0] in keys else (k[0], -(1 << 63), -1))
        keys.add(k[0])
    return sorted(out)


def _range_of(splitters: list[tuple]) -> Column:
    keys = np.array([s[0] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, doc, row in batches:
            k = key.to_numpy()
            low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            inside = np.flatnonzero(low < high)  # the key is that of a boundary: compare whole keys
            if len(inside):
                d = doc.fillna(-(1 << 63)).to_numpy(dtype=np.int64) if doc.isna().any() else doc.to_numpy()
                r = row.to_numpy()
                for i in inside:
                    low[i] = bisect.bisect_right(splitters, (k[i], d[i], r[i]))
            yield pd.Series(low.astype(np.int32))

    return place(*ORDER)


def assign(docs: DataFrame, shards: int = 40, columns: tuple[str, ...] = ("doc_id",), group_share: float = 0.05) -> DataFrame:
    """``columns`` of docs(doc_id, text, ...) with size, text_crc32, shard and slot; law ``bytes``: sizes are nearly equal."""
    if "doc_id" not in columns:
        raise ValueError("doc_id orders the records and must be among the columns")
    spark = docs.sparkSession
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed, _ = materialize(
        docs.select(
            F.col("doc_id"), F.struct(*[named(c).alias(c) for c in columns if c != "doc_id"]).alias("carried") if len(columns) > 1
            else F.lit(None).cast("string").alias("carried"),
            (F.octet_length(payload) + RECORD_BYTES).cast("long").alias("size"), F.crc32(payload).alias("text_crc32"),
            F.xxhash64(payload).alias("key"), F.monotonically_increasing_id().alias("row"),
        ),
        "shard-keys",
    )
    slim = keyed.select(*ORDER, "size")
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE))
    splitters = _splitters(_weighted_sample(slim, ranges * SAMPLES_PER_RANGE), ranges)
    mean = max(1.0, total / ranges)
    for left in range(ROUNDS, -1, -1):
        binned = slim.withColumn("range", _range_of(splitters))
        stats = sorted(
            tuple(r) for r in binned.groupBy("range").agg(F.sum("size"), F.count("*")).collect()  # one row per range
        )
        over = [r for r, size, n in stats if size > OVERFULL * mean and n > 1]
        if not left or not over:
            break
        parts = sum(int(size / mean) + 1 for r, size, _ in stats if r in set(over))
        again = _weighted_sample(binned.where(F.col("range").isin(over)).drop("range"), parts * SAMPLES_PER_RANGE)
        added = set(splitters)
        for r in over:
            own = [k for k in again if bisect.bisect_right(splitters, k) == r]
            size = next(s for x, s, _ in stats if x == r)
            added.update(_splitters(own, int(size / mean) + 1) or [own[len(own) // 2]] if own else [])
        if len(added) == len(splitters):
            break
        splitters = sorted(added)

    offsets, at, first = [], 0, 0
    for r, size, n in stats:
        offsets.append((r, at, first))
        at, first = at + size, first + n
    known = F.broadcast(spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long"))  # one row per range
    placed = keyed.withColumn("range", _range_of(splitters)).join(known, "range")
    running = Window.partitionBy("range").orderBy(*ORDER)
    group = Window.partitionBy("range", "key")
    until = F.col("bytes_before") + F.col("until")
    own = until - F.col("size") / 2
    whole = F.col("group_until") - F.col("group_size") / 2 + F.col("bytes_before")
    target = max(1.0, total / shards)
    position = F.when(F.col("group_size") <= group_share * target, whole).otherwise(own)
    slots, _ = materialize(
        placed.withColumn("until", F.sum("size").over(running)).withColumn("at", F.row_number().over(running))
        .withColumn("group_size", F.sum("size").over(group)).withColumn("group_until", F.max("until").over(group))
        .select(
            "doc_id", "carried", "size", "text_crc32", (F.col("rows_before") + F.col("at") - 1).alias("index"),
            F.least(F.floor(position / target), F.lit(shards - 1)).cast("int").alias("shard"),
        ),
        "shard-slots",
    )
    firsts = F.broadcast(slots.groupBy("shard").agg(F.min("index").alias("first")))  # one row per shard
    out = slots.join(firsts, "shard").withColumn("slot", F.col("index") - F.col("first"))
    kept = ["carried.*"] if len(columns) > 1 else []
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *kept)


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """All columns of docs in one folder per shard, in slot order inside each file."""
    clash = {"size", "text_crc32", "shard", "slot"} & set(docs.columns)
    plain = docs.withColumnsRenamed({c: f"own_{c}" for c in clash})
    assign(plain, shards, tuple(plain.columns)).repartition("shard").sortWithinPartitions("shard", "slot") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
