"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.session import drop_path, materialize, scratch_path

__all__ = [
    "connected_components", "crc32_bucket", "drop_path", "encoded", "materialize", "maybe_among", "named", "read", "run_starts",
    "scratch_path", "whole_runs", "words",
]

#: Size of a bitmap of hashes; beyond a quarter of it the bitmap would pass nearly every row and is not made.
BITMAP_BITS = 1 << 26


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{column.replace('`', '``')}`")


def crc32_bucket(column: str, modulus: int) -> Column:
    """crc32 of a column written as text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: ``bytes`` methods know ASCII only."""
    return text.lower().split()


def encoded(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column one by one; null gives the empty text."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from encoded(chunk)
        return
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for cell in column.cast(kind):
        yield cell.as_py() or b""


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions where any of the sorted keys changes, the first row included."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def whole_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables that end where a key ends; the input is sorted by the keys.

    Only the last, possibly unfinished run of a batch is held back, so memory is one batch plus one run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = run_starts(*(batch.column(k).to_numpy(zero_copy_only=False) for k in keys))
        last = int(starts[-1])
        if held:
            before = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            if before != [batch.column(k)[0].as_py() for k in keys]:
                yield pa.Table.from_batches(held)
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def maybe_among(keys: DataFrame, column: str) -> Callable[[str], Column]:
    """A test on a 64-bit hash column: true for every hash among ``keys``, and for few others.

    It spares a join the rows that cannot match; the join still decides. The bitmap has at most BITMAP_BITS bits, so what
    the tasks receive is bounded; with too many keys for it the test is true everywhere, and all rows take the join.
    """
    n = keys.count()
    if n > BITMAP_BITS // 4:
        return lambda _: F.lit(True)
    bits = min(BITMAP_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    bit = F.pmod(F.col(column), F.lit(bits))
    cells = (
        keys.select(F.floor(bit / 64).cast("int").alias("cell"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
        .groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set")).toArrow()  # at most BITMAP_BITS / 64 rows
    )
    bitmap = np.zeros(bits // 64, dtype=np.uint64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("set").to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def among(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            at = h.to_numpy().view(np.uint64) & np.uint64(bits - 1)
            yield pd.Series((shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0)

    return among


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of an undirected graph given as distinct ``a``, ``b`` of bigint: component is the smallest node reachable.

    Alternating large-star and small-star steps on written tables. Each step is one or two keyed aggregations with map-side
    minima, so a hub costs no more than its edges; the number of steps grows with the logarithm of the longest path.
    Nodes without an edge do not appear. Nothing but two counts goes to the driver.
    """
    spark = edges.sparkSession
    current, path = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    before = None
    while True:
        # large star: every neighbour above u joins the smallest node of u's neighbourhood
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its lower neighbours join the lowest of them; what repeats in the large star goes here
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        done, done_path = materialize(small, label)
        drop_path(spark, path)
        current, path = done, done_path
        # the state is a fixed point once every node hangs on one root and no root hangs on another
        state = current.agg(
            F.count("*").alias("n"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if before is not None and tuple(state) == before:
            break
        before = tuple(state)
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
