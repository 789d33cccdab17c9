"""Alert cooldown: emit when enough time has passed since the last emitted one.

This is a true fold: whether an alert goes out depends on the last one that
did.  Folding a key row by row would put the whole key in one task, so the
chain of emitted alerts is found by pointer doubling instead.  Every alert
points to the first alert of its key at least one cooldown later.  The chain
starts at the alerts that have no other alert within the cooldown before them
and doubles its reach in every round, so the number of rounds grows with the
logarithm of the longest chain and each round is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.session import drop_path, materialize


def _pointers(times: DataFrame, cooldown_us: int) -> DataFrame:
    """Add ``nxt`` (first time at least one cooldown later) and ``head``.

    Slots are one cooldown wide.  The target of a time in slot ``s`` is in
    slot ``s + 1`` if that slot holds a late enough time, else it is the first
    time of the next filled slot after that.  Each slot is looked at with a
    window of its own, so a hot key is spread over its slots.
    """
    slotted = times.withColumn("slot", F.floor(F.col("us") / cooldown_us).cast("bigint"))
    # Probes sit at us + cooldown in the following slot; later times of that
    # slot are visible to them in descending order.
    probes = slotted.select(
        "key", (F.col("slot") + 1).alias("slot"), (F.col("us") + cooldown_us).alias("at"),
        F.col("us"), F.lit(1).alias("probe"),
    )
    marks = slotted.select("key", "slot", F.col("us").alias("at"), "us", F.lit(0).alias("probe"))
    down = Window.partitionBy("key", "slot").orderBy(F.col("at").desc(), "probe")
    near = (
        marks.unionByName(probes)
        .withColumn("near", F.min(F.when(F.col("probe") == 0, F.col("at"))).over(
            down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ))
        .filter(F.col("probe") == 1)
        .select("key", (F.col("slot") - 1).alias("slot"), "us", "near")
    )
    # First filled slot at or after slot + 2, from one row per (key, slot).
    filled = slotted.groupBy("key", "slot").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    ordered = Window.partitionBy("key").orderBy("slot")
    summary = filled.select(
        "key", "slot",
        F.lead("slot", 1).over(ordered).alias("s1"), F.lead("first_us", 1).over(ordered).alias("f1"),
        F.lead("first_us", 2).over(ordered).alias("f2"), F.lag("last_us", 1).over(ordered).alias("prev_last"),
    ).withColumn("far", F.when(F.col("s1") == F.col("slot") + 1, F.col("f2")).otherwise(F.col("f1")))
    before = Window.partitionBy("key", "slot").orderBy("us")
    return (
        near.join(summary.select("key", "slot", "far", "prev_last"), ["key", "slot"], "left")
        .withColumn("prev", F.coalesce(F.lag("us").over(before), F.col("prev_last")))
        .select(
            "key", "us", F.coalesce("near", "far").alias("nxt"),
            (F.col("prev").isNull() | (F.col("us") - F.col("prev") >= cooldown_us)).alias("head"),
        )
    )


def suppress_cooldown(alerts: DataFrame, minutes: int = K.ALERT_COOLDOWN_MINUTES) -> DataFrame:
    """Alerts that go out.  ``alerts`` holds (channel, severity, ts, event_id)."""
    spark = alerts.sparkSession
    cooldown_us = minutes * 60 * 1000000
    keyed = alerts.withColumn("key", F.concat_ws(":", "channel", "severity")).withColumn("us", F.unix_micros("ts"))
    times = keyed.select("key", "us").distinct()
    links, links_path = materialize(_pointers(times, cooldown_us), "cooldown-links")
    # A link into a head adds nothing, so chains end where a quiet spell ends
    # them: the rounds depend on the longest busy spell, not on the history.
    heads = links.filter("head").select("key", F.col("us").alias("nxt"), F.lit(True).alias("_to_head"))
    chain, path = materialize(links.join(heads, ["key", "nxt"], "left").select(
        "key", "us", F.when(F.col("_to_head").isNull(), F.col("nxt")).alias("nxt"), F.col("head").alias("sent")
    ), "cooldown-chain")
    drop_path(spark, links_path)

    while not chain.filter(F.col("nxt").isNotNull()).isEmpty():
        # ``sent`` covers the chain positions below 2^k and ``nxt`` leaps 2^k
        # links: one round doubles both.
        landed = chain.filter(F.col("sent") & F.col("nxt").isNotNull()).select(
            "key", F.col("nxt").alias("us"), F.lit(True).alias("_landed")
        ).distinct()
        onward = chain.select("key", F.col("us").alias("nxt"), F.col("nxt").alias("_far"))
        doubled = (
            chain.join(onward, ["key", "nxt"], "left")
            .join(landed, ["key", "us"], "left")
            .select("key", "us", F.col("_far").alias("nxt"), (F.col("sent") | F.col("_landed").isNotNull()).alias("sent"))
        )
        used = path
        chain, path = materialize(doubled, "cooldown-chain")
        drop_path(spark, used)

    first = keyed.join(chain.filter("sent").select("key", "us"), ["key", "us"], "left_semi")
    w = Window.partitionBy("key", "us").orderBy("event_id")
    return (
        first.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "us")
    )

