"""Windows that survive one key holding a third of all rows.

A window partitioned by a skewed key sorts that key in one task.  The
functions here cut every key into buckets along its order column, so a hot key
spreads over as many tasks as it has buckets:

* ``running`` computes prefix sums, maxima and minima in two levels: one small
  aggregate per (key, bucket), prefixes over that, and a window per bucket.
* ``trailing_count`` and ``band_counts`` sum up what enters and leaves a
  trailing range, and copy what reaches over the end of a bucket into the next
  one, so that a range never has to look outside its bucket.
* ``keep_first`` and ``last_n`` rank rows and keep a few; the optimizer limits
  each group before the shuffle (WindowGroupLimit), so copies are dropped on
  the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_FN = {"sum": F.sum, "max": F.max, "min": F.min}
#: Aggregates of the running sum itself: its lowest or highest value so far, over the rows that meet a condition.
_OF_SUM = {"lowest_sum": F.min, "highest_sum": F.max}


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if fn in ("max", "highest_sum") else F.least(a, b)


def _plain_keys(df: DataFrame, keys: list[str]) -> dict[str, Column]:
    """Key columns that are never null, so that joins and windows need the same distribution."""
    kinds = dict(df.dtypes)

    def filler(kind: str) -> Column:
        text = "1970-01-01" if kind.startswith(("date", "timestamp")) else "false" if kind == "boolean" else "0"
        return F.lit(text).cast(kind)

    out = {f"_k{n}": F.coalesce(F.col(k), filler(kinds[k])) for n, k in enumerate(keys)}
    return out | {f"_k{n}_null": F.col(k).isNull() for n, k in enumerate(keys)}


def time_bucket(ts, seconds: int) -> Column:
    """Index of the fixed-width time slot of a timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c) / F.lit(seconds * 1000000)).cast("bigint")


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column,
    specs: dict[str, tuple],
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates over ``keys`` in ``order``.

    ``bucket`` must not decrease along ``order`` within a key.  ``specs`` maps the new column to ``(sum|max|min,
    expression)``, or to ``(lowest_sum|highest_sum, expression, condition)``: the extreme of the running sum so far, over
    the rows that meet the condition (null until one does).  With ``inclusive=False`` the current row is left out, for
    plain aggregates only.  ``order`` must be total within a key.

    A bucket is summed up by its total and, where asked, the extreme of its own running sum; prefixes over those few rows
    give what every bucket starts from.  All aggregates of a call share one shuffle of the rows.
    """
    plain = _plain_keys(df, keys)
    group = [*plain, "_bucket"]
    marked = df.withColumns({**plain, "_bucket": bucket})
    of_sum = {name: spec for name, spec in specs.items() if spec[0] in _OF_SUM}
    if of_sum and not inclusive:
        raise ValueError("extremes of running sums include the current row")

    end = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)

    def own_sums(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({f"_s_{name}": F.sum(spec[1]).over(inside) for name, spec in of_sum.items()}) if of_sum else rows
        return rows.withColumns({
            f"_m_{name}": F.when(spec[2], F.col(f"_s_{name}")) if len(spec) > 2 else F.col(f"_s_{name}") for name, spec in of_sum.items()
        }) if of_sum else rows

    totals = own_sums(marked).groupBy(*group).agg(*[
        agg for name, spec in specs.items() for agg in (
            [F.sum(spec[1]).alias(f"_t_{name}"), _OF_SUM[spec[0]](f"_m_{name}").alias(f"_e_{name}")] if spec[0] in _OF_SUM
            else [_FN[spec[0]](spec[1]).alias(f"_t_{name}")]
        )
    ])

    # One row per (key, bucket): its size follows the number of buckets, not the number of rows.
    before = Window.partitionBy(*plain).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    started = totals.withColumns({
        f"_b_{name}": (F.sum if spec[0] in _OF_SUM else _FN[spec[0]])(f"_t_{name}").over(before) for name, spec in specs.items()
    })
    for name, spec in of_sum.items():
        reached = F.coalesce(F.col(f"_b_{name}"), F.lit(0)) + F.col(f"_e_{name}")
        started = started.withColumn(f"_r_{name}", reached).withColumn(f"_x_{name}", _OF_SUM[spec[0]](f"_r_{name}").over(before))
    carried = started.select(
        *group, *[f"_b_{name}" for name in specs], *[f"_x_{name}" for name in of_sum],
    )
    joined = own_sums(marked.join(carried, group, "left"))

    def value(name: str, spec: tuple) -> Column:
        if spec[0] not in _OF_SUM:
            return _combine(spec[0], F.col(f"_b_{name}"), _FN[spec[0]](spec[1]).over(inside))
        own = F.coalesce(F.col(f"_b_{name}"), F.lit(0)) + _OF_SUM[spec[0]](f"_m_{name}").over(inside)
        return _combine(spec[0], F.col(f"_x_{name}"), own)

    return joined.select(*df.columns, *[value(name, spec).alias(name) for name, spec in specs.items()])


def trailing_count(
    df: DataFrame, key: str, seconds: int, closed: bool = True, name: str = "trailing", slots: int = 4,
) -> DataFrame:
    """Rows of the same key in the trailing ``seconds``, current row included.

    ``closed`` keeps a row exactly ``seconds`` old (``ts >= now - seconds``);
    otherwise it has just left the window (``ts > now - seconds``).

    Every row enters at its time and leaves when the window has passed it; the count is the running sum of both, so the work
    follows the rows however many of them one window holds.
    """
    width = seconds * slots
    reach = seconds * 1000000 - (0 if closed else 1)
    us = F.unix_micros("ts")
    own = time_bucket("ts", width)
    tail = us >= (own + 1) * (width * 1000000) - reach

    def step(bucket: Column, at: Column, change: int, moment: bool = False) -> Column:
        return F.struct(bucket.alias("bucket"), at.alias("us"), F.lit(change).alias("change"), F.lit(moment).alias("moment"))

    enters, left = step(own, us, 1, moment=True), us + F.lit(reach + 1)
    steps = F.when(tail, F.array(enters, step(own + 1, us, 1), step(own + 1, left, -1))).otherwise(F.array(enters, step(own, left, -1)))
    spread = (
        df.filter(F.col("ts").isNotNull()).withColumn("_step", F.explode(steps))
        .select(*[F.col(c) if c == key else F.when(F.col("_step.moment"), F.col(c)).alias(c) for c in df.columns],
                F.col("_step.bucket").alias("_bucket"), F.col("_step.us").alias("_us"), F.col("_step.change").alias("_change"),
                F.col("_step.moment").alias("_moment"))
    )
    counted = spread.withColumn(name, F.sum("_change").over(_so_far(key, "_bucket")))
    return counted.filter("_moment").drop("_bucket", "_us", "_change", "_moment")


def band_counts(moments: DataFrame, events: DataFrame, key: str, widths: dict[str, int], slots: int = 4) -> DataFrame:
    """Rows of ``moments`` with, per new column, the ``events`` of the same key in the trailing seconds (``ts > now - seconds``).

    Moments without a time or key count none. As in ``trailing_count`` an event enters once and leaves once per width.
    """
    longest = max(widths.values())
    size = longest * slots
    own = time_bucket("ts", size)
    carried = F.struct(*moments.columns)
    none = F.lit(None).cast(moments.select(carried.alias("r")).schema["r"].dataType)
    tail = F.unix_micros("ts") >= (own + 1) * (size * 1000000) - longest * 1000000
    both = moments.select(F.col(key).alias("_key"), F.unix_micros("ts").alias("_us"), own.alias("_slot"), F.lit(None).cast("int").alias("_left"),
                          carried.alias("_row"))
    # What happens to an event: 0 it enters all widths, n it leaves the n-th.
    happens = F.array(*[F.struct(F.lit(n).alias("left"), F.lit(seconds * 1000000).cast("bigint").alias("after"))
                        for n, seconds in enumerate([0, *widths.values()])])
    met = events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.unix_micros("ts").alias("_at"), F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("_slot"),
    ).select("_key", "_at", "_slot", F.explode(happens).alias("_h")).select(
        "_key", (F.col("_at") + F.col("_h.after")).alias("_us"), "_slot", F.col("_h.left").alias("_left"), none.alias("_row"),
    ).filter(F.col("_us") < (F.col("_slot") + 1) * (size * 1000000))
    w, left = _so_far("_key", "_slot"), F.col("_left")
    counted = both.unionByName(met).withColumns({
        name: F.sum(F.when(left == 0, F.lit(1)).when(left == n, F.lit(-1)).otherwise(F.lit(0))).over(w)
        for n, name in enumerate(widths, start=1)
    })
    return counted.filter(F.col("_row").isNotNull()).select("_row.*", *widths)


def _so_far(*keys: str) -> WindowSpec:
    """From the first row of the keys to all rows of the current time: a frame that only grows."""
    return Window.partitionBy(*keys).orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_n(df: DataFrame, n: int, keys: list[str], order: list) -> DataFrame:
    """First ``n`` rows per key (a top-k report or a per-source limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_n(df: DataFrame, n: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` rows, overall or per key."""
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    return first_n(df, n, keys, newest)
