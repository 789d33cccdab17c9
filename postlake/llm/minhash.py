"""Near-duplicate documents with an LSH forest.

Every distinct shingle set gets one MinHash signature. A tree of the forest is one fixed order of the signature's positions;
sorting by that order puts sets with a long common prefix side by side. A region is a maximal run that shares a prefix; its
members are candidates of each other, the full signatures weed them out, and what is left is confirmed on the full shingle
sets, read from the whole texts. A pair at the threshold that passes the signature test shares no region with a chance of at
most ``MISS``.

Depth adapts to the region. A small region is compared as it is. A crowded one is sorted on by the positions that follow its
prefix and cut into chunks of neighbours with the longest common prefixes; the links found there join most of its members. A
region that then lies in one component is finished: components are asked for, not pairs. What is left open are pairs of
different components. At the threshold such a pair shares one of the rarest shingles of each side, a few in a hundred of them,
where shingles that lie in one component only come first and can match nothing. Only sets that share one of those meet again.
This last step is exact, and its rows follow the open sets' own sizes, not the pairs of a region.

No stage emits pairs: a region returns one row per member with its partners, a verified region returns a spanning forest of
its links. Regions with equal members are compared once, and a pair is passed on only by the first small region that holds it.

Defined results: words are what lies between ASCII white space, A-Z in lower case; texts without words (null and empty ones
too) have an empty set and link with nothing; shorter texts than a shingle form one shingle; repeated rows fall into one
class; a null doc_id never is a component's smallest id unless it stands alone; empty tables give no rows. Extra columns are
ignored by ``components`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import connected_components, drop_path, encoded, materialize, maybe_among, run_starts, whole_runs, words

SHINGLE = 5
#: Positions of a signature, one byte each; least and most trees, and the prefix that makes a region; a threshold so low that
#: it needs more trees gets the most.
POSITIONS, TREES, MOST_TREES, DEPTH = 512, 32, 512, 5
#: Positions after the prefix by which crowded regions are sorted on, and the trees whose crowded regions are.
FURTHER, SORTED_TREES = 12, 8
#: Chance that a pair at the threshold may have to share no region.
MISS = 1e-6
#: Members of a region that are compared in one step.
REGION = 256
#: Shingles before its own that a row of an open set carries, to tell pairs that meet under an earlier one.
WINDOW = 32
#: Most shingles that are handed to every task with their counts: those that more than 1 / FREQUENT of all shingles are.
FREQUENT = 1 << 17
#: Standard deviations by which an estimate may miss the threshold before the pair is given up.
MARGIN = 4.5
_RNG = np.random.default_rng(20240607)
_FACTORS = _RNG.integers(1, 1 << 32, POSITIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ORDERS = np.stack([_RNG.permutation(POSITIONS)[: DEPTH + FURTHER] for _ in range(MOST_TREES)])
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    own = words(text)
    n = len(own)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, own), dtype=np.uint64, count=n)
    size = min(SHINGLE, n)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = total * _P + h[k : n - size + 1 + k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray, buffer: np.ndarray) -> bytes:
    """The low-order byte of each position's smallest value."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(x), _CHUNK):
        part = x[s : s + _CHUNK]
        product = np.multiply(part[:, None], _FACTORS[None, :], out=buffer[: len(part)])
        np.minimum(least, product.min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d1, d2, signature) per row; d1 and d2 are a 128-bit digest of the shingle set."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = np.empty((_CHUNK, POSITIONS), dtype=np.uint32)
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in encoded(batch.column("text")):
                s = shingles(text)
                sizes.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                signatures.append(signature(s, buffer) if len(s) else b"")
            d = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 pa.array(signatures, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "d1", "d2", "signature"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, signature binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)


def _least(percent: int) -> float:
    """Equal positions from which a pair may reach the threshold."""
    level = percent / 100
    return POSITIONS * (level - MARGIN * np.sqrt(level * (1 - level) / POSITIONS))


def trees(percent: int) -> int:
    """The fewest trees that keep a pair at the threshold but for a chance of MISS.

    The chance is over how many positions such a pair has in common and over the positions a tree happens to begin with.
    """
    level, m = percent / 100, np.arange(POSITIONS + 1)
    if not 0 < level < 1:
        return TREES if level else MOST_TREES
    ways = np.array([lgamma(POSITIONS + 1) - lgamma(k + 1) - lgamma(POSITIONS - k + 1) for k in m])
    chance = np.where(m >= _least(percent), np.exp(ways + m * np.log(level) + (POSITIONS - m) * np.log(1 - level)), 0.0)
    shared = np.prod([np.maximum(m - k, 0) / (POSITIONS - k) for k in range(DEPTH)], axis=0)
    return next((t for t in range(TREES, MOST_TREES) if (chance * (1 - shared) ** t).sum() <= MISS), MOST_TREES)


def _prefix_keys(signatures: np.ndarray, tree: int) -> np.ndarray:
    picked = signatures[:, _ORDERS[tree, :DEPTH]].astype(np.uint64)
    key = np.full(len(signatures), tree, dtype=np.uint64)
    for k in range(DEPTH):
        key = _mix(key * _P + picked[:, k] + np.uint64(1))
    return key.view(np.int64)


def _keys(rows: DataFrame, n_trees: int) -> DataFrame:
    """(cls, slot, key) in every tree; slot: the tree's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix, cls = _matrix(batch.column("signature")), pa.array(batch.column("cls").to_numpy())
            for t in range(n_trees):
                yield pa.RecordBatch.from_arrays(
                    [cls, pa.array(np.full(len(cls), t, dtype=np.int32)), pa.array(_prefix_keys(matrix, t))], ["cls", "slot", "key"]
                )

    return rows.mapInArrow(run, "cls long, slot int, key long")


def _regions(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(cls, slot, key) of the small regions and of the crowded ones, regions of one left out; and the paths of their tables."""
    level, keys_path = materialize(_keys(classes.select("cls", "signature"), trees(percent)), "forest-keys")
    counts, path = materialize(
        level.groupBy("key").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"),
            F.sum(F.shiftrightunsigned(F.xxhash64("cls", F.lit(1)), 24)).alias("s"),
        ).where("n > 1").groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"), "forest-regions",
    )

    def of(keys: DataFrame) -> DataFrame:
        # nearly all prefixes belong to one class: rows of the others are told by a bitmap before anything is shuffled
        return level.where(maybe_among(keys, "key")("key")).join(keys, "key").select("cls", "slot", "key")

    crowded, crowded_path = materialize(of(counts.where(F.col("n") > REGION).select("key")), "forest-crowded")
    return of(counts.where(F.col("n") <= REGION).select("key")), crowded, [keys_path, path, crowded_path]


def _signatures_of(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The classes that ``rows`` name by ``cls``; most others are told before the join by a bitmap."""
    rows, _ = materialize(rows, "forest-named")
    among = maybe_among(rows.select(F.xxhash64("cls").alias("h")), "h")
    return classes.withColumn("h", F.xxhash64("cls")).where(among("h")).join(rows, "cls")


def _members(held: DataFrame, regions: DataFrame, n_trees: int) -> DataFrame:
    """(unit, slot, cls, n_shingles, signature, compared): one row per class and region; ``compared`` has a bit for every tree
    where a region of the class is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            entries = batch.column("entries")
            flat = entries.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(entries.offsets.to_numpy()))
            compared = np.zeros((batch.num_rows, n_trees), dtype=bool)
            compared[row, flat.field("slot").to_numpy()] = True
            packed = pa.array([k.tobytes() for k in np.packbits(compared, axis=1)], pa.binary())
            for s in range(0, len(row), _CHUNK):
                part, at = flat.slice(s, _CHUNK), pa.array(row[s : s + _CHUNK])
                yield pa.RecordBatch.from_arrays(
                    [part.field("key"), part.field("slot"), batch.column("cls").take(at),
                     batch.column("n_shingles").take(at), batch.column("signature").take(at), packed.take(at)],
                    ["unit", "slot", "cls", "n_shingles", "signature", "compared"],
                )

    entries = regions.groupBy("cls").agg(F.collect_list(F.struct("slot", "key")).alias("entries"))  # one per tree at most
    joined = entries.join(held, "cls")
    return joined.select("cls", "entries", "n_shingles", "signature").mapInArrow(
        run, "unit long, slot int, cls long, n_shingles long, signature binary, compared binary"
    )


class _Lists:
    """Rows (unit, cls, partners) under way: a row for every class that is on either side of a pair."""

    SCHEMA = "unit long, cls long, partners array<long>"

    def __init__(self) -> None:
        self.rows: tuple[list, list, list] = ([], [], [])
        self.own: dict[int, list[int]] = {}

    def add(self, one: int, others: list[int]) -> None:
        self.own.setdefault(one, []).extend(others)
        for other in others:
            self.own.setdefault(other, [])

    def close(self, unit: int) -> None:
        for cls, partners in self.own.items():
            for column, value in zip(self.rows, (unit, cls, partners)):
                column.append(value)
        self.own = {}

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int64()))],
            ["unit", "cls", "partners"],
        )


def _near(matrix: np.ndarray, n: np.ndarray, i: int, others: slice | np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` come near the threshold with row ``i`` by signature and size."""
    same = np.count_nonzero(matrix[others] == matrix[i], axis=1)
    low, high = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
    return np.flatnonzero((same >= _least(percent)) & (100 * low >= percent * high))


def _partners(members: DataFrame, percent: int) -> DataFrame:
    """(unit, cls, partners): the candidates of each class in a small region whose signatures come near the threshold."""

    def new(slot: int, equal: np.ndarray, compared: np.ndarray) -> np.ndarray:
        """Pairs that no earlier tree compares: ``equal`` has the positions they share, ``compared`` the trees where both are."""
        left = np.arange(len(equal))
        for s in range(0, slot, 16):
            e = min(s + 16, slot)
            held = compared[left, s:e]
            some = np.flatnonzero(held.any(axis=0))
            if len(some):
                met = equal[left][:, _ORDERS[s + some, :DEPTH]].all(axis=2) & held[:, some]
                left = left[~met.any(axis=1)]
                if not len(left):
                    break
        return left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        for table in whole_runs(batches, "unit"):
            units, slot = table.column("unit").to_numpy(), table.column("slot").to_numpy()
            cls, n = table.column("cls").to_numpy(), table.column("n_shingles").to_numpy()
            matrix = _matrix(table.column("signature"))
            packed = np.frombuffer(b"".join(table.column("compared").to_pylist()), dtype=np.uint8).reshape(len(units), -1)
            starts = run_starts(units)
            for s, e in zip(starts, [*starts[1:], len(units)]):
                for i in range(s, e - 1):
                    near = _near(matrix, n, i, slice(i + 1, e), percent) + i + 1
                    if len(near):
                        both = np.unpackbits(packed[near] & packed[i], axis=1)
                        near = near[new(int(slot[i]), matrix[near] == matrix[i], both)]
                        if len(near):
                            lists.add(int(cls[i]), cls[near].tolist())
                lists.close(int(units[s]))
            yield lists.batch()

    return members.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, _Lists.SCHEMA)


def _neighbours(held: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """(unit, cls, partners) of crowded regions: candidates among up to REGION neighbours with the longest common prefixes.

    The sort is one range partitioning over all crowded regions, so a region of any size is spread over many tasks.
    """

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                picked = _ORDERS[batch.column("slot").to_numpy(), DEPTH:]
                order = np.take_along_axis(_matrix(batch.column("signature")), picked, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("key", "cls", "n_shingles", "signature")), pa.array([o.tobytes() for o in order], pa.binary())],
                    ["key", "cls", "n_shingles", "signature", "order"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        for batch in batches:
            keys, cls, n = (batch.column(c).to_numpy() for c in ("key", "cls", "n_shingles"))
            matrix = _matrix(batch.column("signature"))
            starts = run_starts(keys)
            for first, last in zip(starts, [*starts[1:], len(keys)]):
                for s in range(first, last, REGION):
                    e = min(s + REGION, last)
                    for i in range(s, e - 1):
                        near = _near(matrix, n, i, slice(i + 1, e), percent) + i + 1
                        if len(near):
                            lists.add(int(cls[i]), cls[near].tolist())
                    lists.close(int(_mix(np.array([keys[s]], dtype=np.int64).view(np.uint64) * _P + np.uint64(cls[s])).view(np.int64)[0]))
            yield lists.batch()

    rows = crowded.where(F.col("slot") < SORTED_TREES).join(held, "cls")
    ordered = rows.select("slot", "key", "cls", "n_shingles", "signature").mapInArrow(
        further, "key long, cls long, n_shingles long, signature binary, order binary"
    )
    return ordered.repartitionByRange("key", "order", "cls").sortWithinPartitions("key", "order", "cls").mapInArrow(run, _Lists.SCHEMA)


def _open(crowded: DataFrame, parts: DataFrame) -> DataFrame:
    """(cls, comp) of the classes in crowded regions that more than one component shares; parts: (node, component)."""
    rows = crowded.join(parts, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("comp"))
    rows, _ = materialize(rows, "forest-grouped")
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return rows.join(several, "key").select("cls", "comp").distinct()


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(unit, cls, partners): candidates of different components that share a rare shingle; rows: (cls, comp, signature, text).

    A unit is a shingle, or a pair of blocks of it where more than REGION sets meet.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text).view(np.int64) for text in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("comp"), batch.column("signature"), pa.array(sets, pa.list_(pa.int64()))],
                ["cls", "comp", "signature", "own"],
            )

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of about a million shingles, or of one set."""
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("own").offsets.to_numpy()))
            for rows in np.split(np.arange(len(ends)), run_starts(ends >> 20)[1:]):
                if len(rows):
                    yield batch.slice(rows[0], len(rows))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            own, n = batch.column("own").flatten().to_numpy(), np.diff(batch.column("own").offsets.to_numpy())
            comp = np.repeat(batch.column("comp").to_numpy(), n)
            order = np.lexsort((comp, own))
            own, comp = own[order], comp[order]
            starts = run_starts(own)
            ends = np.append(starts[1:], len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[starts]), pa.array(ends - starts), pa.array(comp[starts]), pa.array(comp[ends - 1])], ["h", "c", "low", "high"]
            )

    sets, _ = materialize(rows.select("cls", "comp", "signature", "text").mapInArrow(
        to_sets, "cls long, comp long, signature binary, own array<long>"), "forest-sets")
    # shingles of one component cannot join two: they come first in the order and are left out
    shared, _ = materialize(
        sets.select("comp", "own").mapInArrow(tally, "h long, c long, low long, high long").groupBy("h").agg(
            F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")
        ).where("low < high").select("h", "c"), "forest-shared",
    )
    total = shared.agg(F.sum("c")).first()[0] or 0
    level = total // FREQUENT
    top = shared.where(F.col("c") > level).toArrow()  # fewer than FREQUENT, as their counts add up to at most the total
    by_hash = np.argsort(top.column("h").to_numpy())
    frequent = sets.sparkSession.sparkContext.broadcast((top.column("h").to_numpy()[by_hash], top.column("c").to_numpy()[by_hash]))
    rare = shared.where(F.col("c") <= level)

    def known(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = frequent.value
        if not len(hashes):
            return np.zeros(len(own), dtype=bool), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        hit = hashes[at] == own
        return hit, counts[at[hit]]

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            own, n = batch.column("own").flatten().to_numpy(), np.diff(batch.column("own").offsets.to_numpy())
            left = ~known(own)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("cls").to_numpy(), n)[left]), pa.array(own[left])], ["cls", "h"]
            )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            own, ends = batch.column("own").flatten().to_numpy(), np.cumsum(np.diff(batch.column("own").offsets.to_numpy()))
            units, lists, at, size = [], [], [], []
            for k, (s, e) in enumerate(zip([0, *ends[:-1]], ends)):
                hit, counts = known(own[s:e])
                few = batch.column("few")[k].as_py() or ()
                pairs = sorted([(x["c"], x["h"]) for x in few] + list(zip(counts.tolist(), own[s:e][hit].tolist())))
                # a partner at the threshold shares at least ceil(level * n) shingles, so one of the first n - that + 1
                want = int(e - s) - -(-percent * int(e - s) // 100) + 1 - (int(e - s) - len(pairs))
                firsts = [h for _, h in pairs[: max(0, want)]]
                units += firsts
                lists += [firsts[max(0, j - WINDOW) : j] for j in range(len(firsts))]
                at += [k] * len(firsts)
                size += [int(e - s)] * len(firsts)
            for s in range(0, len(units), _CHUNK):
                e, row = s + _CHUNK, pa.array(at[s : s + _CHUNK], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units[s:e], pa.int64()), batch.column("cls").take(row), batch.column("comp").take(row),
                     pa.array(size[s:e], pa.int64()), pa.array(lists[s:e], pa.list_(pa.int64()))],
                    ["unit", "cls", "comp", "n_shingles", "before"],
                )

    with_few = sets.withColumn("few", F.lit(None).cast("array<struct<c:bigint,h:bigint>>"))
    if level:
        loose = sets.select("cls", "own").mapInArrow(other, "cls long, h long").where(maybe_among(rare, "h")("h")).join(rare, "h")
        few = loose.groupBy("cls").agg(F.collect_list(F.struct("c", "h")).alias("few"))  # a text's own shingles at most
        with_few = sets.join(few, "cls", "left")
    rows, _ = materialize(with_few.select("cls", "comp", "own", "few").mapInArrow(
        first, "unit long, cls long, comp long, n_shingles long, before array<long>"), "forest-firsts")
    sizes = rows.groupBy("unit").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where(
        "low < high").select("unit", F.ceil(2 * F.col("n") / REGION).cast("int").alias("blocks"), "n")
    # signatures are joined to the rows of shingles that do meet: a long text has many that do not
    met = rows.join(sizes, "unit").join(sets.select("cls", "signature"), "cls").withColumn(
        "blocks", F.when(F.col("n") <= REGION, 1).otherwise(F.col("blocks"))
    )
    own = F.pmod(F.xxhash64("cls", F.lit(2)), "blocks").cast("int")
    step = F.when(F.col("blocks") == 1, F.col("unit")).otherwise(F.xxhash64("unit", F.least(own, "other"), F.greatest(own, "other")))
    steps = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        step.alias("unit"), "cls", "comp", "n_shingles", "signature", "before", own.alias("block"), (own == F.col("other")).alias("within")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _Lists()
        for table in whole_runs(batches, "unit"):
            units, cls, comp, n, block = (table.column(c).to_numpy() for c in ("unit", "cls", "comp", "n_shingles", "block"))
            matrix, within = _matrix(table.column("signature")), table.column("within").to_numpy(zero_copy_only=False)
            before = [frozenset(own) for own in table.column("before").to_pylist()]
            starts = run_starts(units)
            for s, e in zip(starts, [*starts[1:], len(units)]):
                for i in range(s, e - 1):
                    # rows of one block meet in that block's own step alone
                    others = np.flatnonzero((comp[i + 1 : e] != comp[i]) & (within[i] | (block[i + 1 : e] != block[i]))) + i + 1
                    near = others[_near(matrix, n, i, others, percent)].tolist()
                    # a pair that meets under several shingles is passed on by the first one, or again where that is out of sight
                    near = [j for j in near if before[i].isdisjoint(before[j])]
                    if near:
                        lists.add(int(cls[i]), cls[near].tolist())
                lists.close(int(units[s]))
            yield lists.batch()

    return steps.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, _Lists.SCHEMA)


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the true links of each step; rows have unit, cls, partners, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            units, cls = table.column("unit").to_numpy(), table.column("cls").to_numpy()
            partners = table.column("partners").to_pylist()
            texts = encoded(table.column("text"))
            starts = run_starts(units)
            left, right = [], []
            for s, e in zip(starts, [*starts[1:], len(units)]):
                sets = {int(c): shingles(next(texts)) for c in cls[s:e]}
                parent = {c: c for c in sets}

                def root(c: int) -> int:
                    while parent[c] != c:
                        parent[c] = parent[parent[c]]
                        c = parent[c]
                    return c

                for i in range(s, e):
                    a = int(cls[i])
                    own = sets[a]
                    for b in partners[i]:
                        ra, rb = root(a), root(b)
                        if ra == rb:
                            continue
                        other = sets[b]
                        at = np.searchsorted(own, other)
                        at[at == len(own)] = 0
                        both = int(np.count_nonzero(own[at] == other))
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            parent[rb] = ra
                            left.append(a)
                            right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    sorted_rows = rows.select("unit", "cls", "partners", "text").repartition("unit").sortWithinPartitions("unit")
    return sorted_rows.mapInArrow(run, "a long, b long")


_TEXT_KEY = ("text_hash", "id", "no_id")


def _text_key(doc_id, text_hash) -> list:
    """What names a text, without nulls: grouping and joining by it need the same distribution."""
    return [text_hash.alias("text_hash"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id")]


def _with_text(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the text of the class that each names by ``cls``."""
    wanted, _ = materialize(
        rows.select("cls").distinct().join(classes.select("cls", "source"), "cls").select(
            "cls", *_text_key(F.col("source.doc_id"), F.col("source.text_hash"))
        ), "forest-wanted",
    )
    among = maybe_among(wanted, "text_hash")
    keyed = docs.select(*_text_key(F.col("doc_id").cast("long"), F.xxhash64("text")), "text").where(among("text_hash"))
    # repeated rows are merged where they are read, so each text moves once to its key and once to its class
    single = keyed.groupBy(*_TEXT_KEY).agg(F.first("text").alias("text"))
    texts = single.join(wanted, list(_TEXT_KEY)).select("cls", "text")
    return rows.join(texts, "cls")


def _state(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(one row per document, one row per class with its component's smallest doc_id)."""
    sets, _ = materialize(_sets(docs), "shingle-sets")
    classes, _ = materialize(
        sets.where("n_shingles > 0").groupBy("d1", "d2").agg(
            F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("source"),
            F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        ).withColumn("cls", F.monotonically_increasing_id()),
        "shingle-classes",
    )
    small, crowded, paths = _regions(classes, percent)
    small, path = materialize(small, "forest-members")
    paths.append(path)
    members = small.select("cls").unionAll(crowded.select("cls")).distinct()
    held, path = materialize(_signatures_of(classes, members).select("cls", "n_shingles", "signature"), "forest-signatures")
    paths.append(path)
    found = _partners(_members(held, small, trees(percent)), percent)
    busy = not crowded.isEmpty()
    if busy:
        found = found.unionAll(_neighbours(held, crowded, percent))
    candidates, path = materialize(found, "forest-candidates")
    paths.append(path)
    edges, _ = materialize(_confirmed(_with_text(docs, classes, candidates), percent), "forest-links")
    parts = connected_components(edges)
    if busy:
        left, path = materialize(_open(crowded, parts), "forest-open")
        paths.append(path)
        if not left.isEmpty():
            texts, path = materialize(_with_text(docs, classes, left).join(held.select("cls", "signature"), "cls"), "forest-texts")
            paths.append(path)
            candidates, path = materialize(_across(texts, percent), "forest-candidates")
            paths.append(path)
            more, _ = materialize(_confirmed(candidates.join(texts.select("cls", "text"), "cls"), percent), "forest-links")
            if not more.isEmpty():
                # the components found so far are stars already; only what joins them is new
                stars = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
                parts = connected_components(stars.unionAll(more.select("a", "b")).distinct())
    for path in paths:
        drop_path(docs.sparkSession, path)
    parts = parts.withColumnRenamed("node", "cls")
    base = classes.select("d1", "d2", "cls", "first").join(parts, "cls", "left")
    firsts = base.where("component is not null").groupBy("component").agg(F.min("first").alias("component_id"))
    state = base.join(firsts, "component", "left").select("d1", "d2", F.coalesce("component_id", "first").alias("component_id"))
    return sets.drop("signature"), state


def components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text); links from ``percent`` of Jaccard on."""
    sets, state = _state(docs, percent)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.join(state, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the document with the smallest doc_id, with all columns.

    Rows whose text is that of no dropped document go straight through; only the others meet the list of kept ones.
    """
    sets, state = _state(docs, percent)
    tagged, _ = materialize(
        sets.join(state, ["d1", "d2"], "left").select("doc_id", "text_hash", "n_shingles", "component_id"), "shingle-groups"
    )
    keys = tagged.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n"), F.first("component_id").alias("component_id"), F.first("n_shingles").alias("n_shingles")
    )
    first = tagged.where("n_shingles > 0").groupBy(F.col("component_id").alias("group")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    )
    # of a component, one text under one doc_id stays, and of rows repeated in full one; empty texts stay as they are
    verdicts, _ = materialize(
        keys.where("n_shingles > 0").join(first, F.col("component_id").eqNullSafe(F.col("group")), "left").select(
            F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "n",
            (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"),
        ).where("n > 1 or not stays"), "shingle-verdicts",
    )
    among = maybe_among(verdicts, "own_hash")
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("text_hash"),
                         F.col("doc_id").cast("long").alias("key")).withColumn("maybe", among("text_hash"))
    free = packed.where("not maybe").select("doc")
    met = packed.where("maybe").join(
        verdicts, (F.col("text_hash") == F.col("own_hash")) & F.col("key").eqNullSafe(F.col("own_id")), "left"
    )
    single = met.where("n is null").select("doc")
    repeated = met.where("stays").groupBy("key", "text_hash").agg(F.first("doc").alias("doc")).select("doc")
    return free.unionAll(single).unionAll(repeated).select("doc.*")
