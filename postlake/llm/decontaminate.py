"""Benchmark decontamination by greedy string tiling.

Texts and items become lower-case word sequences. Word four-grams shared with an item are the seeds: a document is compared
only with items it shares a seed with. For such a pair the tiles are found by running Karp-Rabin greedy string tiling: for
falling search lengths, maximal matches of unmarked words are looked up by rolling hash, and the longest are marked first.
Tiles may stand in any order, so reordered passages are covered like copies; a document is contaminated by an item when its
tiles cover ``threshold`` of the item's words.

Items go to the tasks in blocks of bounded size, one pass over the documents per block.

Defined results: null or empty texts and items match nothing; an item shorter than the seed length must occur as a whole;
repeated rows and items each give their own result rows; empty tables give no rows. Extra columns are ignored by
``overlaps`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import encoded

SEED_WORDS, MIN_TILE, THRESHOLD = 4, 3, 0.5
#: Bytes of item texts sent to the tasks at once.
BLOCK_BYTES = 16_000_000
#: ASCII bytes other than letters and digits part words.
_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_SPACES).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(ids: np.ndarray, size: int, powers: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` ids, modulo 2**64."""
    n = len(ids)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers if powers and len(powers[0]) >= n else power_tables(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(ids * up[:n], out=total[1:])
    return (total[size:] - total[:-size]) * down[: n - size + 1]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(
        np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(0, n - 1), b, dtype=np.uint64))]) for b in (_BASE, _INVERSE)
    )


def tiles(item: np.ndarray, doc: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(item start, document start, length) by running Karp-Rabin greedy string tiling over two arrays of word hashes."""
    out: list[tuple[int, int, int]] = []
    item_used, doc_used = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    powers = power_tables(max(len(item), len(doc), 1))
    lower = min(min_tile, len(item))
    search = len(item)
    while lower and search >= lower:
        found = _matches(item, doc, item_used, doc_used, search, powers)
        longest = max((m[0] for m in found), default=0)
        if longest > 2 * search:
            search = longest
            continue
        queue = defaultdict(list)
        for length, i, d in found:
            queue[length].append((i, d))
        for length in range(longest, search - 1, -1):
            for i, d in sorted(queue.pop(length, ())):
                free = ~(item_used[i : i + length] | doc_used[d : d + length])
                if free.all():
                    out.append((i, d, length))
                    item_used[i : i + length] = doc_used[d : d + length] = True
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
                for a, b in zip(edges[::2], edges[1::2]):  # what is left between marked words waits for its own length
                    if b - a >= search:
                        queue[int(b - a)].append((int(i + a), int(d + a)))
        if search == lower:
            break
        search = max(lower, search // 2)
    return out


def _matches(item, doc, item_used, doc_used, size, powers) -> list[tuple[int, int, int]]:
    """(length, item start, document start) of the maximal matches of at least ``size`` unmarked words."""
    if len(item) < size or len(doc) < size:
        return []

    def free(used: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(used)])
        return total[size:] == total[:-size]

    item_hash, doc_hash = rolling(item, size, powers), rolling(doc, size, powers)
    starts = defaultdict(list)
    for i in np.flatnonzero(free(item_used)):
        starts[int(item_hash[i])].append(int(i))
    known = np.fromiter(starts, dtype=np.uint64, count=len(starts))
    out = []
    for d in np.flatnonzero(free(doc_used) & np.isin(doc_hash, known)):
        d = int(d)
        for i in starts[int(doc_hash[d])]:
            if i and d and item[i - 1] == doc[d - 1] and not item_used[i - 1] and not doc_used[d - 1]:
                continue  # found from its own start
            room = min(len(item) - i, len(doc) - d)
            stop = (item[i : i + room] != doc[d : d + room]) | item_used[i : i + room] | doc_used[d : d + room]
            length = int(stop.argmax()) if stop.any() else room
            if length >= size:
                out.append((length, i, d))
    return out


class ItemBlock:
    """Items of one block with the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int = SEED_WORDS) -> None:
        self.items = []
        seeds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ids = _hashes(words_of((text or "").encode()))
            if not len(ids):
                continue
            size = min(seed_words, len(ids))
            for h in rolling(ids, size):
                seeds[size][int(h)].add(len(self.items))
            self.items.append((item_id, ids))
        self.seeds = {size: dict(own) for size, own in seeds.items()}
        self.sorted = {size: np.sort(np.fromiter(own, dtype=np.uint64, count=len(own))) for size, own in self.seeds.items()}

    def candidates(self, ids: np.ndarray, powers) -> set[int]:
        out: set[int] = set()
        for size, known in self.sorted.items():
            h = rolling(ids, size, powers)
            if len(h):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                for x in np.unique(h[known[at] == h]):
                    out |= self.seeds[size][int(x)]
        return out

    def overlaps(self, text: bytes, powers, threshold: float, min_tile: int) -> Iterator[tuple[int, float, list, int]]:
        ids = _hashes(words_of(text))
        for k in sorted(self.candidates(ids, powers)):
            item_id, item = self.items[k]
            found = tiles(item, ids, min_tile)
            covered = sum(t[2] for t in found) / len(item)
            if covered >= threshold:
                yield item_id, covered, sorted(found, key=lambda t: t[1]), len(item)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in own.toLocalIterator()]


SCHEMA = (
    "doc_id long, item_id long, coverage double, n_tiles int, item_words int, "
    "tiles array<struct<item_start: int, doc_start: int, length: int>>"
)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_tile: int = MIN_TILE,
    seed_words: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item whose tiles cover at least ``threshold`` of the item; clean documents give no row."""
    tile = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()),
        ("item_words", pa.int32()), ("tiles", pa.list_(tile)),
    ])

    def over(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, powers = ItemBlock(items, seed_words), power_tables(1 << 16)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id"), encoded(batch.column("text"))):
                    for item_id, covered, found, n in block.overlaps(text, powers, threshold, min_tile):
                        rows.append({
                            "doc_id": doc_id.as_py(), "item_id": item_id, "coverage": covered, "n_tiles": len(found), "item_words": n,
                            "tiles": [{"item_start": i, "doc_start": d, "length": s} for i, d, s in found],
                        })
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [texts.mapInArrow(over(items), SCHEMA) for items in _blocks(benchmark, block_bytes)]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, min_tile: int = MIN_TILE,
    seed_words: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; no shuffle."""

    def without(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, powers = ItemBlock(items, seed_words), power_tables(1 << 16)
            for batch in batches:
                keep = [
                    next(block.overlaps(text, powers, threshold, min_tile), None) is None for text in encoded(batch.column("text"))
                ]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for items in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(without(items), docs.schema)
    return docs
