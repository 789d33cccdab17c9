"""Removal of repeated passages with suffix arrays.

A byte goes when a window of 200 bytes covers it that starts in a second place too. Windows that are equal must meet in one
shard, and no shard may need the whole corpus. So each window is filed under its anchor, the 32 bytes inside it with the least
hash: equal windows have equal anchors. Windows in a row with one anchor form a segment. Segments whose anchor stands in one
place only hold no repeat and go no further; equal segments are counted and represented once. What is left is grouped by anchor
and dealt to shards; each shard sorts its suffixes by induced sorting and compares neighbours by permuted common prefixes
(``induced``). A window is repeated if its segment stands for several places or a neighbour shares 200 bytes.

An anchor inside a passage of very many documents can gather more segments than a shard should hold, as each has other text
around the passage. Such a group is split by where a window lies around the anchor, and then by the bytes that all windows of
that part share. Most parts hold text of one document only and end there; the others are smaller groups. The last split is into
single windows, whose shared bytes are the window, so every group comes to fit, and nothing is left out on the way.

Defined results: texts are UTF-8 bytes, null is empty; texts below the window lose nothing; a text that stands in two rows (with
one doc_id or several) loses everything, if it is as long as a window; a null doc_id gets its row; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import drop_path, materialize, maybe_among, run_starts, whole_runs
from postlake.llm.induced import permuted_prefixes, suffix_array

WINDOW, ANCHOR = 200, 32
#: Windows that one anchor can have, and the bytes of text that are hashed in one step.
REACH, _STEP = WINDOW - ANCHOR + 1, 1 << 17
#: Bytes of an anchor's segments from which it is split, of text in one array, and windows of a part in each split.
CROWDED, SHARD, PARTS = 1 << 21, 1 << 20, (24, 3, 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEGMENT = "h long, g long, m long, n int, at int, piece binary"


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from every position on."""
    m = len(b) - ANCHOR + 1
    eight = np.ndarray((len(b) - 7,), dtype="<u8", buffer=b.data, strides=(1,))
    x = np.zeros(m, dtype=np.uint64)
    for k in range(0, ANCHOR, 8):
        x += eight[k : k + m]
        x *= _B if k else _A
        x ^= x >> np.uint64(29)
    x *= _A
    x ^= x >> np.uint64(32)
    return x


def _least_of_each(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the row, windows, place of the anchor, anchor hash) of the segments of texts laid end to end, in steps."""
    bits = np.uint64(18)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    starts, ends = offsets[:-1], offsets[1:]
    for c in range(int(offsets[0]), int(offsets[-1]) - WINDOW + 1, _STEP):
        stop = min(c + _STEP, int(offsets[-1]) - WINDOW + 1)
        m = stop - c
        low, high = np.searchsorted(ends, c, "right"), np.searchsorted(starts, stop + WINDOW, "left")
        closing = np.zeros(m + 1, dtype=np.int64)  # windows that would cross the end of their text
        np.add.at(closing, np.clip(np.maximum(ends[low:high] - WINDOW + 1, starts[low:high]) - c, 0, m), 1)
        np.add.at(closing, np.clip(ends[low:high] - c, 0, m), -1)
        at = np.flatnonzero(np.cumsum(closing)[:m] == 0)
        if not len(at):
            continue
        hashes = _gram_hashes(data[c : stop + WINDOW - 1])
        keys = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the leftmost
        anchor = (_least_of_each(keys, REACH)[at] & mask).astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        begin, anchor = at[first], anchor[first]
        row = np.searchsorted(starts, begin + c, "right") - 1
        yield row, begin + c - starts[row], count, anchor - begin, hashes[anchor].view(np.int64)


def _digest(piece, seed: int) -> int:
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(piece, seed)
    return x - (1 << 64) if x >> 63 else x


def _laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


def _anchors(texts: DataFrame) -> DataFrame:
    """(h, g, t, start, n, at) of all segments of texts(t, text): anchor hash, digest, text, place, windows, anchor in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _laid_out(batch.column("text"))
            view, t = memoryview(data), batch.column("t")
            for row, start, n, at, h in segments_of(data, offsets):
                begin = (start + offsets[row]).tolist()
                g = [_digest(view[b : b + k + WINDOW - 1], a) for b, k, a in zip(begin, n.tolist(), at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(g, pa.int64()), t.take(pa.array(row)), pa.array(start), pa.array(n, pa.int32()), pa.array(at, pa.int32())],
                    ["h", "g", "t", "start", "n", "at"],
                )

    return texts.select("t", "text").mapInArrow(run, "h long, g long, t binary, start long, n int, at int")


def _cut(rows: DataFrame) -> DataFrame:
    """Segments with their bytes, from (text, segments): one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, segments in zip(batch.column("text"), batch.column("segments")):
                own = segments.values
                text = text.as_py()
                pieces = [text[s : s + k + WINDOW - 1] for s, k in zip(own.field("start").to_pylist(), own.field("n").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(own.field(c) for c in ("h", "g", "m", "n", "at")), pa.array(pieces, pa.binary())], ["h", "g", "m", "n", "at", "piece"]
                )

    return rows.mapInArrow(run, _SEGMENT)


def _split(rows: DataFrame, size: int) -> DataFrame:
    """Parts of segments: windows that lie ``size`` places around the anchor alike, filed under the bytes that all of them hold.

    (h, g, m, n, at, piece) of each part, and the segment's own (h0, g0) with the part's place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, g, m, n, at, piece in zip(*(batch.column(c).to_pylist() for c in ("h", "g", "m", "n", "at", "piece"))):
                low = 0
                while low < n:
                    part = (at - low) // size  # windows from ``at - part * size - size + 1`` to ``at - part * size``
                    high = min(n, at - part * size + 1)
                    core = piece[at - part * size : at - part * size - size + 1 + WINDOW]
                    own = piece[low : high + WINDOW - 1]
                    seed = (h * 0x9E3779B97F4A7C15 + part * 64 + size) & ((1 << 64) - 1)
                    out.append((_digest(core, seed), _digest(own, at - low + 1), m, high - low, at - low, own, h, g, low))
                    low = high
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names
            )

    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] + [pa.int64()] * 2 + [pa.int32()]
    names = ["h", "g", "m", "n", "at", "piece", "h0", "g0", "place"]
    return rows.select("h", "g", "m", "n", "at", "piece").mapInArrow(run, _SEGMENT + ", h0 long, g0 long, place int")


def _repeated(rows: DataFrame, weight: Column) -> Column:
    """Rows whose anchor hash may stand in several places."""
    several, _ = materialize(rows.groupBy("h").agg(F.sum(weight).alias("places")).where("places > 1").select("h"), "repeat-several")
    return maybe_among(several, "h")("h")


def _sized(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups whose anchor has one segment that stands for several places, and those with several segments and their size."""
    sizes, _ = materialize(
        groups.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("m").alias("places"), F.sum(F.col("n") + (WINDOW - 1)).alias("size"))
        .where("places > 1").select("h", "kinds", "size"), "repeat-sizes",
    )
    known = groups.join(sizes, "h")
    return known.where("kinds = 1").drop("kinds", "size"), known.where("kinds > 1").drop("kinds")


def _in_arrays(segments: DataFrame) -> DataFrame:
    """(h, g, spans) of the segments with repeated windows; spans: first and behind the last of each run, in a flat list."""

    def of(pieces: list[bytes], times: np.ndarray, windows: np.ndarray) -> list[list[int]]:
        sizes = windows + WINDOW - 1
        data = np.frombuffer(b"".join(p + b"\0" for p in pieces), dtype=np.uint8)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        s = data.astype(np.int64) + 2
        s[starts + sizes] = 1  # a separator below all bytes; the end of all below that
        s = np.append(s, 0)
        array = suffix_array(s, 258)
        shared = permuted_prefixes(s, array, starts, starts + sizes, windows, WINDOW) >= WINDOW
        repeated = shared.copy()
        rank = np.flatnonzero(shared[array])  # both of two neighbours that share a window
        repeated[array[rank - 1]] = True
        spans = []
        for start, n, m in zip(starts.tolist(), windows.tolist(), times.tolist()):
            own = np.zeros(n + 2, dtype=np.int8)
            own[1:-1] = 1 if m > 1 else repeated[start : start + n]
            spans.append(np.flatnonzero(np.diff(own)).tolist())
        return spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "h"):
            h, m, n = (table.column(c).to_numpy() for c in ("h", "m", "n"))
            pieces = table.column("piece").to_pylist()
            groups = np.append(run_starts(h), len(h)).tolist()
            spans: list[list[int]] = []
            first, size = 0, 0
            for s, e in zip(groups, groups[1:]):
                size += sum(map(len, pieces[s:e]))
                if size >= SHARD or e == len(h):
                    spans += of(pieces[first:e], m[first:e], n[first:e])
                    first, size = e, 0
            yield pa.RecordBatch.from_arrays(
                [table.column("h").combine_chunks(), table.column("g").combine_chunks(), pa.array(spans, pa.list_(pa.int32()))], ["h", "g", "spans"]
            )

    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.select("h", "g", "m", "n", "piece").repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "h long, g long, spans array<int>").where(F.size("spans") > 0)


def _spans(segments: DataFrame, level: int = 0) -> DataFrame:
    """(h, g, spans) of the segments with repeated windows; segments: (h, g, m, n, at, piece, size), several of each h."""
    found = _in_arrays(segments.where(F.col("size") <= CROWDED))
    crowded = segments.where(F.col("size") > CROWDED)
    if level == len(PARTS) or crowded.isEmpty():
        return found
    found, _ = materialize(found, "repeat-spans")
    parts = _split(crowded, PARTS[level])
    likely = parts.where(_repeated(parts.select("h", "m"), F.col("m")))
    links, _ = materialize(likely.select("h", "g", "h0", "g0", "place"), "repeat-links")
    groups, _ = materialize(
        likely.groupBy("h", "g").agg(
            F.sum("m").alias("m"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("piece").alias("piece")), "repeat-parts",
    )
    alike, mixed = _sized(groups)
    mixed, _ = materialize(mixed, "repeat-mixed")
    below = alike.select("h", "g", F.array(F.lit(0), "n").alias("spans"))
    if not mixed.isEmpty():
        below = below.unionAll(_spans(mixed, level + 1))
    lifted = links.join(below, ["h", "g"]).groupBy("h0", "g0").agg(  # a segment's own parts at most
        F.flatten(F.collect_list(F.transform("spans", lambda p: p + F.col("place")))).alias("spans")
    )
    return found.unionAll(lifted.select(F.col("h0").alias("h"), F.col("g0").alias("g"), "spans"))


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bytes that windows starting in [first, behind the last) cover."""
    first, last = spans[0::2], spans[1::2] + WINDOW - 1
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, first[1:] > last[:-1])
    return first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]


def _kept(rows: DataFrame) -> DataFrame:
    """(t, n_removed, n_spans, kept_sha256) from (t, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = memoryview(text.as_py())
                first, last = _merged(spans.values.to_numpy())
                rest = hashlib.sha256()
                at = 0
                for s, e in zip(first.tolist(), last.tolist()):
                    rest.update(data[at:s])
                    at = e
                rest.update(data[at:])
                removed.append(int((last - first).sum()))
                runs.append(len(first))
                kept.append(rest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())],
                ["t", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(run, "t binary, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    sha = F.sha2(data, 256)
    t = F.substring(F.unhex(sha), 1, 16)
    rows, _ = materialize(docs.select("doc_id", t.alias("t"), F.octet_length(data).cast("long").alias("n_bytes"), sha.alias("sha")), "repeat-rows")
    copied, _ = materialize(
        rows.where(F.col("n_bytes") >= WINDOW).groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t"), "repeat-copied"
    )
    among_copies = maybe_among(copied.select(F.xxhash64("t").alias("c")), "c")

    def distinct_texts(only: Column | None = None) -> DataFrame:
        """(t, text) of every text as long as a window, once; texts that have no copy are not moved for it."""
        keyed = docs.where(F.octet_length("text") >= WINDOW).select(t.alias("t"), data.alias("text")).withColumn("c", F.xxhash64("t"))
        keyed = keyed.where(only) if only is not None else keyed
        keyed = keyed.withColumn("maybe", among_copies("c"))
        moved = keyed.where("maybe").groupBy("t").agg(F.first("text").alias("text"))
        return keyed.where("not maybe").select("t", "text").unionAll(moved)

    places, places_path = materialize(_anchors(distinct_texts()), "repeat-places")
    groups, groups_path = materialize(
        places.where(_repeated(places.select("h"), F.lit(1))).groupBy("h", "g").agg(
            F.count("*").alias("m"), F.min(F.struct("t", "start")).alias("one"), F.first("n").alias("n"), F.first("at").alias("at"),
        ), "repeat-groups",
    )
    alike, mixed = _sized(groups)
    mixed, mixed_path = materialize(
        mixed.select("h", "g", "m", F.col("one.t").alias("t"), F.col("one.start").alias("start"), "n", "at", "size"), "repeat-mixed")
    by_text = mixed.groupBy("t").agg(F.collect_list(F.struct("h", "g", "m", "start", "n", "at")).alias("segments"))  # of one text
    among_sources = maybe_among(mixed.select(F.xxhash64("t").alias("c")).distinct(), "c")
    pieces = _cut(distinct_texts(among_sources("c")).join(by_text, "t").select("text", "segments"))
    sizes = mixed.groupBy("h").agg(F.first("size").alias("size"))
    segments, segments_path = materialize(pieces.join(sizes, "h"), "repeat-segments")
    spans, spans_path = materialize(
        alike.select("h", "g", F.array(F.lit(0), "n").alias("spans")).unionAll(_spans(segments)), "repeat-found"
    )

    marked = places.where(maybe_among(spans.select("h").distinct(), "h")("h")).join(spans, ["h", "g"]).select(
        "t", F.transform("spans", lambda p: p + F.col("start")).alias("spans")
    ).join(copied, "t", "left_anti")
    covers, covers_path = materialize(marked.groupBy("t").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeat-covers")  # one text's
    among_covers = maybe_among(covers.select(F.xxhash64("t").alias("c")), "c")
    changed = docs.select(t.alias("t"), data.alias("text")).withColumn("c", F.xxhash64("t")).where(among_covers("c")).select("t", "text")
    kept, _ = materialize(_kept(changed.join(covers, "t").select("t", "text", "spans")), "repeat-kept")
    for path in (places_path, groups_path, mixed_path, segments_path, spans_path, covers_path):
        drop_path(spark, path)
    nothing = hashlib.sha256().hexdigest()
    results = kept.unionAll(copied.select("t", F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(nothing)))
    return rows.join(results, "t", "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
