"""Language-model scores from a probabilistic suffix tree.

Tokens are lower-case words and one end per text. Words that make up at least ``OWN`` of all tokens are symbols of their own;
the others are grouped into classes by how they end, and a word's share within its class comes from its count. The tree holds
contexts of up to three symbols. A context is a candidate when it makes up at least ``CONTEXT`` of all positions, and stays when
its next-symbol distribution diverges enough from that of its longest proper suffix. Distributions are smoothed towards the
suffix; each token is scored in the longest suffix of its past that the tree holds.

All counts cover all training texts. What goes to the driver and the tasks is bounded by shares, not by the data: at most
1 / CONTEXT contexts a depth and 1 / FREQUENT words. Counts of all rarer words stay in a table and meet their tokens in a join.

Defined results: null and empty texts have the end as their only token; repeated rows count as often as they stand there and
are scored row by row; a null doc_id counts as the empty id (held out); without training texts every probability is that of an
empty count table; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import crc32_bucket, encoded, materialize

ALPHA = 0.1
#: Shares of all tokens: symbols of their own, words whose counts every task holds, candidate contexts.
OWN, FREQUENT, CONTEXT = 1e-4, 5e-7, 1e-4
CLASSES, DEPTH = 256, 3
#: A context stays if it diverges by this many nats a position, and by this many in all its positions together.
DIVERGENCE, EVIDENCE = 0.02, 50.0
#: Tokens gathered before a task passes counts on.
CHUNK_TOKENS = 4_000_000
DENSE = 4_000_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _end_hash() -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b" ")  # no word holds a space


def tokenize(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, class) of every word; classes come from the last three bytes."""
    from xxhash import xxh3_64_intdigest

    low = text.lower()
    words = low.split()
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not words:
        return hashes, np.zeros(0, dtype=np.int32)
    raw = np.frombuffer(b"  " + low + b" ", dtype=np.uint8)
    space = _SPACE[raw]
    ends = np.flatnonzero(~space[:-1] & space[1:])
    one = raw[ends].astype(np.uint32)
    two = np.where(space[ends - 1], 0, raw[ends - 1]).astype(np.uint32)
    three = np.where(space[ends - 1] | space[ends - 2], 0, raw[ends - 2]).astype(np.uint32)
    mixed = ((one * np.uint32(257) + two) * np.uint32(257) + three) * np.uint32(0x9E3779B1)
    return hashes, (mixed >> np.uint32(24)).astype(np.int32) % CLASSES


def _word_counts(training: DataFrame) -> DataFrame:
    """(h, cls, n) of every distinct training token; the end has class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([_end_hash()], dtype=np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            held.clear()
            values, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(c[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "cls", "n"]
            )

        for batch in batches:
            size = 0
            for text in encoded(batch.column("text")):
                h, c = tokenize(text)
                held += [(h, c), (end, np.array([-1], dtype=np.int32))]
                size += len(h) + 1
                if size >= CHUNK_TOKENS:
                    yield counted()
                    size = 0
            if held:
                yield counted()

    return training.select("text").mapInArrow(run, "h long, cls int, n long").groupBy("h").agg(
        F.first("cls").alias("cls"), F.sum("n").alias("n")
    )


@dataclass
class Vocabulary:
    """Frequent words with counts and symbols, and the totals of the classes; sizes are bounded by FREQUENT and CLASSES."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    own: int
    class_logs: np.ndarray

    @property
    def size(self) -> int:
        return self.own + CLASSES


def _vocabulary(counts: DataFrame, total: int) -> Vocabulary:
    """Symbols 0..CLASSES-1 are classes; own symbols follow, the end among them even if it is rare."""
    end = int(np.uint64(_end_hash()).view(np.int64))
    own = (F.col("n") >= OWN * total) | (F.col("h") == end)
    rows = counts.where((F.col("n") >= FREQUENT * total) | own).withColumn("own", own).toArrow()  # at most 1 / FREQUENT rows
    h = rows.column("h").to_numpy().view(np.uint64)
    n, cls, is_own = (rows.column(c).to_numpy() for c in ("n", "cls", "own"))
    order = np.argsort(h)
    h, n, cls, is_own = h[order], n[order], cls[order], is_own[order].astype(bool)
    symbols = cls.astype(np.int32)
    symbols[is_own] = CLASSES + np.arange(int(is_own.sum()))
    logs = np.full(CLASSES, np.log10(ALPHA))
    for r in counts.where(~own).groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # one row a class
        logs[r["cls"]] = np.log10(r["n"] + ALPHA * (r["v"] + 1))
    return Vocabulary(h, n, symbols, int(is_own.sum()), logs)


def _encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row: its symbols, the hashes of its rare words, and the sums over the others."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, class_sum double, "
        "symbols binary, rare array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        end = np.array([_end_hash()], dtype=np.uint64)
        logs = np.log10(v.counts + ALPHA)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in encoded(batch.column("text")):
                h, c = tokenize(text)
                h = np.concatenate([h, end])
                c = np.concatenate([c, np.zeros(1, dtype=np.int32)])
                at = np.searchsorted(v.hashes, h)
                at[at == len(v.hashes)] = 0
                known = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), dtype=bool)
                symbols = np.where(known, v.symbols[at], c) if len(v.hashes) else c
                grouped = symbols < CLASSES
                word = logs[at[known]]
                out[0].append(len(h))
                out[1].append(int(known.sum()))
                out[2].append(float(word.sum()))
                out[3].append(float(word[grouped[known]].sum() - v.class_logs[symbols[grouped]].sum()))
                out[4].append(symbols.astype(np.uint16).tobytes())
                out[5].append(h[~known].view(np.int64))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("row", "doc_id", "held_out")), *(pa.array(o, k) for o, k in zip(out, kinds))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "class_sum", "symbols", "rare"],
            )

    return docs.mapInArrow(run, kind)


@dataclass
class Contexts:
    """Candidate contexts of each depth: ``extend[d]`` maps (context of depth d) * size + next symbol to a context of depth d + 1."""

    size: int
    extend: list[np.ndarray]

    def ids(self, sequence: np.ndarray) -> list[np.ndarray]:
        """For each depth d >= 1, the context that ends before position i of the text, or -1; ``sequence`` starts with the end symbol."""
        n = len(sequence) - 1
        last = sequence[:n].astype(np.int64)
        found = []
        grown = np.zeros(len(sequence), dtype=np.int64)  # id of the context of the current depth that ends at each position
        for depth, keys in enumerate(self.extend):
            sym = sequence.astype(np.int64)
            before = np.full(len(sequence), -1, dtype=np.int64)
            if depth == 0:
                before[:] = 0
            else:
                before[1:] = grown[:-1]
            key = before * self.size + sym
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            hit = (before >= 0) & (keys[at] == key) if len(keys) else np.zeros(len(sequence), dtype=bool)
            grown = np.where(hit, at, -1)
            found.append(grown[: len(last)])
        return found


def _next_counts(encoded_rows: DataFrame, contexts: Contexts, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(context * size + next symbol, count) over all training positions, for the deepest contexts; at most 1 / CONTEXT contexts."""
    size, shared = contexts.size, encoded_rows.sparkSession.sparkContext.broadcast(contexts)
    cells = (len(contexts.extend[-1]) if contexts.extend else 1) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        dense = np.zeros(cells, dtype=np.int64) if cells <= DENSE else None
        for batch in batches:
            keys = []
            for cell in batch.column("symbols"):
                text = np.frombuffer(cell.as_py(), dtype=np.uint16).astype(np.int64)
                sequence = np.concatenate([[end], text])
                context = c.ids(sequence)[-1] if c.extend else np.zeros(len(text), dtype=np.int64)
                hit = context >= 0
                keys.append(context[hit] * size + text[hit])
            key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            if dense is not None:
                dense += np.bincount(key, minlength=cells)
            else:
                values, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["key", "n"])
        if dense is not None:
            at = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(dense[at])], ["key", "n"])

    rows = encoded_rows.where("not held_out").select("symbols").mapInArrow(run, "key long, n long") \
        .groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


@dataclass
class Tree:
    """log10 probabilities per state and symbol; ``states[d]`` maps a context of depth d + 1 to its state, or -1."""

    contexts: Contexts
    states: list[np.ndarray]
    logs: np.ndarray
    end: int

    def score(self, symbols: np.ndarray) -> float:
        sequence = np.concatenate([[self.end], symbols])
        state = np.zeros(len(symbols), dtype=np.int64)
        for depth, ids in enumerate(self.contexts.ids(sequence)):
            if len(self.states[depth]):
                own = np.where(ids >= 0, self.states[depth][ids], -1)
                state = np.where(own >= 0, own, state)
        return float(self.logs[state, symbols].sum(dtype=np.float64))


def learn(encoded_rows: DataFrame, size: int, end: int, total: int) -> Tree:
    """Grow candidate contexts depth by depth, one pass each, and keep those that diverge from their suffix."""
    contexts = Contexts(size, [])
    key, n = _next_counts(encoded_rows, contexts, end)
    root = np.full(size, 0.5)
    root[key] += n
    root /= root.sum()
    rows, states = [root], []
    spelled: list[list[tuple[int, ...]]] = []
    where: dict[tuple[int, ...], np.ndarray] = {(): root}
    passed: dict[tuple[int, ...], bool] = {}
    for depth in range(1, DEPTH + 1):
        grown = key[n >= max(1.0, CONTEXT * total)]
        if not len(grown):
            break
        names = [((spelled[-1][k // size] if spelled else ()) + (int(k % size),)) for k in grown]
        contexts = Contexts(size, [*contexts.extend, grown])
        spelled.append(names)
        key, n = _next_counts(encoded_rows, contexts, end)
        context, symbol = key // size, key % size
        bounds = np.searchsorted(context, np.arange(len(names) + 1))
        for k, name in enumerate(names):
            own, seen = symbol[bounds[k] : bounds[k + 1]], n[bounds[k] : bounds[k + 1]]
            parent = next(where[name[i:]] for i in range(1, len(name) + 1) if name[i:] in where)
            weight, occurred = float(len(own)), float(seen.sum())
            p = weight * parent
            p[own] += seen
            p /= max(weight + occurred, 1e-300) if len(own) else 1.0
            if not len(own):
                p = parent
            where[name] = p
            q = seen / occurred if occurred else seen
            divergence = float((q * np.log(q / parent[own])).sum()) if occurred else 0.0
            passed[name] = divergence >= DIVERGENCE and occurred * divergence >= EVIDENCE
    for names in spelled:
        ids = np.full(len(names), -1, dtype=np.int64)
        for k, name in enumerate(names):
            if passed[name]:
                ids[k] = len(rows)
                rows.append(where[name])
        states.append(ids)
    return Tree(contexts, states, np.log10(np.stack(rows)).astype(np.float32), end)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text)."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc32_bucket("doc_id", 10) == 0).alias("held_out"), "text",
        F.monotonically_increasing_id().alias("row"),
    )
    counts, _ = materialize(_word_counts(base.where("not held_out")), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocabulary = _vocabulary(counts, total)
    rows, _ = materialize(_encode(base.select("row", "doc_id", "held_out", "text"), vocabulary), "encoded-texts")

    end_at = np.flatnonzero(vocabulary.hashes == np.uint64(_end_hash()))
    size = vocabulary.size + (0 if len(end_at) else 1)
    end = int(vocabulary.symbols[end_at[0]]) if len(end_at) else size - 1
    tree = docs.sparkSession.sparkContext.broadcast(learn(rows, size, end, max(1, total)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for batch in batches:
            scores = [t.score(np.frombuffer(c.as_py(), dtype=np.uint16).astype(np.int64)) for c in batch.column("symbols")]
            names = [x for x in batch.schema.names if x != "symbols"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(scores, pa.float64())], [*names, "tree_sum"])

    slim = ["row", "doc_id", "held_out", "n_tokens", "n_known", "known_sum", "class_sum"]
    scored = rows.select(*slim, "symbols").mapInArrow(
        apply, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, class_sum double, tree_sum double"
    )
    rare = (
        rows.select("row", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h", "left")
        .groupBy("row").agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("rare_sum"), F.count("n").alias("rare_known")
        )
    )
    floor = float(np.log10(total + ALPHA * (distinct + 1)))
    sums = F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_sum") + sums - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("tree_sum") + F.col("class_sum") + sums).alias("score"),
    )
