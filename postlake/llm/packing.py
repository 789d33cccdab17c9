"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

The plan never looks at documents: best fit decreasing runs over at most ``max_tokens`` distinct lengths and their counts, and
moves whole classes of equally filled sequences at a time. Every piece then takes the slot of its rank within its length.

Defined results: a null text is the empty text, whose only token is the end id; a document of exactly ``max_tokens`` tokens is
one piece; in longer ones the first piece takes the remainder; repeated rows and ids are packed row by row; an empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.llm.common import encoded, materialize

MAX_TOKENS = 1024
END_ID = 2
#: Text that the tokenizer file turns into one special id; such texts go through the file itself.
SPECIAL = "<|endoftext|>"
#: Rows that one window of ranks holds.
ROWS_PER_BUCKET = 500_000


class _Tokenizer:
    """Ids of the byte-level vocabulary. The rank file holds the vocabulary of the JSON file and is several times faster
    to apply; texts that hold the special token go through the JSON file, which gives it its own id."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None) -> None:
        self._json_path, self._slow, self._fast = json_path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self._fast is not None and SPECIAL not in text:
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._json_path)
        return self._slow.encode(text, add_special_tokens=False).ids


def public_files() -> dict[str, str]:
    """The public byte-level vocabulary as arguments of ``pieces``; paths are those of the machine that runs the task."""
    import public_tokenizers as public

    return {
        "json_path": public.path("byte_bpe_50k.json"), "ranks_path": public.path("byte_bpe_50k.tiktoken"),
        "pattern": public.PATTERN,
    }


def pieces(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None,
    max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text): the token ids cut into pieces."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokenizer(json_path, ranks_path, pattern)
        for batch in batches:
            docs_, number, start, length, crc, ids_ = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id"), encoded(batch.column("text"))):
                doc_id = doc_id.as_py()
                ids = np.array([*tokens(text.decode()), end_id], dtype="<u4")
                first = len(ids) % max_tokens or max_tokens
                ends = range(first, len(ids) + 1, max_tokens)
                for k, end in enumerate(ends):
                    begin = 0 if k == 0 else end - max_tokens
                    part = ids[begin:end]
                    docs_.append(doc_id)
                    number.append(k)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids_.append(part.astype(np.int32))
            columns = [pa.array(docs_, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids_, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, kind)


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts of lengths.

    Rows (length, rank_from, rank_to, per_sequence, first_sequence, offset): pieces of that length with ranks in
    [rank_from, rank_to) go ``per_sequence`` at a time into consecutive sequences from ``first_sequence``, from ``offset`` on.
    ``open_`` maps free space to classes (first sequence, number of sequences). One step uses up a class or the pieces of a
    length, so the plan has at most a few rows per length and item of a sequence, whatever the number of documents.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            space = next((s for s in range(length, max_tokens + 1) if open_.get(s)), None)
            if space is None:
                fit = max_tokens // length
                open_.setdefault(max_tokens, []).append((sequences, -(-left // fit)))
                sequences += -(-left // fit)
                space = max_tokens
            first, n = open_[space].pop()
            fit = space // length
            full = min(n, left // fit)
            if full:
                rows.append((length, rank, rank + full * fit, fit, first, max_tokens - space))
                rank, left = rank + full * fit, left - full * fit
                open_.setdefault(space - fit * length, []).append((first, full))
                first, n = first + full, n - full
            if n and left:  # fewer than one sequence's worth of pieces is left
                rows.append((length, rank, rank + left, left, first, max_tokens - space))
                open_.setdefault(space - left * length, []).append((first, 1))
                first, n, left = first + 1, n - 1, 0
            if n:
                open_.setdefault(space, []).append((first, n))
    return rows


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``cut`` (from ``pieces``, written, so that reading it twice gives the same rows) with sequence_id and offset.

    Ranks within a length are counted in two levels, length and hash bucket, so a length that a third of all pieces share is
    ranked by many tasks.
    """
    spark: SparkSession = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most max_tokens rows
    steps = plan(histogram, max_tokens)
    buckets = max(16, -(-sum(histogram.values()) // ROWS_PER_BUCKET))
    kept = [F.col(c) for c in cut.columns]
    ranked = cut.select(*kept, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int").alias("bucket"))
    sizes = ranked.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")
    )
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = ranked.withColumn("at", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    table = spark.createDataFrame(
        steps, "plan_length long, rank_from long, rank_to long, per_sequence long, first_sequence long, first_offset long"
    )
    slot = F.col("rank") - F.col("rank_from")
    return ranked.join(
        F.broadcast(table),  # bounded by the number of lengths, not by the data
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    ).select(
        *kept, (F.col("first_sequence") + F.floor(slot / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(slot, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a packed frame with ids; one sequence holds at most ``max_tokens`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))


def pack_documents(docs: DataFrame, with_ids: bool = False, max_tokens: int = MAX_TOKENS) -> DataFrame:
    cut, _ = materialize(pieces(docs, **public_files(), max_tokens=max_tokens, with_ids=with_ids), "pieces")
    return pack(cut, max_tokens)
