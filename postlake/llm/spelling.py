"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

The words are numbered in code-point order, the nodes of their trie too, and so are the nodes of the trie of the reversed words.
A word without one position is then a pair of integers: the node of what stands before it and the node of what stands after it.
Words that differ in one replaced position meet in the pair with that position skipped; a word and a longer one meet where the
longer one's skipped pair equals the pair between two positions of the shorter one, the place of an insertion. Node numbers
stand for their whole strings, so what meets is a neighbour and nothing is left to verify.

Tries are numbered in parallel. Cut points, taken from a sample of the words, divide the sorted words into ranges; a range is
read in order and numbers the nodes that its words add. Only nodes on the path of a cut point can belong to several ranges, and
these take their numbers from the first range that reaches them, which every task can tell from the cut points alone. Since two
words of one skipped pair differ in one character only, a pair holds at most as many words as there are letters, and one
shorter word: no group grows with the table, and pairs are counted from each group's two best words instead of listed.

Defined results: runs are letters as the contract names them; only A-Z are lower-cased; a null doc_id is written as nothing in
the damage rule; null and empty texts and empty tables have no words; repeated rows count again; extra columns are ignored. Runs
of any length are words, also one that fills a long text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import drop_path, materialize

LEAST_LENGTH, LEAST_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Ranges of the sorted words for each shuffle partition, the characters of a cut point, and sampled words for each range.
RANGES, CUT_LENGTH, SAMPLED = 4, 64, 32
#: A node's number: the range above, then the node within it; nodes on the path of the range's cut point are numbered by depth.
_RANGE_BITS, _OFF_PATH = 44, 1 << 32


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of every word in docs(doc_id, text), after the damage rule; shorter ones are left out."""
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least_length)  # whole runs: a shorter one holds no match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                own: Counter[bytes] = Counter()
                for raw, n in Counter(pattern.findall(text)).items():
                    own[raw.encode().lower()] += n  # bytes know ASCII letters only
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word, start)
                    if h % DAMAGE:
                        total[word] += n
                    else:
                        letters = word.decode()
                        at = h % len(letters)
                        if len(letters) > least_length:
                            total[(letters[:at] + letters[at + 1 :]).encode()] += n
            if len(total) > HELD:
                yield batch_of(total)
                total.clear()
        if total:
            yield batch_of(total)

    def batch_of(total: Counter[bytes]) -> pa.RecordBatch:
        words = pa.array(list(total), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cut_points(words: DataFrame, column: str, ranges: int) -> list[str]:
    """Up to ``ranges - 1`` strings that divide the sorted words evenly: quantiles of a sample of the given size."""
    n = words.count()
    every = max(1, n // (ranges * SAMPLED))
    sample = words.where(F.pmod(F.xxhash64(column, F.lit(7)), F.lit(every)) == 0).select(F.substring(column, 1, CUT_LENGTH).alias("c"))
    found = sorted(r["c"] for r in sample.collect())  # about ranges * SAMPLED short strings, however many words there are
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def numbered(words: DataFrame, column: str, ranges: int, keep: list[str]) -> DataFrame:
    """(keep..., number, nodes): each word's number in code-point order and the trie node of each of its prefixes, "" included."""
    cuts = cut_points(words, column, ranges)
    shared = words.sparkSession.sparkContext.broadcast(cuts)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_left(shared.value, w) for w in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, now, before, path, fresh, seen = shared.value, -1, "", [], 0, 0
        for batch in batches:
            numbers, nodes, offsets = [], [], [0]
            for part, word in zip(batch.column("range").to_pylist(), batch.column(column).to_pylist()):
                if part != now:
                    now, before, path, fresh, seen = part, "", [0], _OFF_PATH, 0
                    own_cut = bounds[part] if part < len(bounds) else None
                common = 0
                for x, y in zip(before, word):
                    if x != y:
                        break
                    common += 1
                del path[common + 1 :]
                for depth in range(common + 1, len(word) + 1):
                    path.append(node(bounds, own_cut, now, word, depth, fresh))
                    fresh += 1
                numbers.append((now << _RANGE_BITS) + seen)
                nodes += path
                offsets.append(len(nodes))
                before, seen = word, seen + 1
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(nodes, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(numbers, pa.int64()), lists], [*keep, "number", "nodes"])

    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    columns = list(dict.fromkeys([column, *keep]))
    rows = words.select(*columns).mapInArrow(ranged, ", ".join(["`range` int", *(f"{c} {kinds[c]}" for c in columns)]))
    rows = rows.repartition("range").sortWithinPartitions("range", column)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "number long, nodes array<long>"]))


def node(cuts: list[str], own_cut: str | None, part: int, word: str, depth: int, fresh: int) -> int:
    """The number of the node ``word[:depth]`` in range ``part``.

    Words with a prefix follow each other, so a prefix in several ranges starts the cut point of the first of them; all ranges
    number it by that cut point and the depth. A prefix of no cut point lies in one range, which counts.
    """
    if depth <= CUT_LENGTH:
        prefix = word[:depth]
        if own_cut is not None and own_cut.startswith(prefix) or part and cuts[part - 1].startswith(prefix):
            return (bisect_left(cuts, prefix) << _RANGE_BITS) + depth
    return (part << _RANGE_BITS) + fresh


def _keys(words: DataFrame) -> DataFrame:
    """(before, after, number, n, skip, first) from (number, n, letters, nodes, ends).

    ``skip``: the pair leaves one position of the word out; else it lies between two. ``first``: the first of equal letters side
    by side, since leaving any of them out gives the same word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                batch = whole.slice(s, 1000)
                if not batch.num_rows:
                    continue
                fore, back = batch.column("nodes"), batch.column("ends")
                sizes = np.diff(fore.offsets.to_numpy()[: batch.num_rows + 1])  # letters and one
                fore, back = fore.flatten().to_numpy(), back.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(batch.num_rows), sizes)
                at = np.arange(len(row)) - starts[row]  # letters before
                length = sizes[row] - 1
                between = back[starts[row] + length - at]
                inner = at < length
                skipped = back[(starts[row] + length - at - 1)[inner]]
                text = "".join(w + "\0" for w in batch.column("word").to_pylist())  # one more place per word, as in nodes
                code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                first = np.append(True, code[1:] != code[:-1]) | (at == 0)
                number, n = (batch.column(c).to_numpy()[row] for c in ("number", "n"))
                for before, after, who, times, skip, lead in (
                    (fore[inner], skipped, number[inner], n[inner], True, first[inner]), (fore, between, number, n, False, np.ones(len(row), dtype=bool)),
                ):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(before), pa.array(after), pa.array(who), pa.array(times), pa.array(np.full(len(who), skip)), pa.array(lead)],
                        ["before", "after", "number", "n", "skip", "first"],
                    )

    return words.select("number", "n", "word", "nodes", "ends").mapInArrow(
        run, "before long, after long, number long, n long, skip boolean, first boolean"
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(number, n_near, best): near words of each word and the best of them as (-n, number), from (number, n, word, nodes, ends)."""
    me = F.struct((-F.col("n")).alias("low"), F.col("number").alias("number"))
    # a pair holds one word per letter at most, and one shorter word
    groups = _keys(words).groupBy("before", "after").agg(
        F.sort_array(F.collect_list(F.when(F.col("skip"), F.struct((-F.col("n")).alias("low"), "number", "first")))).alias("long"),
        F.min(F.when(~F.col("skip"), me)).alias("short"),
    ).where((F.size("long") > 1) | (F.col("short").isNotNull() & (F.size("long") > 0)))
    plain = lambda x: F.struct(x["low"].alias("low"), x["number"].alias("number"))
    one, two = plain(F.col("long")[0]), F.when(F.size("long") > 1, plain(F.get("long", F.lit(1))))
    firsts = F.filter("long", lambda x: x["first"])
    own_short = lambda x: F.when(x["first"], F.col("short"))
    of_long = F.transform("long", lambda x: F.struct(
        x["number"].alias("number"),
        (F.size("long") - 1 + own_short(x).isNotNull().cast("int")).cast("long").alias("near"),
        F.array_min(F.array_compact(F.array(F.when(x["number"] == one["number"], two).otherwise(one), own_short(x)))).alias("best"),
    ))
    of_short = F.when(F.col("short").isNotNull() & (F.size(firsts) > 0), F.array(F.struct(
        F.col("short.number").alias("number"), F.size(firsts).cast("long").alias("near"), plain(F.get(firsts, F.lit(0))).alias("best"),
    ))).otherwise(F.array().cast("array<struct<number:bigint,near:bigint,best:struct<low:bigint,number:bigint>>>"))
    rows = groups.select(F.explode(F.concat(of_long, of_short)).alias("x")).select("x.*").where("near > 0")
    return rows.groupBy("number").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(number, root) of words with a form, from (number, form). A form occurs TIMES as often, so chains are short and end.

    Every step doubles what a pointer skips; a target is near its words only, so no key is much more frequent than others.
    """
    spark = forms.sparkSession
    now, path = materialize(forms.select("number", F.col("form").alias("root")), "spelling-roots")
    while True:
        then = now.select(F.col("number").alias("root"), F.col("root").alias("further"))
        moved, new_path = materialize(
            now.join(then, "root", "left").select("number", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots",
        )
        drop_path(spark, path)
        path = new_path
        now = moved.select("number", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs(doc_id, text) that occurs ``least_count`` times."""
    spark = docs.sparkSession
    words, words_path = materialize(count_words(docs, least_length).where(F.col("n") >= least_count), "spelling-words")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fore, fore_path = materialize(numbered(words, "word", ranges, ["word", "n"]), "spelling-prefixes")
    turned = fore.select("number", F.reverse("word").alias("turned")).withColumnRenamed("number", "own")
    back, back_path = materialize(
        numbered(turned, "turned", ranges, ["own"]).select(F.col("own").alias("number"), F.col("nodes").alias("ends")), "spelling-suffixes"
    )
    near, near_path = materialize(neighbours(fore.join(back, "number")), "spelling-near")
    best = F.when(-F.col("best.low") >= times * F.col("n"), F.col("best"))
    own = fore.select("number", "word", "n").join(near, "number", "left").select(
        "number", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best["number"].alias("form"), (-best["low"]).alias("form_n")
    )
    own, own_path = materialize(own, "spelling-forms")
    ends = roots(own.where("form is not null"))
    names = own.select(F.col("number").alias("id"), F.col("word").alias("name"))
    linked = own.where("form is not null").join(ends, "number")
    named = linked.join(names.select(F.col("id").alias("form"), F.col("name").alias("form_name")), "form").join(
        names.select(F.col("id").alias("root"), F.col("name").alias("root_name")), "root")
    out, _ = materialize(
        named.select("word", F.col("form_name").alias("form"), F.col("root_name").alias("root"), "n", "n_near", "form_n").unionAll(
            own.where("form is null").select("word", F.lit(None).cast("string"), "word", "n", "n_near", F.lit(None).cast("long"))
        ), "spelling-variants",
    )
    for path in (words_path, fore_path, back_path, near_path, own_path):
        drop_path(spark, path)
    return out
