"""Text quality by a sparse rule ensemble.

Statistics of whole texts are computed in one pass. A small forest is grown on labelled rows, every path from a root to a
node becomes a conjunctive rule over the statistics, and a lasso-penalised logistic regression keeps the few rules that
matter. The model is a list of rules and weights, compiled into one Spark column expression.

The fit uses at most about ``fit_rows`` labelled rows, chosen by hash; everything else runs over all rows.

Defined results: null and empty texts have statistics of zero and a score like any other; repeated rows repeat; a doc_id with
several labels takes their rounded mean; without labels of both kinds the score is the smoothed share of good labels; an
empty table gives no rows. Extra columns are ignored by ``score`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import crc32_bucket, encoded, materialize, named

#: A document is predicted good from this score on.
THRESHOLD = 0.7
#: Labelled rows used for the fit at most (about; rows are picked by hash).
FIT_ROWS = 50_000
TREES, DEPTH, LASSO, SEED = 16, 4, 0.001, 11
STATISTICS = (
    "log_words", "mean_word", "longest_word", "upper", "digits", "stops", "commas", "bangs", "pipes", "symbols", "non_ascii",
    "distinct", "repeated", "top_share", "words_per_line", "same_lines", "capitals", "marked_words",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/`"
_HIGH = bytes(range(128, 256))
_MARKED = re.compile(rb"[#$%&*!|@^~_=+<>{}\[\]\\/`]{1,}(?=\s|$)")


def statistics(text: bytes) -> tuple[float, ...]:
    """The values of STATISTICS for one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    size = len(text)

    def share(chars: bytes) -> float:
        return (size - len(text.translate(None, chars))) / size

    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        float(np.log1p(n)), sum(map(len, words)) / n, float(max(map(len, words))), share(_UPPER), share(_DIGITS), share(b"."),
        share(b","), share(b"!?"), share(b"|"), share(_SYMBOLS), share(_HIGH), len(counts) / n, sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n, n / len(lines), 1 - len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / n,
        len(_MARKED.findall(text)) / n,
    )


def with_statistics(docs: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs(text, ...) and the statistics as ``prefix`` + name."""
    names = [prefix + s for s in STATISTICS]
    columns = keep if "text" in keep else [*keep, "text"]
    plain = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(columns)])  # Arrow passes take no dots or ticks in names
    kept = plain.columns[: len(keep)]
    schema = plain.select(*kept).schema
    for i in range(len(names)):
        schema = schema.add(f"s{i}", "double")
    text = f"c{columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t) for t in encoded(batch.column(text))], dtype=np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(v) for v in values.T)], schema.names)

    return plain.mapInArrow(run, schema).toDF(*keep, *names)


@dataclass
class Rules:
    """The fitted model: conjunctions of (statistic, is_upper_bound, threshold) with weights."""

    intercept: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def score(self, prefix: str = "") -> Column:
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            total = total + F.when(_holds(conditions, prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _holds(conditions, prefix: str) -> Column:
    return reduce(and_, (
        F.col(f"`{prefix}{STATISTICS[k]}`") <= t if below else F.col(f"`{prefix}{STATISTICS[k]}`") > t for k, below, t in conditions
    ))


def tree_rules(described: str) -> list[tuple[tuple[int, bool, float], ...]]:
    """The distinct paths from a root to every node of a described forest, each as sorted conditions."""
    split = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)")
    path: list[tuple[int, tuple[int, bool, float]]] = []
    rules: dict[tuple, None] = {}
    for line in described.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        m = split.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3] == "<=", float(m[4])))]
        tightest: dict[tuple[int, bool], float] = {}
        for _, (k, below, t) in path:
            held = tightest.get((k, below))
            tightest[(k, below)] = t if held is None else min(held, t) if below else max(held, t)
        rules[tuple(sorted((k, below, t) for (k, below), t in tightest.items()))] = None
    return list(rules)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Rules:
    """Learn from stats(doc_id, statistics) and labels(doc_id, quality), without the held-out quarter."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc32_bucket("doc_id", 4) != 2))
        .groupBy("doc_id").agg(F.round(F.avg("quality")).alias("label"))
    )
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    rows, _ = materialize(stats.join(known, "doc_id").select("label", *STATISTICS), "quality-rows")
    classes = {r["label"] for r in rows.select("label").distinct().collect()}  # two at most
    if len(classes) < 2:
        return Rules(float(np.log((good + 1) / (n - good + 1))))
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestClassifier(
        labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=SEED,
        minInstancesPerNode=5,
    ).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    indicators = rows.select("label", *[_holds(r, "").cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(indicators)
    lasso = LogisticRegression(labelCol="label", regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(vectors.select("label", "features"))
    weights = lasso.coefficients.toArray()
    return Rules(float(lasso.intercept), [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats, _ = materialize(with_statistics(base, "", ["doc_id"]), "quality-stats")
    model = fit(stats, labels, fit_rows)
    return stats.select("doc_id", (crc32_bucket("doc_id", 4) == 2).alias("held_out"), model.score().alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats, _ = materialize(with_statistics(base, "", ["doc_id"]), "quality-stats")
    model = fit(stats, labels, fit_rows)
    prefix = "stat_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return with_statistics(docs, prefix, docs.columns).where(model.score(prefix) >= threshold).select(*map(named, docs.columns))
