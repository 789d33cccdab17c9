"""An inverted index over listings: one row per word and listing, partitioned by the word's hash.

``append`` adds the postings of new listings; nothing that is there is read or rewritten. ``search`` reads the partitions of its
words only, and within them the row groups that can hold the words, as files are sorted by word. A frequent word is a run of
rows in several files, never one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators.listings import search_terms, search_words
from postlake.session import path_exists

#: Partitions of the index; fixed when the first postings are written.
BUCKETS = 64
SCHEMA = "word string, id bigint, bucket int"


def _bucket(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings(listings: DataFrame, id_column: str, buckets: int = BUCKETS) -> DataFrame:
    """(word, id, bucket): the distinct words of title and company of each listing."""
    words = F.explode(F.array_distinct(search_words()))
    rows = listings.select(words.alias("word"), F.col(id_column).cast("bigint").alias("id")).filter((F.col("word") != "") & F.col("id").isNotNull())
    return rows.withColumn("bucket", _bucket("word", buckets))


def append(listings: DataFrame, path: str, id_column: str, buckets: int = BUCKETS) -> None:
    """Add the postings of ``listings``. Rebalancing splits the partition of a frequent word over files and merges light ones."""
    rows = postings(listings, id_column, buckets).hint("rebalance", "bucket")
    rows.sortWithinPartitions("bucket", "word", "id").write.mode("append").partitionBy("bucket").parquet(path)


def search(spark: SparkSession, path: str, terms: str, buckets: int = BUCKETS) -> DataFrame:
    """(id) of listings that hold every term as a whole word; an empty index or no term gives no row.

    The words are counted first, so that the rarest one starts and each further one only narrows what is left.
    """
    wanted = list(dict.fromkeys(search_terms(terms)))
    if not wanted or not path_exists(spark, path):
        return spark.createDataFrame([], "id bigint")
    lit = [F.lit(w) for w in wanted]
    numbers = spark.range(1).select(*[_bucket(w, buckets).alias(f"b{i}") for i, w in enumerate(lit)]).first()
    bucket_of = dict(zip(wanted, numbers))
    index = spark.read.schema(SCHEMA).parquet(path)

    def of(word: str) -> DataFrame:
        return index.filter((F.col("bucket") == bucket_of[word]) & (F.col("word") == word)).select("id")

    counts = index.filter(F.col("bucket").isin(sorted(set(numbers))) & F.col("word").isin(wanted)).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # one row per term
    rarest, *others = sorted(wanted, key=lambda w: (found.get(w, 0), w))
    out = of(rarest).distinct()
    for word in others:
        out = out.join(of(word), "id", "left_semi")
    return out
