"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import (
    decontaminate,
    embeddings,
    html_text,
    licenses,
    minhash,
    packing,
    quality,
    sharding,
    spelling,
    suffix_dedup,
    suffix_tree,
    warc,
    whitening,
)
from postlake.llm.common import read, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to the archive and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc_archive"] = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS g FROM pages
), f AS (
    SELECT page_id, n, g, max(page_id) OVER (PARTITION BY g) AS first_page FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, g AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""


@query
def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.assign(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and edited notices of all documents."""
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


@query
def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that a benchmark item contaminates, one row per such pair."""
    found = decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "item_words")


@query
def op10_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_tiled_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


ORACLES["op9_tiled_cosine"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e,
           label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
           AND len([x FOR x IN embedding IF x <> 0]) > 0 AS ok
    FROM embeddings
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), walk AS (
    SELECT vec_id, vec_id AS node FROM v
    UNION
    SELECT w.vec_id, l.b FROM walk w JOIN link l ON l.a = w.node
), comp AS (SELECT vec_id, min(node) AS component_id FROM walk GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c USING (vec_id)
"""


@query
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at a Jaccard similarity of 0.85."""
    return minhash.components(read(spark, sf_dir, "documents"), percent=85)


@query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under the suffix tree and under word counts."""
    return suffix_tree.score(read(spark, sf_dir, "documents"))


@query
def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their spelling variants."""
    return spelling.variants(read(spark, sf_dir, "documents"))


@query
def op12_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 200 bytes that stand elsewhere too."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 16 leading components of their covariance, scaled to unit variance."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


# Links decided pair by pair on the shingles that two documents share: quick on small tables only.
ORACLES["op6_lsh_forest"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END)) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT k.doc_id, l.b FROM walk k JOIN ways l ON l.a = k.node),
comp AS (SELECT doc_id, min(node) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
