"""Registered queries of this subpackage: name -> callable(spark, sf_dir)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.llm import byte_bpe, caps, kmeans_tree, language, main_text, minhash, packing, passages, prefix_trie, radix, threshold, toxicity, warc
from credlake.llm.common import crc32_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


@register
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


@register
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    found = language.identify(docs)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@register
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), include_ids=False)


@register
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.deduplicated(docs)


@register
def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.groups(table(spark, sf_dir, "embeddings"))


@register
def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return kmeans_tree.search(vectors, vectors.where("vec_id % 20 = 0"))


@register
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


@register
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@register
def op12_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.groups(table(spark, sf_dir, "documents"))


@register
def op13_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return threshold.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


ORACLE: dict[str, str] = {}

ORACLE["op6_warc"] = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
    FROM (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM q)"""

# crc32 of a number's digits, bit by bit
_CRC32 = """xor(list_reduce(list_transform(string_split({}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, byte: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(crc, byte)), 4294967295::BIGINT), 4294967295)"""

ORACLE["op11_prefix_trie"] = rf"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {_CRC32.format('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos < h
        UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
    b AS (SELECT conv_id, coalesce(list(length(role) || ':' || role || length(text) || ':' || text ORDER BY own, pos) FILTER (own IS NOT NULL), []) AS turns,
        coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY own, pos) FILTER (own IS NOT NULL), []) AS words FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
    m AS (SELECT conv_id, d AS depth, d = len(turns) AS stops, coalesce(words[d], 0) AS words, sha256(array_to_string(turns[1:d], '')) AS node,
        CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], '')) END AS parent FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
    n AS (SELECT depth, node, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM m GROUP BY depth, node),
    k AS (SELECT p.depth, p.node, count(x.node) AS n_children FROM n p LEFT JOIN n x ON x.depth = p.depth + 1 AND x.parent = p.node GROUP BY p.depth, p.node),
    s AS (SELECT m.depth, m.node, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
        FROM n JOIN k USING (depth, node) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.depth, m.node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM n JOIN k USING (depth, node) JOIN s USING (depth, node) LEFT JOIN n p ON p.depth = n.depth - 1 AND p.node = n.parent"""

ORACLE["op12_radix"] = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

ORACLE["op13_threshold"] = """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
