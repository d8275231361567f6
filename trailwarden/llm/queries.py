"""Registered queries of the corpus operators: thin forms over the whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_root
from . import bpe, chat, hard_negatives, jaccard, lexical, neighbours, packing, pii, quality, suffix_dedup, token_files, topk, toxicity
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{staging_root(spark).rstrip('/')}/llm-token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, BYTE_BPE)
    return token_files.crc32_of_ids(token_files.read(spark, folder))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(*columns).union(control)
    folder = f"{staging_root(spark).rstrip('/')}/llm-chat-{uuid.uuid4().hex}"
    chat.format_turns(rows).write.parquet(folder)
    return chat.digests(spark.read.parquet(folder))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.learn(docs)))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_neighbours": op2_neighbours,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_exact_topk": op6_exact_topk,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_chat": op10_chat,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_pii": op13_pii,
}

# every candidate of every query: floor of the components, inner product, rank
SQL = {
    "op6_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
            FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
        QUALIFY rank <= 20
    """,
    "op10_chat": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                             (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        ), e AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
                   length(role) + length(text) + 24
                   + (length(role || text) - length(replace(role || text, '␛', '')))
                   + (length(role) - length(replace(role, '<|im_start|>', ''))) // 12
                   + (length(role) - length(replace(role, '<|im_end|>', ''))) // 10
                   + (length(text) - length(replace(text, '<|im_start|>', ''))) // 12
                   + (length(text) - length(replace(text, '<|im_end|>', ''))) // 10 AS chars
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_lexical_search": """
        WITH terms AS (
            SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
            FROM documents
        ), wanted AS (
            SELECT item_id, term, count(*) AS c
            FROM (SELECT item_id, unnest(regexp_extract_all(
                      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
                  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
            GROUP BY item_id, term
        ), held AS (
            SELECT doc, term, count(*) AS tf
            FROM (SELECT doc, unnest(t) AS term FROM terms) GROUP BY doc, term
        ), total AS (
            SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM terms WHERE len(t) > 0
        ), norm AS (
            SELECT doc, doc_id, 75 + ((25 * len(t) * n_docs) // n_terms) AS m FROM terms, total WHERE len(t) > 0
        ), weight AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
        ), scored AS (
            SELECT item_id, doc, any_value(doc_id) AS doc_id,
                   CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM wanted JOIN held USING (term) JOIN weight USING (term) JOIN norm USING (doc)
            GROUP BY item_id, doc
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
               doc_id, score
        FROM scored WHERE score > 0
        QUALIFY rank <= 20
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY 2, 3) = 1
        ), scored AS (
            SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same,
                   CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
            FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER (
                   PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
