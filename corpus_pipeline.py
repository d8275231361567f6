"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows the stage before it
kept; what it returns is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.

Defined results: rows with null or empty texts pass the toxicity stage unless the
learned curve says otherwise, are judged by the quality rules as empty texts, are never
anybody's near duplicate, and are packed as their end id.  Without labels nothing is
rejected.  Repeated rows of one document are near duplicates: the first stays.  Other
columns, whatever their names, are passed through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailwarden.llm import jaccard, packing, quality, suffix_dedup, toxicity
from trailwarden.llm.common import table
from trailwarden.llm.queries import WORD_BPE
from trailwarden.session import staging_root


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the lexicon is learned from labelled rows of ``docs``."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 go; the rules are learned from labelled rows of ``docs``."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (null last; one of rows repeated with one id and text).

    Documents without words are linked with nothing and all stay.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    keyed = rows.select("_row", suffix_dedup.text_id(text).alias("_text"), _key(F.col("_row.doc_id")).alias("_id"),
                        text.rlike(r"[^ \t-\r]").alias("_words"))
    leading = jaccard.leading_texts(docs).select(F.col("text_id").alias("_text"), _key(F.col("least")).alias("_id"), F.lit(True).alias("_leads"))
    # by text and id, so that a text copied any number of times is spread
    joined = keyed.join(leading, ["_text", "_id"], "left")
    once = Window.partitionBy("_text", "_id").orderBy("_id")
    numbered = joined.where(F.col("_leads") | ~F.col("_words")).withColumn("_n", F.row_number().over(once))
    return numbered.where((F.col("_n") == 1) | ~F.col("_words")).select("_row.*")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit("null"))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that repeat in the corpus are cut out of the texts; pieces of a split character go, too."""
    at = F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("text_id", suffix_dedup.text_id(at))
    _, left = suffix_dedup.dedup(docs, characters=True)
    kept = left.where("n_removed > 0").select("text_id", F.col("kept").cast("string").alias("_kept"))
    joined = rows.join(kept, "text_id", "left")
    columns = [F.coalesce(F.col("_kept"), F.col("_row.text")).alias("text") if c == "text" else F.col(f"_row.`{c}`")
               for c in docs.columns]
    return joined.select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.digests(packing.pack_documents(docs, WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack_sequences),
]

# learned scores and byte-level repeats are beyond SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_root(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
