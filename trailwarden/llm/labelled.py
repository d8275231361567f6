"""Labelled rows for training: folds and the bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``max_rows`` labelled documents outside the held-out fold, one row each.

    The sample is the rows of smallest hash of their id: the same rows however
    the data is partitioned.  A document with contradicting labels, a null label
    or a null id is not learned from.  Only the ids are sorted; the texts are
    joined to at most ``max_rows`` of them, which is the bound of the broadcast.
    Of rows repeated with one id the text of smallest hash is learned from; they
    are reduced to it before the shuffle.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    # labels of documents that are not in the table (any more) must not use up the bound
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = known.where("label = most").drop("most").join(present, "doc_id")
    sample = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    once = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(least)
    return once.select("doc_id", "least.text", "label")
