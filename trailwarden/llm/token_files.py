"""Token ids as ORC files.

Every part is a range of document ids, sorted, one file per part: stripes with
run-length encoded integers, row indexes and a Bloom filter on ``doc_id``.  A
reader prunes files, stripes and row groups by document id from that metadata
and stripes are read in parallel.  ``at`` is the number of ids before a
document within its part; the number before the part is a sum over the part
totals kept in a small second table, so that no file has to be rewritten and no
task ever counts the whole corpus.

Defined results: a null text is empty and holds the end id only; a null
``doc_id`` sorts first; rows with equal ``doc_id`` are ordered by their text and
kept each; an empty table gives an empty folder of valid files; other columns
are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, input_bytes, list_column, shuffle_parts, text_slices
from .tokens import SLICE_BYTES, library_encoder, with_end

PART_BYTES = 128 << 20
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.encoding.strategy": "COMPRESSION",  # integer run-length encoding, version 2
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, with_space: bool = True,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write ``folder/tokens`` and ``folder/parts``.

    The texts are range-shuffled once (sampled by id and text, so that one id
    repeated very often is split too) and encoded after it: ids are never
    shuffled.
    """

    def run(batches):
        encoder = library_encoder(tokenizer_path, with_space)
        before = 0
        for batch in (b for whole in batches for b in text_slices(whole, limit=SLICE_BYTES)):
            flat, offsets = with_end(*encoder.encode(batch.column("text")), end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)),
                 list_column(flat.view("<i4"), offsets)],
                ["doc_id", "part", "at", "n_tokens", "ids"])
            before += int(offsets[-1])

    texts = id_text(docs, id_col, text_col)
    n = max(shuffle_parts(docs.sparkSession), input_bytes(docs) // PART_BYTES)
    order = ["doc_id", F.xxhash64("text")]
    parts = texts.repartitionByRange(n, *order).sortWithinPartitions("doc_id", "text")
    parts = parts.select("doc_id", "text", F.spark_partition_id().alias("part"))
    rows = parts.mapInArrow(run, SCHEMA)
    rows.write.options(**ORC_OPTIONS).orc(f"{folder}/tokens")
    spark = docs.sparkSession
    sizes = spark.read.orc(f"{folder}/tokens").select("part", (F.col("at") + F.col("n_tokens")).alias("n"))  # ids are not read
    sizes.groupBy("part").agg(F.max("n").alias("n")).write.options(compression="zstd").orc(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` with ``start`` = ids of all documents before it.

    The table of part totals has one row per part file.
    """
    tokens = spark.read.schema(SCHEMA).orc(f"{folder}/tokens")
    totals = spark.read.schema("part int, n long").orc(f"{folder}/parts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return tokens.join(starts, "part").select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), tokens["n_tokens"], "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; ids are pushed to the files' Bloom filters and statistics."""
    return read(spark, folder).where(F.col("doc_id").isin(doc_ids))


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the CRC-32 of its little-endian unsigned 32-bit form."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            offsets = offsets - offsets[0] if len(offsets) else offsets
            body = memoryview(flat.astype("<u4").tobytes())
            crc = [zlib.crc32(body[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(crc, pa.int64())],
                                             kept + ["ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(run, f"{schema}, ids_crc32 long")
