"""Ranked lexical search, reversed: documents stream through an index of the items.

The items (queries) are few, the documents many, so the inverted index is built over the
items' terms and broadcast, a block of at most ``block_postings`` (item, term) pairs at
a time; one larger item is a block of its own.  A first pass cuts every whole text into
terms once and writes, per document, its length and how often it holds each indexed
term.  Document frequencies and totals are sums over that table.  A second pass streams
those counts through the index: scores of a slice of documents are added up per item and
whatever reaches the least score of an item's heap enters it.  Each task gives away at
most ``k`` documents an item, and the heaps are merged by rank.

Scores are integers: with ``N`` documents that hold a term, ``L`` terms in them, ``n``
terms in a document, a term of document frequency ``df`` weighs
``w = floor(1000 ln((2N + 2) / (2df + 1)))`` and adds
``w * (1000000000 tf div (1000 tf + 12 m))`` with ``m = 75 + 25 n N div L`` each time the item
holds it.  Nothing is left out: every term counts, every document is scored.

Defined results: terms are maximal runs of ASCII letters, digits and characters beyond
ASCII, A-Z lower-cased; a null or empty text has none and is in no result; items without
terms and items with a null id give no rows; equal item rows count once and different
texts of one item are one item; every document row is a document, repeated or not; a
null document id comes last among equal scores; an empty table gives no rows; texts
of any length are cut whole, one text at a time if it is large; other columns are left out.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import list_column, slices, staged, text_bytes, text_slices

BLOCK_POSTINGS = 400_000
SLICE_PAIRS = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, one after another, and the row of each."""
    body, offsets = text_bytes(texts)
    inside = _TERM[body]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(body))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    kept = _LOWER[body[inside]]
    at = np.append((np.cumsum(inside)[starts] - 1), len(kept)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return terms, np.searchsorted(offsets, starts, side="right") - 1


@dataclass
class ItemIndex:
    """Terms of a block of items, and for each term the items that hold it and how often."""

    items: list[int]
    terms: pa.Array
    first: np.ndarray  # postings of term t are first[t]:first[t + 1]
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> ItemIndex:
        items, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        coded = rows.column("term").combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy()
        by = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by], np.arange(len(coded.dictionary) + 1))
        return cls(items.tolist(), coded.dictionary, first, item[by], rows.column("c").to_numpy()[by])

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in each text; and, per text, its indexed terms with their counts (row starts, terms, counts)."""
        terms, row = cut_terms(texts)
        n = np.bincount(row, minlength=len(texts))
        found = pc.index_in(terms, value_set=self.terms)
        hit = found.is_valid().to_numpy(zero_copy_only=False)
        key = row[hit] * len(self.terms) + found.drop_null().to_numpy()
        key, tf = np.unique(key, return_counts=True)
        offsets = np.searchsorted(key, np.arange(len(texts) + 1) * len(self.terms))
        return n, offsets, (key % max(1, len(self.terms))).astype(np.int32), tf.astype(np.int32)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term, c``: how often each item holds each of its terms."""

    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            terms, row = cut_terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), terms], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    return rows.mapInArrow(run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("c"))


def item_blocks(terms: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Deal items to blocks of at most ``limit`` postings (or one item): the bound of a broadcast."""
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("n"))
    blocks = max(1, -(-terms.count() // limit))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
        over = sizes.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if over.where((F.col("n") > limit) & (F.col("items") > 1)).isEmpty():
            return terms.withColumn("block", block), blocks
        blocks *= 2


def document_counts(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tf`` of every document, written once; ``index`` is a broadcast ItemIndex."""

    def run(batches):
        for batch in (b for whole in batches for b in text_slices(whole)):
            n, offsets, terms, tf = index.value.counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), list_column(terms, offsets),
                                              list_column(tf, offsets)], ["doc_id", "n", "terms", "tf"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return staged(texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>"), "lexical-counts")


class Heaps:
    """The best ``k`` documents of every item met so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.floor = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        keep = score >= self.floor[item]
        item, score, ids, known = item[keep], score[keep], ids[keep], known[keep]
        order = np.lexsort((ids, ~known, -score, item))  # the best k of this slice are enough
        item, score, ids, known = item[order], score[order], ids[order], known[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = rank < self.k
        for i, *entry in zip(item[best].tolist(), score[best].tolist(), known[best].tolist(), (-ids[best]).tolist()):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, tuple(entry))
            else:
                heapq.heappushpop(heap, tuple(entry))
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]


def lengths_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """``75 + 25 n N div L`` in whole numbers."""
    if len(n) and int(n.max()) * 25 * documents >= 1 << 62:
        return np.array([75 + 25 * x * documents // total for x in n.tolist()], np.int64)
    return 75 + 25 * n * documents // max(total, 1)


def score_slice(index: ItemIndex, weight: np.ndarray, norm: np.ndarray, offsets: np.ndarray, terms: np.ndarray,
                tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, item and score of every pair that shares a term."""
    docs, width = len(norm), len(index.items)
    row = np.repeat(np.arange(docs), np.diff(offsets))
    gain = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[row]))
    many = np.diff(index.first)[terms]
    at = np.repeat(index.first[terms] - np.cumsum(many) + many, many) + np.arange(many.sum())
    key = np.repeat(row, many) * width + index.item[at]
    add = np.repeat(gain, many) * index.times[at]
    if 4 * len(key) < docs * width:
        key, place = np.unique(key, return_inverse=True)
    else:
        key, place = np.arange(docs * width), key
    score = np.zeros(len(key), np.int64)
    if len(add) and float(np.abs(add).max()) * len(add) >= 2.0 ** 53:
        np.add.at(score, place, add)
    elif len(add):
        score = np.bincount(place, weights=add, minlength=len(key)).astype(np.int64)
    some = score > 0
    key, score = key[some], score[some]
    return key // width, key % width, score


def block_search(counts: DataFrame, index, weights, documents: int, total: int, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the heaps of every task."""

    def run(batches):
        items, weight = index.value, weights.value
        heaps = Heaps(len(items.items), k)
        postings = np.diff(items.first)
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids, n = ids.fill_null(0).to_numpy(), batch.column("n").to_numpy()
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            terms, tf = lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy().astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(postings[terms])])
            work = np.maximum(np.diff(sums[offsets]), len(items.items))
            norm = lengths_norm(n, documents, total)
            for a, b in slices(work, SLICE_PAIRS):
                p, q = offsets[a], offsets[b]
                doc, item, score = score_slice(items, weight, norm[a:b], offsets[a:b + 1] - p, terms[p:q], tf[p:q])
                heaps.offer(item, score, ids[a:b][doc], known[a:b][doc])
        out = [(items.items[i], -doc if there else None, score) for i, heap in enumerate(heaps.heaps) for score, there, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    terms, blocks = item_blocks(staged(item_terms(items, item_col, item_text_col), "lexical-items"), block_postings)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        postings = terms.where(F.col("block") == block).select("item_id", "term", "c").toArrow()
        if not postings.num_rows:
            continue
        index = spark.sparkContext.broadcast(ItemIndex.of(postings))
        counts = document_counts(docs, index, id_col, text_col)
        documents, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        of_term = df.select("t", F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).alias("w")).toArrow()
        weight = np.zeros(len(index.value.terms), np.int64)
        weight[of_term.column("t").to_numpy()] = of_term.column("w").to_numpy()
        found = found.unionByName(block_search(counts, index, spark.sparkContext.broadcast(weight), documents, total, k))
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
