"""Ranked search over postings kept in document blocks, with block maxima.

A block row holds all postings of some ``BLOCK_DOCS`` documents: for each term the documents
with their weights, and the largest of these weights.  For a query the weights times the
query's own weights, summed over the block's maxima, bound every score in the block; a
block whose bound stays below the query's ``k``-th best score so far is not opened for it.
A row is complete in itself, so any task can evaluate any rows: queries travel to the
blocks (a bounded group of them at a time), every task gives away at most ``k`` hits per
query, and no (query, document) pair is shuffled before that.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_DOCS = 128
QUERY_TERMS = 200_000
SCALE = 1e6  # scores are compared as they are shown, rounded to six digits


def block_of(doc_id: str, blocks: int):
    return F.pmod(F.xxhash64(F.lit(23), F.col(doc_id)), F.lit(blocks)).cast("int")


def block_count(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> int:
    return max(1, -(-docs.count() // block_docs))


def block_rows(postings: DataFrame) -> DataFrame:
    """``block, terms``: one row per block out of ``block, term, doc_id, weight``.

    With postings already placed by block both steps stay in that placement.
    """
    per_term = postings.groupBy("block", "term").agg(
        F.max("weight").alias("top"), F.collect_list(F.struct("doc_id", "weight")).alias("docs"))
    return per_term.groupBy("block").agg(F.collect_list(F.struct("term", "top", "docs")).alias("terms"))


@dataclass
class QueryGroup:
    """Some queries as a matrix in the form of a term's list of (query, weight)."""

    queries: list
    terms: pa.Array
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    needed: np.ndarray  # terms of each query

    @classmethod
    def of(cls, rows: pa.Table) -> QueryGroup:
        ids = rows.column("query").combine_chunks().dictionary_encode()
        terms = rows.column("term").combine_chunks().dictionary_encode()
        by = np.argsort(terms.indices.to_numpy(), kind="stable")
        first = np.searchsorted(terms.indices.to_numpy()[by], np.arange(len(terms.dictionary) + 1))
        query = ids.indices.to_numpy()
        return cls(ids.dictionary.to_pylist(), terms.dictionary, first, query[by], rows.column("weight").to_numpy()[by],
                   np.bincount(query, minlength=len(ids.dictionary)))

    def spread(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of (term, query) pairs of some terms, and which of the given terms each belongs to."""
        many = np.diff(self.first)[terms]
        owner = np.repeat(np.arange(len(terms)), many)
        return np.repeat(self.first[terms] - np.cumsum(many) + many, many) + np.arange(len(owner)), owner


class Hits:
    """The ``k`` best documents per query: higher rounded score first, then smaller id, a null id last."""

    def __init__(self, queries: int, k: int):
        self.k, self.lists, self.floor = k, [[] for _ in range(queries)], np.zeros(queries)

    def offer(self, query: int, score: float, doc) -> None:
        hits = self.lists[query]
        insort(hits, (-score, doc is None, doc))
        if len(hits) > self.k:
            hits.pop()
        if len(hits) == self.k:
            self.floor[query] = -hits[-1][0]


def evaluate_block(group: QueryGroup, terms: pa.Array, tops: np.ndarray, docs: pa.Array, weights: np.ndarray, sizes: np.ndarray,
                   hits: Hits, every_term: bool) -> int:
    """Offer a block's documents to all queries; how many queries left the block closed although they share a term."""
    found = pc.index_in(terms, value_set=group.terms)
    hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    if not len(hit):
        return 0
    at, owner = group.spread(found.drop_null().to_numpy())
    width = len(group.queries)
    query = group.query[at]
    shared = np.bincount(query, minlength=width)
    bound = np.bincount(query, weights=group.weight[at] * tops[hit][owner], minlength=width)
    met = shared == group.needed if every_term else shared > 0
    # a bound is a sum in another order than the score: allow for its rounding
    open_ = met & (np.round((bound * (1 + 1e-12) + 1e-9) * SCALE) >= np.round(hits.floor * SCALE))
    closed = int((shared > 0).sum() - open_.sum())
    keep = open_[query]
    at, owner, query = at[keep], owner[keep], query[keep]
    if not len(at):
        return closed
    many = sizes[hit]
    begins = (np.cumsum(sizes) - sizes)[hit]
    names = docs.dictionary_encode(null_encoding="encode")
    number, width_docs = names.indices.to_numpy(), len(names.dictionary)
    pairs = many[owner]
    place = np.repeat(begins[owner] - np.cumsum(pairs) + pairs, pairs) + np.arange(pairs.sum())
    key = np.repeat(query, pairs).astype(np.int64) * width_docs + number[place]
    key, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    score = np.round(np.bincount(inverse, weights=np.repeat(group.weight[at], pairs) * weights[place]) * SCALE) / SCALE
    query, doc = key // width_docs, key % width_docs
    good = (score > 0) & (score >= hits.floor[query]) & ((count == group.needed[query]) if every_term else True)
    ids = names.dictionary.take(pa.array(doc[good])).to_pylist()
    for q, s, d in zip(query[good].tolist(), score[good].tolist(), ids):
        hits.offer(q, s, d)
    return closed


def query_groups(terms: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Deal queries to groups of at most ``limit`` rows, or one query: the bound of what is sent to every task."""
    sizes = terms.groupBy("query").agg(F.count("*").alias("n"))
    groups = max(1, -(-terms.count() // limit))
    while True:
        group = F.pmod(F.xxhash64(F.lit(5), "query"), F.lit(groups))
        over = sizes.groupBy(group.alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("q"))
        if over.where((F.col("n") > limit) & (F.col("q") > 1)).isEmpty():
            return terms.withColumn("group", group), groups
        groups *= 2


def top_documents(blocks: DataFrame, query_terms: DataFrame, k: int, every_term: bool = False, limit: int = QUERY_TERMS) -> DataFrame:
    """``query, doc_id, score, hit_rank`` out of block rows and ``query, term, weight``.

    Scores are sums of products, rounded to six digits; only positive ones are hits.  With
    ``every_term`` a hit holds all terms of its query, so a block that lacks one stays closed.
    """
    spark = blocks.sparkSession
    kind = blocks.schema["terms"].dataType.elementType["docs"].dataType.elementType["doc_id"].dataType
    query_kind = query_terms.schema["query"].dataType.simpleString()
    schema = f"query {query_kind}, doc_id {kind.simpleString()}, score double"
    query_terms, groups = query_groups(materialize(query_terms.select("query", "term", F.col("weight").cast("double")), "search-queries"), limit)
    found = spark.createDataFrame([], schema)
    for number in range(groups):
        rows = query_terms.where(F.col("group") == number).select("query", "term", "weight").toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast(QueryGroup.of(rows))
        query_type = rows.schema.field("query").type

        def run(batches, sent=sent, query_type=query_type):
            group, hits, doc_type = sent.value, Hits(len(sent.value.queries), k), pa.int64()
            for batch in batches:
                lists = batch.column("terms")
                entries = lists.flatten()
                bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                terms, tops, inner = (pc.struct_field(entries, f) for f in ("term", "top", "docs"))
                docs, weights = (pc.struct_field(inner.flatten(), f) for f in ("doc_id", "weight"))
                doc_type = docs.type
                sizes = np.diff(inner.offsets.to_numpy())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                tops, weights = tops.to_numpy(), weights.to_numpy()
                for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                    p, q = int(ends[a]), int(ends[b])
                    evaluate_block(group, terms.slice(a, b - a), tops[a:b], docs.slice(p, q - p), weights[p:q], sizes[a:b], hits, every_term)
            out = [(group.queries[i], doc, -score) for i, some in enumerate(hits.lists) for score, _, doc in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], query_type), pa.array([r[1] for r in out], doc_type),
                                              pa.array([r[2] for r in out], pa.float64())], ["query", "doc_id", "score"])

        found = found.unionByName(blocks.mapInArrow(run, schema))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("hit_rank", F.row_number().over(best)).where(F.col("hit_rank") <= k)
