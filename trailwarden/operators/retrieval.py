"""Knowledge-base search: a TF-IDF index and keyword AND search, many queries at once.

Both keep their postings in blocks of documents and are evaluated block by block
(``block_search``): texts are placed by block once, and no (query, document) pair is
shuffled before every task has cut its hits to the best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import PATTERN_QUERY_PHRASES, PATTERN_TITLES
from ..session import materialize
from . import block_search

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens_of(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def terms(tokens: Column) -> Column:
    """Tokens and their bigrams; takes a column of its own so that a text is split once."""
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)


def _placed(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """Texts placed by block; what is derived per document or block stays in that placement."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    return rows.withColumn("block", block_search.block_of("doc_id", blocks)).repartition("block")


SLICE_TOKENS = 1_000_000  # tokens whose terms are counted together


def _count_terms(ids: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
    """``term, doc_id, tf, more``: tokens and bigrams of some texts with the texts that hold them; a bigram's text is made once."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    words = tokens.flatten().dictionary_encode()
    names, word = words.dictionary, words.indices.to_numpy().astype(np.int64)
    width, texts = max(1, len(names)), max(1, len(ids))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(owner[1:] == owner[:-1])
    term = np.concatenate([word, width + word[first] * width + word[first + 1]])
    key, tf = np.unique(term * texts + np.concatenate([owner, owner[first]]), return_counts=True)
    term, owner = key // texts, key % texts
    begins = np.flatnonzero(np.diff(term, prepend=-1))
    term = term[begins]
    pair = term[term >= width] - width
    joined = pc.binary_join_element_wise(names.take(pa.array(pair // width)), names.take(pa.array(pair % width)), pa.scalar(" ", names.type))
    alone = np.zeros(len(key), dtype=bool)
    alone[begins] = True
    others = np.diff(np.append(begins, len(key))) - 1  # of each term, besides its first text
    rest = pa.StructArray.from_arrays([ids.take(pa.array(owner[~alone])), pa.array(tf[~alone], pa.int32())], ["doc_id", "tf"])
    more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(others)), pa.int32()), rest, mask=pa.array(others == 0))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([names.take(pa.array(term[term < width])), joined]), ids.take(pa.array(owner[begins])),
                                       pa.array(tf[begins], pa.int32()), more], ["term", "doc_id", "tf", "more"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, side="right")))
            part = batch.slice(at, to - at)
            yield _count_terms(part.column("doc_id"), part.column("tokens"))
            at = to


def _term_lists(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """``term, doc_id, tf, more``: any number of rows a term, each with one document or some; a row of ``docs`` is counted by itself."""
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    split = _placed(docs, doc_id, text, blocks).select("doc_id", tokens_of(F.col("body")).alias("tokens"))
    return split.mapInArrow(_count_batches, f"term string, doc_id {kind}, tf int, more array<struct<doc_id:{kind},tf:int>>")


def term_lists(docs: DataFrame, doc_id: str, text: str, blocks: int, repeated: DataFrame | None = None) -> DataFrame:
    """``term, doc_id, tf, more``: each (term, document) once; the texts of ``repeated`` ids are added up."""
    if repeated is None:
        return _term_lists(docs, doc_id, text, blocks)
    same = F.col(doc_id).eqNullSafe(F.col("_repeated"))
    again = repeated.select(F.col(doc_id).alias("_repeated"))
    several = _term_lists(docs.join(again, same, "left_semi"), doc_id, text, blocks)
    summed = several.select("term", _documents()).groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf"))
    once = _term_lists(docs.join(again, same, "left_anti"), doc_id, text, blocks)
    return once.unionByName(summed.withColumn("more", F.lit(None).cast(once.schema["more"].dataType)))


def _documents() -> Column:
    """All (doc_id, tf) of a row, one row each."""
    return F.inline(F.concat(F.array(F.struct("doc_id", "tf")), F.coalesce("more", F.array())))


def _df() -> Column:
    return F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0))


@dataclass(frozen=True)
class TfIdfIndex:
    postings: DataFrame  # block, doc_id, term, weight
    vocabulary: DataFrame  # term, df, idf
    lists: DataFrame  # term, doc_id, tf, more: the term frequencies
    weights: DataFrame  # doc_id, term, w: before documents are brought to length 1
    n_docs: int
    n_blocks: int
    blocks: DataFrame | None = None  # written block rows, if the index is kept for several searches

    def norms(self) -> DataFrame:
        """``doc_id, norm``: added up where the terms are, so that no term travels to its documents."""
        return self.weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def _idf(n_docs: int) -> Column:
    return F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0


def tfidf_index(docs: DataFrame, doc_id: str, text: str, max_terms: int | None = None,
                block_docs: int = block_search.BLOCK_DOCS) -> TfIdfIndex:
    """L2-normalized tf-idf weights of all terms, or of the most frequent ``max_terms`` if the caller asks for so many.

    Terms are counted text by text, then every term is dealt once, with its documents, to the
    task that knows how many there are.
    """
    ids = docs.groupBy(doc_id).agg(F.count("*").alias("_n"))
    total, most = ids.agg(F.sum("_n"), F.max("_n")).first()
    n_docs = total or 0
    n_blocks = max(1, -(-n_docs // block_docs))
    lists = term_lists(docs, doc_id, text, n_blocks, ids.where("_n > 1") if (most or 0) > 1 else None)
    if max_terms is not None:
        counted = lists.select("term", _documents()).groupBy("term").agg(F.sum("tf").alias("total"))
        lists = lists.join(counted.orderBy(F.desc("total"), "term").limit(max_terms).select("term"), "term", "left_semi")
    vocabulary = lists.groupBy("term").agg(F.sum(_df()).alias("df")).select("term", "df", _idf(n_docs).alias("idf"))
    # sorted by a number first: many terms begin with the same letters
    df = F.sum(_df()).over(Window.partitionBy("_hash", "term"))
    dealt = lists.repartition("term").withColumn("_hash", F.xxhash64("term"))
    weights = dealt.withColumn("df", df).select("term", _idf(n_docs).alias("idf"), _documents()).select(
        "doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    placed = weights.withColumn("block", block_search.block_of("doc_id", n_blocks)).repartition("block")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("block", "doc_id")))
    postings = placed.select("block", "doc_id", "term", (F.col("w") / norm).alias("weight"))
    return TfIdfIndex(postings, vocabulary, lists, weights, n_docs, n_blocks)


def document_vectors(index: TfIdfIndex) -> DataFrame:
    """``doc_id, terms, top_weight, total_weight``: size, largest and summed weight of every document's vector."""
    summed = index.weights.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.max("w").alias("_top"), F.sum("w").alias("_sum"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return summed.select("doc_id", "terms", (F.col("_top") / F.col("_norm")).alias("top_weight"),
                         (F.col("_sum") / F.col("_norm")).alias("total_weight"))


def stored_index(index: TfIdfIndex) -> TfIdfIndex:
    """The index written as block rows once, for any number of searches."""
    return replace(index, vocabulary=materialize(index.vocabulary, "search-vocabulary"),
                   blocks=materialize(block_search.block_rows(index.postings), "search-blocks"))


def _asked_postings(index: TfIdfIndex, lists: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of some terms, with the norms of their documents over all terms."""
    found = lists.select("term", _documents()).join(vocabulary, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = index.norms().withColumnRenamed("doc_id", "_doc")
    weighted = found.join(norms, F.col("doc_id").eqNullSafe(F.col("_doc"))).withColumn("block", block_search.block_of("doc_id", index.n_blocks))
    return weighted.repartition("block").select("block", "doc_id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def clean_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]+", " "))


def search(index: TfIdfIndex, queries: DataFrame, query_id: str, text: str, k: int = 5) -> DataFrame:
    """Cosine top-k per query; equal queries are scored once, zero scores are no hits."""
    cleaned = queries.select(F.col(query_id).alias("query_id"), clean_query(F.col(text)).alias("query_text"))
    distinct = cleaned.where(F.col("query_text") != "").select("query_text").distinct()
    split = distinct.select("query_text", tokens_of(F.col("query_text")).alias("tokens"))
    counts = split.select("query_text", F.explode(terms(F.col("tokens"))).alias("term")).groupBy(
        "query_text", "term").agg(F.count("*").alias("tf"))
    vocabulary, lists = index.vocabulary, None
    if index.blocks is None:  # one search: only the terms that are asked for
        counts = materialize(counts, "search-counts")
        lists = materialize(index.lists.join(counts.select("term").distinct(), "term", "left_semi"), "search-lists")
        vocabulary = lists.groupBy("term").agg(F.sum(_df()).alias("df")).select("term", _idf(index.n_docs).alias("idf"))
    weighted = counts.join(vocabulary, "term").select("query_text", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_text")))
    asked = materialize(weighted.select(F.col("query_text").alias("query"), "term", (F.col("w") / norm).alias("weight")), "search-asked")
    blocks = index.blocks if lists is None else block_search.block_rows(_asked_postings(index, lists, vocabulary))
    hits = block_search.top_documents(blocks, asked, k)
    return cleaned.join(hits, F.col("query_text") == F.col("query")).select(
        "query_id", "doc_id", "score", F.col("hit_rank").cast("long").alias("hit_rank"))


def dedupe_hits(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """First hit per (title, source) of a query, by hit position."""
    first = Window.partitionBy(query, "title", "source").orderBy("hit_rank")
    return hits.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def pattern_query(extra: Column | None = None) -> Column:
    """Search text for an incident: leading event names and the phrases of its flags."""
    names = [F.nullif(F.col(c), F.lit("")) for c in ("top_event_name", "first_event_name", "last_event_name")]
    phrases = [F.when(F.col(flag), text) for flag, text in PATTERN_QUERY_PHRASES.items()]
    return F.concat_ws(" ", *names, *phrases, *([extra] if extra is not None else []))


def context_query() -> Column:
    """Search text from case fields: title, summary, events, labels and patterns."""
    return F.concat_ws(" ", F.filter(
        F.concat(F.array("title", "summary"), F.col("event_sequence"), F.col("detector_labels"),
                 F.col("retrieved_patterns")),
        lambda part: F.coalesce(part, F.lit("")) != "",
    ))


def pattern_titles() -> Column:
    titles = [F.when(F.col(flag), title) for flag, title in PATTERN_TITLES.items()]
    return F.filter(F.array(*titles), lambda t: t.isNotNull())


# --- keyword search -----------------------------------------------------------------
_ADDRESS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
_PORT = r":\d{2,5}\b"
_INSTANT = r"\d{4}-\d{2}-\d{2}T[\d:Z.]+"


def _longer_than(text: Column, length: int) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda token: F.length(token) > length)


def alert_keywords(text: Column) -> Column:
    """Tokens of an alert text without addresses, ports and instants."""
    for pattern in (_ADDRESS, _PORT, _INSTANT):
        text = F.regexp_replace(text, pattern, "")
    return _longer_than(text, 3)


def search_keywords(text: Column) -> Column:
    """Tokens with punctuation removed (words on both sides of it join)."""
    return _longer_than(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", ""), 2)


def context_keywords(text: Column) -> Column:
    """Tokens with punctuation turned into spaces."""
    return _longer_than(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), 3)


def search_expression(keywords: Column) -> Column:
    return F.array_join(keywords, " & ")


def and_search(
    docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, keywords: str, limit: int = 5
) -> DataFrame:
    """Documents holding every keyword, ranked by the summed log term frequency.

    A block of documents is opened for a query only if it holds all its keywords and
    the largest frequencies in it can reach the query's hits so far.  Tokens match
    exactly: there is no stemming.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(F.flatten(F.transform(
        F.col(keywords), lambda word: F.regexp_extract_all(F.lower(word), F.lit(TOKEN), F.lit(0)))))).alias("term"))
    asked = materialize(asked.distinct().withColumn("weight", F.lit(1.0)), "search-asked")
    placed = _placed(docs, doc_id, text, block_search.block_count(docs))
    tokens = placed.select("block", "doc_id", F.explode(tokens_of(F.col("body"))).alias("term"))
    counts = tokens.join(asked.select("term").distinct(), "term", "left_semi").groupBy("block", "doc_id", "term").agg(F.count("*").alias("tf"))
    blocks = block_search.block_rows(counts.select("block", "doc_id", "term", F.log(1.0 + F.col("tf")).alias("weight")))
    return block_search.top_documents(blocks, asked, limit, every_term=True).select(
        F.col("query").alias("query_id"), "doc_id", "score", F.col("hit_rank").cast("long").alias("hit_rank"))


def with_domain(entries: DataFrame, domains: DataFrame, on: str = "domain_id") -> DataFrame:
    """Entries with their domain name; entries without one are kept."""
    return entries.join(domains, on, "left")


def technique_by_name(entries: DataFrame, name: str) -> DataFrame:
    return entries.where(F.col("title").ilike(f"%{name}%")).orderBy("title").limit(1)


def tactic_list(domains: DataFrame) -> DataFrame:
    return domains.orderBy("name")
