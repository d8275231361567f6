"""Removal of long repeated byte strings over the whole corpus.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else, in
the same text or another.

Repeats inside a block of text are found on its Burrows-Wheeler transform by
breadth-first backward extension: level by level, the intervals of strings of
length l are extended by one byte to the left, and the interval ends that are new
get the common prefix l.  The search stops at ``length``: suffixes whose common
prefix is still open then share a string of at least that length.

So that blocks may be small and still miss nothing, strings meet by content.  The
key of a string is the least hash of the ``ANCHOR``-byte strings inside it, so equal
strings have equal keys wherever they are.  Neighbouring strings mostly share a
key; a run of them is kept as one context (their bytes).  Keys met once in the
corpus are dropped (their strings cannot repeat).  Equal contexts of a key become one
row by a combining aggregate, whoever owns them; the different contexts of a key are
shuffled by key, and each block of whole keys gets its transform.  What is found is
one list of ranges per different context, joined back to the owners, so rows grow with
the runs however large a group of copies is.  A key with more than ``hot`` *different*
contexts would not fit a block: the strings of its contexts are told apart by their
hashes, counted by a combining aggregate.

Equal whole texts are one text with a count.  Texts are stored once, bucketed by
their digest, so that three later joins do not move them again.

Defined results: a null text is empty; texts shorter than ``length`` stay as they are;
repeated rows are copies of each other, also with equal ids; a null id is kept; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staging_root
from .common import id_text, input_bytes, list_column, mix, shuffle_parts, slices, staged, text_bytes

LENGTH = 200
ANCHOR = 64
HOT = 4_096
BLOCK_BYTES = 512 << 10
PART_BYTES = 128 << 20

_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D


# --- keys -------------------------------------------------------------------------------------------------------------

def window_keys(body: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """At each position: key of the string of ``length`` bytes there, and whether its first anchor has that hash.

    The last ``length - 1`` are without meaning.  ``anchor`` is a power of two.
    """
    h, width, power = _BYTE_HASH[body], 1, _BASE
    while 2 * width <= anchor:  # hash of 1, 2, 4 ... bytes
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        width *= 2
    h = mix(h)
    least, span, want = h, 1, length - width + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if want > span:
        least = np.minimum(least[:len(least) - (want - span)], least[want - span:])
    return least, least == h[:len(least)]


def key_runs(body: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and first positions (within the text) of the runs of one key and anchor, and the number of runs of each text."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - length + 1, 0)  # strings in each text
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(sizes)), counts)
    inner = np.arange(total) - np.repeat(ends - counts, counts)
    place = offsets[:-1][text] + inner
    keys, first = (x[place] for x in window_keys(body, length, anchor))
    fresh = np.ones(total, bool)
    # also where the anchor of that hash changes: text that repeats within a run gives runs of equal key
    fresh[1:] = (keys[1:] != keys[:-1]) | (inner[1:] == 0) | first[:-1]
    at = np.flatnonzero(fresh)
    return keys[at].view(np.int64), inner[at].astype(np.int32), np.bincount(text[at], minlength=len(sizes))


def keyed(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """``text_id, keys, starts`` of each text that has a string of ``length``."""

    def run(batches):
        for whole in batches:
            offsets = text_bytes(whole.column("text"))[1]
            for a, b in slices(np.diff(offsets)):
                batch = whole.slice(a, b - a)
                body, inner = text_bytes(batch.column("text"))
                keys, starts, runs = key_runs(body, inner, length, anchor)
                cuts = np.concatenate([[0], np.cumsum(runs)])
                yield pa.RecordBatch.from_arrays([batch.column("text_id"), list_column(keys, cuts), list_column(starts, cuts)],
                                                 ["text_id", "keys", "starts"])

    long_enough = texts.where(F.octet_length("text") >= length).select("text_id", "text")
    return long_enough.mapInArrow(run, "text_id binary, keys array<long>, starts array<int>")


# --- repeats inside a block -------------------------------------------------------------------------------------------

def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling from seven packed symbols (of nine bits); only unresolved suffixes are sorted again."""
    n, width = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(width, np.uint64)])
    packed = np.zeros(n, np.uint64)
    for j in range(width):
        packed = packed << np.uint64(9) | padded[j:j + n]
    order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    head = np.ones(n, bool)
    head[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        alone = head & np.append(head[1:], True)
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            return order
        who = order[open_at]
        ahead = who + width
        key = rank[who] * np.int64(n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[open_at] = who
        fresh = np.ones(len(who), bool)
        fresh[1:] = key[1:] != key[:-1]
        head[open_at] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        width *= 2


def prefix_classes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and where in it a class of suffixes with ``length`` common symbols begins."""
    n = len(symbols)
    order = suffix_array(symbols)
    transform = symbols[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    extend = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    extend[by_symbol] = np.arange(n)
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # neighbours with the same symbol
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    known = np.zeros(n + 1, bool)  # common prefix with the row above is below the current level
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        sizes = high - low + 1
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        first = before[rows] < np.repeat(low, sizes)
        last = after[rows] > np.repeat(high, sizes)
        # intervals of one level do not overlap, so sorted firsts and lasts belong together
        longer_low, longer_high = np.sort(extend[rows[first]]), np.sort(extend[rows[last]])
        new = ~known[longer_high + 1]
        known[longer_high[new] + 1] = True
        low, high = longer_low[new], longer_high[new]
        if not len(low):
            break
    return order, known[:n]


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the different contexts: where a string of ``length`` starts that starts in the block elsewhere, too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    symbols = np.frombuffer(b"\xff".join(contexts), np.uint8).astype(np.uint16) + 1
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols[(begins[1:] - 1)] = 300  # between contexts; no text has it
    symbols = np.append(symbols, np.uint16(0))
    order, heads = prefix_classes(symbols, length)
    number = np.cumsum(heads) - 1
    shared = np.bincount(number)[number] > 1
    repeated = np.zeros(len(symbols), bool)
    repeated[order[shared]] = True
    return [np.flatnonzero(repeated[b:b + max(0, s - length + 1)]) for b, s in zip(begins.tolist(), sizes.tolist())]


# --- plan -------------------------------------------------------------------------------------------------------------

def distinct_texts(docs: DataFrame) -> DataFrame:
    """``text_id, text, copies``: every different text once, as files bucketed by ``text_id``."""
    spark = docs.sparkSession
    buckets = min(100_000, max(shuffle_parts(spark), input_bytes(docs) // PART_BYTES))  # Spark's most
    name = f"llm_texts_{uuid.uuid4().hex}"
    once = docs.groupBy("text_id").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    once.write.bucketBy(buckets, "text_id").option("path", f"{staging_root(spark).rstrip('/')}/{name}").option(
        "compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _contexts(picked: DataFrame, length: int) -> DataFrame:
    """``text_id, at, key, digest, context``: the picked runs as bytes."""

    def run(batches):
        for batch in batches:
            picks = batch.column("picks")
            counts = np.diff(picks.offsets.to_numpy())
            flat = picks.flatten()
            at, n = (flat.field(f).to_pylist() for f in ("at", "n"))
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            row = np.repeat(np.arange(batch.num_rows), counts)
            for a, b in slices(np.array(n, np.int64) + length - 1):
                contexts = [texts[r][s:s + k + length - 1] for r, s, k in zip(row[a:b].tolist(), at[a:b], n[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_id").take(pa.array(row[a:b])), pa.array(at[a:b], pa.int32()), flat.field("key").slice(a, b - a),
                     pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in contexts], pa.binary()), pa.array(contexts, pa.binary())],
                    ["text_id", "at", "key", "digest", "context"])

    return picked.mapInArrow(run, "text_id binary, at int, key long, digest binary, context binary")


FOUND = "key long, digest binary, begins array<int>, ends array<int>"


def _by_transform(classes: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Repeated ranges of different contexts (``FOUND``); ``classes`` is sorted by key, blocks hold whole keys."""

    def solve(block: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        out: list[tuple[int, bytes, list[int], list[int]]] = []
        for (key, digest, _), starts in zip(block, repeated_starts([c for _, _, c in block], length)):
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > length) + 1
                firsts, lasts = starts[np.append(0, breaks)], starts[np.append(breaks - 1, len(starts) - 1)]
                out.append((key, digest, firsts.tolist(), (lasts + length).tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())))],
            ["key", "digest", "begins", "ends"])

    def run(batches):
        block: list[tuple[int, bytes, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "context"))):
                if row[0] != last and size > block_bytes:
                    yield solve(block)
                    block, size = [], 0
                last = row[0]
                block.append(row)
                size += len(row[2])
        if block:
            yield solve(block)

    return classes.select("key", "digest", "context").mapInArrow(run, FOUND)


def _by_hashes(classes: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many different contexts: every string by its hash."""

    def run(batches):
        for batch in batches:
            contexts = batch.column("context").to_pylist()
            for a, b in slices(np.array([len(c) for c in contexts], np.int64), 1 << 16):
                row = [i for i in range(a, b) for _ in range(len(contexts[i]) - length + 1)]
                at = [p for i in range(a, b) for p in range(len(contexts[i]) - length + 1)]
                strings = [hashlib.blake2b(contexts[i][p:p + length], digest_size=16).digest() for i, p in zip(row, at)]
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("digest").take(rows), pa.array(strings, pa.binary()),
                                                  pa.array(at, pa.int32())], ["key", "digest", "string", "p"])

    strings = classes.select("key", "digest", "context").mapInArrow(run, "key long, digest binary, string binary, p int")
    again = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    met = strings.join(again, "string").groupBy("key", "digest").agg(F.collect_list("p").alias("begins"))  # at most the strings of one context
    return met.select("key", "digest", "begins", F.transform("begins", lambda p: p + length).alias("ends"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``text_id, spans array<struct<begin, end>>`` (not merged) of the texts that share strings; ``texts`` as from ``distinct_texts``."""
    runs = staged(keyed(texts, length, anchor), "suffix-keys")
    met = runs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    ends = F.expr("transform(starts, (s, i) -> named_struct('at', s, 'next', try_element_at(starts, i + 2), 'key', keys[i]))")
    rows = runs.select("text_id", F.explode(ends).alias("r")).select("text_id", "r.at", "r.next", "r.key")
    left = rows.join(met.select("key"), "key").select("text_id", F.struct("at", "next", "key").alias("pick"))
    picks = left.groupBy("text_id").agg(F.collect_list("pick").alias("picks"))  # at most the runs of one text
    total = F.octet_length("text") - (length - 1)
    sized = F.transform("picks", lambda p: F.struct(p["at"].alias("at"), (F.coalesce(p["next"], total) - p["at"]).alias("n"), p["key"].alias("key")))
    picked = texts.join(picks, "text_id").select("text_id", "text", sized.alias("picks"))
    owned = staged(_contexts(picked, length), "suffix-contexts")
    classes = owned.groupBy("key", "digest").agg(F.count("*").alias("owners"), F.first("context").alias("context"))
    different = owned.select("key", "digest").distinct().groupBy("key").agg(F.count("*").alias("different"))
    classes = staged(classes.join(different, "key").where("owners > 1 OR different > 1"), "suffix-classes")
    whole = classes.where("owners > 1").select(
        "key", "digest", F.array(F.lit(0)).alias("begins"), F.array(F.octet_length("context")).alias("ends"))
    parts = max(shuffle_parts(texts.sparkSession), input_bytes(texts) // PART_BYTES)
    together = classes.where((F.col("different") > 1) & (F.col("different") <= hot)).repartition(parts, "key").sortWithinPartitions("key")
    single = classes.where("owners = 1").select("key", "digest")
    partly = _by_transform(together, length, block_bytes).unionByName(_by_hashes(classes.where(F.col("different") > hot), length))
    found = whole.unionByName(partly.join(single, ["key", "digest"], "left_semi"))
    pairs = F.transform(F.arrays_zip("begins", "ends"), lambda r: F.struct((F.col("at") + r["begins"]).alias("begin"), (F.col("at") + r["ends"]).alias("end")))
    spans = owned.select("text_id", "at", "key", "digest").join(found, ["key", "digest"]).select("text_id", pairs.alias("spans"))
    return spans.groupBy("text_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without the pieces of characters that begin before it or end after it."""
    while 0 < a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def cut(texts: DataFrame, spans: DataFrame, length: int = LENGTH, characters: bool = False) -> DataFrame:
    """``text_id, kept binary, n_bytes, n_removed, n_spans``: what is left of each text.

    With ``characters`` pieces of a character that an edge of a removed span
    splits are left out of ``kept``; ``n_removed`` counts the spans only.
    """

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("kept", "n_bytes", "n_removed", "n_spans")}
            copies = batch.column("copies").to_pylist()
            spans_column = batch.column("spans").to_pylist()
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                n = len(text)
                found = [(0, n)] if copies[i] > 1 and n >= length else sorted((s["begin"], s["end"]) for s in spans_column[i] or ())
                merged: list[list[int]] = []
                for a, b in found:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for m in merged for x in m), n]
                rest = list(zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(n)
                out["n_removed"].append(n - sum(b - a for a, b in rest))
                if characters:
                    rest = [whole_characters(text, a, b) for a, b in rest]
                out["kept"].append(b"".join(text[a:b] for a, b in rest))
                out["n_spans"].append(len(merged))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), pa.array(out["kept"], pa.binary()), pa.array(out["n_bytes"], pa.int64()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64())],
                ["text_id", *out])

    joined = texts.join(spans, "text_id", "left").select("text_id", "text", "copies", "spans")
    return joined.mapInArrow(run, "text_id binary, kept binary, n_bytes long, n_removed long, n_spans long")


def text_id(text: str | Column) -> Column:
    return F.unhex(F.md5(text))


def dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, block_bytes: int = BLOCK_BYTES,
          id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> tuple[DataFrame, DataFrame]:
    """The documents' text digests (``doc_id, text_id``) and what is left of each different text (see ``cut``)."""
    rows = id_text(docs, id_col, text_col).withColumn("text_id", text_id("text"))
    texts = distinct_texts(rows)
    return rows.select("doc_id", "text_id"), cut(texts, repeated_spans(texts, length, anchor, hot, block_bytes), length, characters)


def digests(docs: DataFrame) -> DataFrame:
    """Contract form."""
    ids, left = dedup(docs)
    short = left.select("text_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return ids.join(short, "text_id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
