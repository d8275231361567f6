"""Similarity join of documents on word 5-grams, with an R-tree over count vectors.

A text's set is its distinct shingles of five words.  The set's members are hashed
into G groups; the group counts are a point, and the overlap of two sets is at most
the sum of the smaller counts over the groups.  An R-tree node keeps the largest
count of each group below it, so a whole subtree is put aside when even these sums
are too small for the similarity asked.  What is left is verified on the sets.

One tree over all documents would be as large as the corpus, so trees are built for
documents that can be similar at all: sets A and B with |A n B| >= t |A u B| have a
member in common among the first |A| - ceil(t |A|) + 1 of each, in any common order.
The order is by a table of shingle counts over all documents (a fixed number of
counters), rare ones first.  Documents that share such a key make a block; keys with
the same documents make one block; a block is searched by its tree and the pairs that
may be similar are joined to clusters (as edges to one member, never as all pairs).
Clusters are verified on the whole sets, in which a pair already connected needs no
further look, and the verified edges give the components.  Blocks and clusters beyond
a size are split into chunks and every pair of chunks is searched: nothing is capped.

Equal texts are one text.  All counts, keys and points cover every whole text.

Defined results: a text without words (or null) has an empty set and is linked with
nothing, not even its copies; with one to four words the whole sequence is the only
shingle; repeated rows are copies of each other, also with equal ids (one row each);
a null id is kept and is no component's smallest id unless all its ids are null; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, input_bytes, list_column, mix, shuffle_parts, slices, staged, text_bytes
from .components import components
from .suffix_dedup import distinct_texts, text_id

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
COUNTERS = 1 << 16
FANOUT = 16
BLOCK_DOCS = 4096
CHUNK_SHINGLES = 2_000_000
PART_BYTES = 128 << 20

_K = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# --- sets -------------------------------------------------------------------------------------------------------------

def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the word offsets of each text."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    stop[:-1] &= ~solid[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    # an own factor for every place in a word: with powers of one base long words could be made to collide
    begins = np.append(starts if len(starts) and starts[0] == 0 else np.append(0, starts), n)
    place = np.arange(n, dtype=np.int64) - np.repeat(begins[:-1], np.diff(begins))
    factors = mix(np.arange(int(place.max()) + 1, dtype=np.uint64) + _K)
    values = _LOWER[body] * factors[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    h = sums[stops] - sums[starts]
    h = mix(h ^ mix((stops - starts).astype(np.uint64)))
    return h, np.searchsorted(starts, offsets)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = word_hashes(body, offsets)
    if len(h) >= words:
        grams = h[:len(h) - words + 1]
        for j in range(1, words):
            grams = mix(grams * _K + h[j:len(h) - words + 1 + j])
    else:
        grams = np.zeros(0, np.uint64)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for word in h[a:b]:
                whole = mix(whole * _K + word)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def needed(n: int, m):
    """Least overlap of sets of n and m members that are similar enough: 100 i >= 80 (n + m - i)."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def batches_of_sets(batches):
    """(batch slice, sets) over Arrow batches with a text column."""
    for whole in batches:
        offsets = text_bytes(whole.column("text"))[1]
        for a, b in slices(np.diff(offsets)):
            batch = whole.slice(a, b - a)
            yield batch, shingle_sets(*text_bytes(batch.column("text")))


def counters_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(11)).astype(np.int64) & (COUNTERS - 1)


# --- points and tree --------------------------------------------------------------------------------------------------

def groups_for(n: int) -> int:
    """Number of groups for a set of n members: about four members to a group, a power of two."""
    return min(1 << 14, max(8, 1 << max(0, math.ceil(math.log2(max(1, n) / 4)))))


def point(shingles: np.ndarray) -> np.ndarray:
    groups = groups_for(len(shingles))
    return np.bincount((shingles >> np.uint64(32)).astype(np.int64) & (groups - 1), minlength=groups).astype("<u2")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups: counts of groups that fall together are added."""
    return p.reshape(-1, groups).sum(axis=0) if len(p) > groups else p


class CountTree:
    """R-tree packed by set size, then by the fullest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.var(axis=0)
        first = int(spread.argmax()) if len(points) > FANOUT else 0
        slab = np.argsort(np.argsort(sizes, kind="stable")) // (FANOUT * FANOUT)
        self.order = np.lexsort((points[:, first], slab))
        p, s = points[self.order], sizes[self.order]
        self.levels = [(p, s, s)]
        while len(self.levels[-1][0]) > FANOUT:
            high, least, most = self.levels[-1]
            cuts = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def search(self, p: np.ndarray, size: int) -> np.ndarray:
        """Rows whose overlap bound allows enough similarity."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            bound = np.minimum(high[nodes], p).sum(axis=1)
            fits = (bound >= needed(size, least[nodes])) & (DENOMINATOR * most[nodes] >= NUMERATOR * size) & (
                NUMERATOR * least[nodes] <= DENOMINATOR * size)
            nodes = nodes[fits]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


class Joined:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def edges(self) -> list[tuple[int, int]]:
        return [(int(r), i) for i, r in enumerate(self.root.tolist()) if r != i]


def candidate_edges(points: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all rows whose pairwise bound allows enough similarity."""
    joined = Joined(len(points))
    dims = np.array([len(p) for p in points])
    for groups in np.unique(dims).tolist():
        own = dims == groups
        members = np.flatnonzero(own | (dims == 2 * groups))
        if len(members) < 2:
            continue
        # with 2 * groups, a member is met as a point of half the groups, by members of this class only
        block = np.stack([folded(points[i].astype(np.int32), groups) for i in members])
        tree = CountTree(block, sizes[members])
        for k in np.flatnonzero(own[members]).tolist():
            hits = tree.search(block[k], int(sizes[members[k]]))
            if len(hits) > 1:
                joined.union(int(members[k]), members[hits])
    return joined.edges()


def verified_edges(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect all rows that are linked, by exact overlaps; pairs already connected are not looked at again."""
    joined = Joined(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    body = np.concatenate(sets)
    for i in range(len(sets) - 1):
        n = int(sizes[i])
        later = np.arange(i + 1, len(sets))
        open_pairs = later[(joined.root[later] != joined.root[i]) & (DENOMINATOR * sizes[later] >= NUMERATOR * n)
                           & (NUMERATOR * sizes[later] <= DENOMINATOR * n)]
        if not len(open_pairs):
            continue
        chosen = sizes[open_pairs]
        stops = np.cumsum(chosen)
        place = np.arange(stops[-1]) + np.repeat(ends[open_pairs] - stops, chosen)
        members = body[place]
        spot = np.minimum(np.searchsorted(sets[i], members), n - 1)
        overlap = np.add.reduceat(sets[i][spot] == members, stops - chosen)
        linked = open_pairs[overlap >= needed(n, chosen)]
        if len(linked):
            joined.union(i, linked)
    return joined.edges()


# --- plan -------------------------------------------------------------------------------------------------------------

def _sizes_and_counters(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``text_id, n`` of every text (written), and the shingle counters of the whole corpus."""

    def run(batches):
        counters = np.zeros(COUNTERS, np.int64)
        names = ["text_id", "n", "counters"]
        for batch, sets in batches_of_sets(batches):
            for s in sets:
                counters += np.bincount(counters_of(s), minlength=COUNTERS) if len(s) > COUNTERS // 8 else 0
            small = [s for s in sets if len(s) <= COUNTERS // 8]
            if small:
                counters += np.bincount(counters_of(np.concatenate(small)), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(sets), pa.binary())], names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([counters.tobytes()], pa.binary())], names)

    def add(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in batch.column("counters").to_pylist():
                total += np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counters"])

    both = staged(texts.select("text_id", "text").mapInArrow(run, "text_id binary, n long, counters binary"), "jaccard-sizes")
    tables = both.where("counters is not null").select("counters")
    left = tables.count()
    while left > 64:  # each task adds some tables, all of one fixed size
        left = -(-left // 32)
        tables = tables.repartition(left).mapInArrow(add, "counters binary")
    total = np.zeros(COUNTERS, np.int64)
    for row in tables.toLocalIterator():
        total += np.frombuffer(row["counters"], np.int64)
    return both.where("text_id is not null").select("text_id", "n"), total


def _blocks(texts: DataFrame, counters: np.ndarray, parts: int) -> DataFrame:
    """``block, members, text_id``: documents that share a key; one block for all keys with the same documents."""
    shared = texts.sparkSession.sparkContext.broadcast(counters)  # of fixed size

    def keys(batches):
        for batch, sets in batches_of_sets(batches):
            chosen, rows = [], []
            for i, s in enumerate(sets):
                if len(s):
                    prefix = len(s) - -(-NUMERATOR * len(s) // DENOMINATOR) + 1
                    rank = shared.value[counters_of(s)]
                    best = np.lexsort((s, rank))[:prefix]
                    chosen.append(s[best])
                    rows.append(np.full(prefix, i))
            if chosen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(chosen).view(np.int64)), batch.column("text_id").take(pa.array(np.concatenate(rows)))],
                    ["key", "text_id"])

    def groups(batches):
        """Rows come sorted by key; a key's documents are hashed to the block's name."""
        seen: set[bytes] = set()
        last, members = None, []

        def block(ids):
            if len(ids) < 2:
                return None
            words = np.frombuffer(b"".join(ids), np.uint64).reshape(-1, 2)
            h = mix(words[:, 0] ^ mix(words[:, 1]))
            with np.errstate(over="ignore"):
                name = np.array([h.sum(), mix(h * _K).sum()], np.uint64).tobytes()
            if name in seen:
                return None
            if len(seen) < 1_000_000:  # only saves sending a block's rows twice
                seen.add(name)
            return name

        for batch in batches:
            names, counts, out = [], [], []

            def flush(ids):
                name = block(ids)
                if name is not None:
                    names.extend([name] * len(ids))
                    counts.extend([len(ids)] * len(ids))
                    out.extend(ids)

            for key, who in zip(batch.column("key").to_pylist(), batch.column("text_id").to_pylist()):
                if key != last:
                    if len(members) > 1:
                        flush(members)
                    last, members = key, []
                members.append(who)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())],
                                                 ["block", "members", "text_id"])
        name = block(members)
        if name is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(members), pa.binary()), pa.array([len(members)] * len(members), pa.int64()),
                 pa.array(members, pa.binary())], ["block", "members", "text_id"])

    rows = texts.select("text_id", "text").mapInArrow(keys, "key long, text_id binary")
    placed = rows.repartition(parts, "key").sortWithinPartitions("key")
    named = placed.mapInArrow(groups, "block binary, members long, text_id binary")
    return named.dropDuplicates(["block", "text_id"])


def _chunked(rows: DataFrame, group: str, chunks, tie: str = "text_id") -> DataFrame:
    """Deal each group's rows to chunks and repeat a row for every pair of chunks that holds its own."""
    own = F.pmod(F.xxhash64(tie), F.col("_chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_chunks").cast("int") - 1),
                        lambda j: F.struct(F.least(j, F.col("_own")).alias("i"), F.greatest(j, F.col("_own")).alias("j")))
    return rows.withColumn("_chunks", chunks).withColumn("_own", own).withColumn("_pair", F.explode(pairs)).drop("_chunks", "_own")


def _edges(rows: DataFrame, group: str, parts: int, payload: str, find) -> DataFrame:
    """Run ``find(payloads)`` on each (group, pair of chunks); edges come back as pairs of text ids."""
    placed = rows.select(group, "_pair", "text_id", payload).repartition(parts, group, "_pair").sortWithinPartitions(group, "_pair")

    def run(batches):
        last, ids, values = None, [], []
        out: tuple[list, list] = ([], [])

        def solve():
            if len(ids) > 1:
                for a, b in find(values):
                    out[0].append(ids[a])
                    out[1].append(ids[b])

        def rows_of():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])
            out[0].clear()
            out[1].clear()
            return made

        for batch in batches:
            pair = batch.column("_pair")
            for g, i, j, who, value in zip(batch.column(group).to_pylist(), pair.field("i").to_pylist(), pair.field("j").to_pylist(),
                                           batch.column("text_id").to_pylist(), batch.column(payload).to_pylist()):
                if (g, i, j) != last:
                    solve()
                    last, ids, values = (g, i, j), [], []
                ids.append(who)
                values.append(value)
            if out[0]:
                yield rows_of()
        solve()
        if out[0]:
            yield rows_of()

    return placed.mapInArrow(run, "a binary, b binary")


def linked_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``text_id, n`` of every text, and ``text_id, root`` of the texts that are linked with others."""
    parts = max(shuffle_parts(texts.sparkSession), input_bytes(texts) // PART_BYTES)
    sizes, counters = _sizes_and_counters(texts)
    blocks = staged(_blocks(texts, counters, parts), "jaccard-blocks")

    def points(batches):
        for batch, sets in batches_of_sets(batches):
            packed = [point(s).tobytes() + len(s).to_bytes(8, "little") for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), pa.array(packed, pa.binary())], ["text_id", "point"])

    met = blocks.select("text_id").distinct()
    chosen = texts.select("text_id", "text").join(met, "text_id").select("text_id", "text")
    pointed = chosen.mapInArrow(points, "text_id binary, point binary")
    rows = _chunked(blocks.join(pointed, "text_id"), "block", F.ceil(F.col("members") / BLOCK_DOCS))

    def near(packed):
        sizes_ = np.array([int.from_bytes(p[-8:], "little") for p in packed], np.int64)
        return candidate_edges([np.frombuffer(p[:-8], "<u2") for p in packed], sizes_)

    clusters = components(_edges(rows, "block", parts, "point", near), "jaccard-clusters")
    clusters = clusters.withColumnRenamed("node", "text_id")

    def members(batches):
        for batch, sets in batches_of_sets(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_id"), batch.column("root"), batch.column("_chunks"), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["text_id", "root", "_size", "shingles"])

    totals = clusters.join(sizes, "text_id").groupBy("root").agg(F.ceil(F.sum("n") / CHUNK_SHINGLES).cast("long").alias("_chunks"))
    own = clusters.join(totals, "root")
    with_text = texts.select("text_id", "text").join(own, "text_id").select("text_id", "text", "root", "_chunks")
    held = with_text.mapInArrow(members, "text_id binary, root binary, _size long, shingles binary")
    rows = _chunked(held, "root", F.col("_size"))
    exact = _edges(rows, "root", parts, "shingles", lambda sets: verified_edges([np.frombuffer(s, np.uint64) for s in sets]))
    linked = components(exact, "jaccard-links")
    return sizes, linked.withColumnRenamed("node", "text_id")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_id`` of every row; ``text_id, n, least, first`` of every text.

    ``least`` is the text's smallest id, ``first`` the (least, text_id) of the component's leading text.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text_id", text_id("text"))
    sizes, linked = linked_texts(distinct_texts(rows))
    ids = rows.select("doc_id", "text_id")
    classes = sizes.join(linked, "text_id", "left").select("text_id", "n", F.coalesce("root", "text_id").alias("root"))
    least = ids.groupBy("text_id").agg(F.min("doc_id").alias("least")).join(classes, "text_id")
    order = F.struct(F.col("least").isNull().alias("none"), "least", "text_id")  # texts with ids before those without
    leading = least.groupBy("root").agg(F.min(order).alias("first"))
    return ids, least.join(leading, "root").select("text_id", "n", "least", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per input row."""
    ids, texts = _classes(docs, id_col, text_col)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first.least"))
    return ids.join(texts, "text_id").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def leading_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_id, least``: of each component with words, the text that holds its smallest id."""
    _, texts = _classes(docs, id_col, text_col)
    return texts.where((F.col("n") > 0) & (F.col("first.text_id") == F.col("text_id"))).select("text_id", "least")
