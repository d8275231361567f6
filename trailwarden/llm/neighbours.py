"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Vectors are dealt by hash to shards of about ``shard_vectors``.  Each shard builds one
graph: vectors are inserted in rounds of doubling size; a greedy beam search on the
graph so far proposes neighbours, relaxed distance pruning keeps a diverse few of them
(a candidate is dropped when a kept neighbour is closer to it than ``1 / alpha`` times
the node is), and edges are drawn back and pruned again.  Queries run a beam search
from the shard's medoid on every shard, the shards' answers are merged, and scores are
exact cosines of the original vectors in double precision.

Every row is indexed.  Equal vectors are one node that carries its ``k + 1`` smallest
ids, so a vector repeated in a third of all rows costs as much as one.  Graphs are
written once and read by query blocks; shards and blocks are bounded in size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths are never compared; a null id
takes no part; queries with fewer candidates than k get what there is; rows repeated
with one id count as one; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARD_VECTORS = 4096
BLOCK_QUERIES = 4096
DEGREE = 24
BEAM = 48
ALPHA = 1.2
SEARCH_BEAM = 64


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    good = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def beam_search(graph: np.ndarray, base: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes met (ids and similarities, best first, -1 where none) for many queries in lockstep.

    ``graph`` holds neighbour ids, -1 where there are fewer.
    """
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], near[:, 0], done[:, 0] = entry, queries @ base[entry], False
    active = np.arange(n)
    while len(active):
        pick = np.argmax(~done[active], axis=1)  # beams are sorted: the first unvisited is the best
        nodes = ids[active, pick]
        done[active, pick] = True
        fresh = graph[nodes]
        known = (fresh[:, :, None] == ids[active][:, None, :]).any(axis=2) | (fresh < 0)
        close = np.einsum("nrd,nd->nr", base[np.maximum(fresh, 0)], queries[active], optimize=True).astype(np.float32)
        close[known] = -np.inf
        all_ids = np.hstack([ids[active], np.where(known, -1, fresh)])
        all_near = np.hstack([near[active], close])
        all_done = np.hstack([done[active], known])
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        near[active] = np.take_along_axis(all_near, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
        active = active[~done[active].all(axis=1)]
    return ids, near


def robust_prune(base: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each node out of its candidates (-1 where none); squared distances of unit vectors."""
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    ordered = np.sort(candidates, axis=1)
    candidates = np.where(np.hstack([np.zeros((len(nodes), 1), bool), ordered[:, 1:] == ordered[:, :-1]]), -1, ordered)
    vectors = base[np.maximum(candidates, 0)]
    far = 2 - 2 * np.einsum("ncd,nd->nc", vectors, base[nodes], optimize=True)
    far[candidates < 0] = np.inf
    kept = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for i in range(degree):
        best = np.argmin(far, axis=1)
        some = np.isfinite(far[rows, best])
        if not some.any():
            break
        kept[some, i] = candidates[rows, best][some]
        chosen = vectors[rows, best]
        between = 2 - 2 * np.einsum("ncd,nd->nc", vectors, chosen, optimize=True)
        far[(alpha * alpha * between <= far) & some[:, None]] = np.inf
        far[rows, best] = np.inf
    return kept


def build_graph(base: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Neighbour table and entry node of unit vectors."""
    n = len(base)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(np.argmax(base @ base.mean(axis=0)))
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    at, width = 1, 1
    while at < n:
        new = order[at:at + width]
        found, _ = beam_search(graph, base, base[new], entry, beam)
        graph[new] = robust_prune(base, new, found, degree, alpha)
        # edges back, grouped by their node
        tails = np.repeat(new, degree)
        heads = graph[new].ravel()
        tails, heads = tails[heads >= 0], heads[heads >= 0]
        by = np.argsort(heads, kind="stable")
        tails, heads = tails[by], heads[by]
        touched, first, counts = np.unique(heads, return_index=True, return_counts=True)
        for many in np.unique(counts).tolist():
            rows = counts == many
            some = touched[rows]
            more = tails[first[rows][:, None] + np.arange(many)]
            graph[some] = robust_prune(base, some, np.hstack([graph[some], more]), degree, alpha)
        at += len(new)
        width = min(2 * width, 512)
    return graph, entry


def build_index(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
                shard_vectors: int = SHARD_VECTORS, degree: int = DEGREE, beam: int = BEAM) -> tuple[DataFrame, int]:
    """The written graphs, one row per different vector (``shard, node, ids, v, edges, entry``), and the number of shards."""
    base = usable(rows, id_col, vector_col)
    few = Window.partitionBy("v").orderBy("vec_id")
    kept = base.distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    nodes = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    shards = max(1, -(-rows.count() // shard_vectors))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.map(lambda x: x[0]), ignore_index=True)
        graph, entry = build_graph(unit(np.stack(pdf["v"].tolist())).astype(np.float32), degree, beam)
        return pdf.assign(node=np.arange(len(pdf)), edges=[row[row >= 0] for row in graph], entry=entry)[
            ["shard", "dim", "node", "ids", "v", "edges", "entry"]]

    built = dealt.groupBy("shard", "dim").applyInPandas(
        run, "shard int, dim int, node int, ids array<long>, v array<double>, edges array<long>, entry int")
    return staged(built, "neighbour-graphs"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           beam: int = SEARCH_BEAM, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: every query searches every shard, the best k are kept."""
    asked = usable(queries, id_col, vector_col).distinct()
    blocks = max(1, -(-queries.count() // block_queries))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("dim", F.size("v"))

    def run(nodes: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(nodes) and len(q):
            nodes = nodes.sort_values("node", ignore_index=True)
            exact = unit(np.stack(nodes["v"].tolist()))
            asked_unit = unit(np.stack(q["v"].tolist()))
            width = max(1, max(map(len, nodes["edges"])))
            graph = np.full((len(nodes), width), -1, np.int64)
            for i, edges in enumerate(nodes["edges"]):
                graph[i, :len(edges)] = edges
            ids = nodes["ids"].tolist()
            base, entry = exact.astype(np.float32), int(nodes["entry"].iloc[0])
            for a in range(0, len(q), 512):
                found, _ = beam_search(graph, base, asked_unit[a:a + 512].astype(np.float32), entry, beam)
                for i, row in enumerate(found):
                    row = row[row >= 0]
                    scores = exact[row] @ asked_unit[a + i]
                    own = int(q["vec_id"].iloc[a + i])
                    hits = sorted((-float(s), int(v)) for n, s in zip(row.tolist(), scores.tolist()) for v in ids[n] if v != own)[:k]
                    out += [(own, v, -s) for s, v in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("shard", "dim", "block").cogroup(right.groupBy("shard", "dim", "block")).applyInPandas(
        run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """Build the index over ``rows`` and search it for ``queries``."""
    index, shards = build_index(rows, k, id_col, vector_col, shard_vectors)
    return search(index, shards, queries, k, id_col, vector_col)
