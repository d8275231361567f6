"""Exact top-k by integer inner product with multi-resolution segment statistics.

An inner product is ``(|q|^2 + |v|^2 - d^2) / 2``.  For vectors cut into segments of
``s`` components, segment means and deviations bound the distance from below:
``d^2 >= sum s * ((mean_q - mean_v)^2 + (dev_q - dev_v)^2)``, tighter with every halving of
``s``.  A block of candidates is met by a block of queries, each level's bounds being one
matrix product: the best bounds are looked at exactly first, which sets the score to
beat; pairs whose bound, coarse to fine, cannot reach it are put aside; exact scores are
one product of what is left.  Nothing that could rank is left out, so the result is exact.

Equal integer vectors are one candidate that carries its ``k + 1`` smallest ids (no
query can list more of them: it takes at most k, besides itself), so a vector
repeated in a third of all rows costs as much as one.  Candidates and queries are
dealt in blocks of bounded size; every block pair is a task's group.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part; vectors of different lengths are never compared; queries with fewer
candidates than k get all of them; scores beyond 64 bits are clipped; a null id
takes no part; rows repeated with one id count as one candidate and one query; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VECTORS = 16384
BLOCK_QUERIES = 4096
SEGMENTS = (1, 8, 32)
AT_ONCE = 256
EXACT_FLOAT = 2.0 ** 52


def quantized(rows: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of the vectors that take part (held as whole doubles)."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size("raw") > 0) & F.forall(
        "raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("raw", lambda x: _floor(x * F.lit(float(scale))))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("raw")).where(good).select(
        "vec_id", whole.alias("v")).where(F.forall("v", lambda x: F.abs(x) < float("inf")))


def _floor(x: Column) -> Column:
    """Floor that stays a double beyond the range of a long."""
    return F.when(F.abs(x) < EXACT_FLOAT, F.floor(x).cast("double")).otherwise(x)


def segment_statistics(m: np.ndarray, parts: int) -> np.ndarray:
    """Rows of ``sqrt(s) * (means, deviations)``, one pair per segment: distances of rows bound distances of vectors."""
    cuts = np.array_split(np.arange(m.shape[1]), min(parts, m.shape[1]))
    mean = np.stack([m[:, c].mean(axis=1) for c in cuts], axis=1)
    dev = np.stack([m[:, c].std(axis=1) for c in cuts], axis=1)
    root = np.sqrt([len(c) for c in cuts])
    return np.hstack([mean * root, dev * root])


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * vectors.shape[1]
    if top < EXACT_FLOAT:
        return (vectors @ query).astype(np.int64)
    if top < 2.0 ** 62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    q = [int(x) for x in query]
    full = [sum(int(a) * b for a, b in zip(row, q)) for row in vectors]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in full], np.int64)


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1]
    if top < EXACT_FLOAT:
        return (queries @ vectors.T).astype(np.int64)
    return np.stack([exact_scores(vectors, q) for q in queries])


def block_topk(vectors: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int,
               survivors: list | None = None):
    """Rows (query_id, vec_id, score) that hold each query's k best of this block; ``survivors`` gets the pairs left per level."""
    norm, qnorm = (vectors ** 2).sum(axis=1), (queries ** 2).sum(axis=1)
    slack = 1e-9 * (norm.max(initial=0) + qnorm.max(initial=0)) + 1e-6
    levels = [(segment_statistics(vectors, p), segment_statistics(queries, p)) for p in SEGMENTS]
    # bound on the score: (|q|^2 + |v|^2 - lower bound of d^2) / 2, with d^2 expanded to one product
    rests = [((norm - (a ** 2).sum(axis=1)) / 2, (qnorm - (b ** 2).sum(axis=1)) / 2 + slack) for a, b in levels]
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(queries), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        asked = queries[some]
        columns = np.arange(len(vectors))
        floor = np.full(len(asked), -np.inf)
        alive = np.ones((len(asked), len(vectors)), bool)
        for (a, b), (rest, q_rest) in zip(levels, rests):
            bound = b[some] @ a[columns].T + rest[columns] + q_rest[some][:, None]
            if len(columns) > 4 * k and not np.isfinite(floor).any():
                first = np.argpartition(-bound, 2 * k, axis=1)[:, :2 * k]
                scores = np.stack([exact_scores(vectors[c], q) for c, q in zip(first, asked)])
                # one of them may be the query itself
                floor = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1].astype(float)
            alive &= bound >= floor[:, None]
            keep = alive.any(axis=0)
            columns, alive = columns[keep], alive[:, keep]
            if survivors is not None:
                survivors.append(int(alive.sum()))
        scores = exact_products(asked, vectors[columns])
        for i, row in enumerate(scores):
            left = np.flatnonzero(alive[i])
            if len(left) > k + 1:
                least = np.partition(row[left], len(left) - k - 1)[len(left) - k - 1]
                left = left[row[left] >= least]
            query = int(query_ids[at + i])
            got = sorted((-s, v) for c, s in zip(columns[left].tolist(), row[left].tolist()) for v in ids[c].tolist() if v != query)[:k]
            out_q += [query] * len(got)
            out_v += [v for _, v in got]
            out_s += [-s for s, _ in got]
    return out_q, out_v, out_s


def search(rows: DataFrame, queries: DataFrame, k: int, scale: float = 64.0, id_col: str = "vec_id",
           vector_col: str = "embedding", block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of every row of ``rows`` for each row of ``queries``."""
    base = quantized(rows, scale, id_col, vector_col)
    few = Window.partitionBy("v").orderBy("vec_id")
    kept = base.distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    candidates = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = quantized(queries, scale, id_col, vector_col).distinct()
    n_rows, n_asked = rows.count(), queries.count()
    v_blocks, q_blocks = max(1, -(-n_rows // block_vectors)), max(1, -(-n_asked // block_queries))
    left = candidates.select(
        F.pmod(F.xxhash64("v"), F.lit(v_blocks)).cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), "v", "ids")
    right = asked.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))).alias("vb"), "v", "vec_id")

    def run(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(c) and len(q):
            for dim in sorted(set(map(len, c["v"])) & set(map(len, q["v"]))):
                a, b = c[c["v"].map(len) == dim], q[q["v"].map(len) == dim]
                parts.append(block_topk(np.stack(a["v"].tolist()).astype(float), [np.asarray(x, np.int64) for x in a["ids"]],
                                        np.stack(b["v"].tolist()).astype(float), b["vec_id"].to_numpy(), k))
        columns = [sum((p[i] for p in parts), []) for i in range(3)]
        return pd.DataFrame({"query_id": pd.Series(columns[0], dtype="int64"), "vec_id": pd.Series(columns[1], dtype="int64"),
                             "score": pd.Series(columns[2], dtype="int64")})

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(
        run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
