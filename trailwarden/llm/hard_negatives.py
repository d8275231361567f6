"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps.

Candidates are sorted by length, label and their place on a Hilbert curve through the
components of largest deviation, and written to Parquet as blocks of neighbouring
vectors of one label.  A block's row carries its zone map, the least and greatest value of
every component; reading the zone maps does not read the vectors.  For an anchor with
components ``q`` the inner product with any vector of a block lies between the sums of
``min(q * least, q * greatest)`` and ``max(q * least, q * greatest)``.  These bounds choose
the blocks that an anchor must read:

1. each anchor reads the block of its label with the highest bound; the score of its
   ``positives``-th best row there is a floor;
2. it reads every block of its label whose bound reaches that floor, which gives its positives;
3. each positive's score sets a window of scores, and the anchor reads every block of other
   labels whose interval meets one of its windows.

A task holds one group of anchors and one shard of blocks, keeps the best rows of every
window met so far, and leaves out blocks that can no longer add to them.  Nothing that could
rank is left out, so the result is exact.

Defined results: rows with a null id or label and vectors that are null, empty or hold null
or non-finite components take no part; rows repeated with one id are the one of smallest label
and vector; vectors of different lengths are never compared; scores beyond 64 bits are
clipped; equal scores are ranked by smaller id; an anchor with fewer positives or negatives
gets what there is, a positive without negatives no row; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import list_column, staged

BLOCK_VECTORS = 512
SHARD_VECTORS = 32768
GROUP_ANCHORS = 1024
CURVE_DIMS, CURVE_BITS = 12, 5
EXACT_FLOAT = 2.0 ** 52
LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCK_SCHEMA = ("shard int, block long, dim int, label long, n int, least array<double>, greatest array<double>, "
                "ids array<long>, v array<double>")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer grid cells (rows) on the Hilbert curve of a cube with ``2 ** bits`` cells a side.

    The grid is turned from the coarsest bit down so that each cell's quadrant comes in
    curve order, then read as a Gray code; rows times bits must stay below 63.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        top, below = 1 << level, (1 << level) - 1
        for i in range(len(axes)):
            high = (axes[i] & top) > 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & below)
            axes[i] = axes[i] ^ swap
            axes[0] = axes[0] ^ np.where(high, below, swap)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    place = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            place = (place << 1) | (((axis ^ flip) >> level) & 1)
    return place


def interval_bounds(q: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every row of ``q`` with the vectors of every zone."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low, high = up @ least.T + down @ greatest.T, up @ greatest.T + down @ least.T
    reach = np.abs(q) @ np.maximum(np.abs(least), np.abs(greatest)).T
    slack = np.where(reach < EXACT_FLOAT, 0.0, 1e-12 * reach)
    return low - slack, high + slack


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole doubles."""
    top = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if top < EXACT_FLOAT:
        return (q @ v.T).astype(np.int64)
    if top < 2.0 ** 62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    a, b = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in v]
    return np.array([[min(max(sum(x * y for x, y in zip(r, s)), LEAST), MOST) for s in b] for r in a], np.int64).reshape(len(a), len(b))


def candidates(rows: DataFrame, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """``vec_id, label, dim, v``: one row per id, components as whole doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.when(F.abs(x) < EXACT_FLOAT, F.floor(x).cast("double")).otherwise(x)
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    scaled = good.withColumn("v", F.transform("v", lambda x: whole(x * F.lit(float(scale))))).where(
        F.forall("v", lambda x: F.abs(x) < float("inf")))
    once = scaled.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return once.select("vec_id", "r.label", F.size("r.v").alias("dim"), "r.v")


def _component_sums(rows: DataFrame) -> DataFrame:
    """``dim, mean, deviation`` per vector length, from sums of every batch."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat, offsets = batch.column("v").flatten().to_numpy(), batch.column("v").offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                at = offsets[:-1][dims == dim] - offsets[0]
                m = flat[at[:, None] + np.arange(dim)]
                for i, (s, r) in enumerate(zip(m.sum(axis=0).tolist(), (m * m).sum(axis=0).tolist())):
                    yield pa.RecordBatch.from_pylist([{"dim": dim, "i": i, "n": len(m), "s": s, "r": r}])

    def gathered(batches):
        found = list(run(batches))
        if found:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    sums = rows.select("dim", "v").mapInArrow(gathered, "dim long, i long, n long, s double, r double")
    each = sums.groupBy("dim", "i").agg((F.sum("s") / F.sum("n")).alias("mean"), (F.sum("r") / F.sum("n")).alias("square"))
    deviation = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return each.groupBy(F.col("dim").cast("int").alias("dim")).agg(
        F.sort_array(F.collect_list(F.struct("i", "mean", deviation.alias("dev")))).alias("s")).select(
        "dim", F.col("s.mean").alias("mean"), F.col("s.dev").alias("dev"))


def on_curve(rows: DataFrame) -> DataFrame:
    """Add ``curve``, the Hilbert index over the components of largest deviation."""

    def run(batches):
        for batch in batches:
            curve = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            vectors = batch.column("v")
            flat, first = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim)
                row = int(some[0])
                mean, dev = (np.array(batch.column(c)[row].as_py()) for c in ("mean", "dev"))
                used = np.argsort(-dev, kind="stable")[:CURVE_DIMS]
                x = flat[first[some][:, None] + used]
                with np.errstate(all="ignore"):
                    z = np.nan_to_num((x - mean[used]) / dev[used])
                cells = np.clip(np.floor((z + 2.5) / 5 * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1)
                curve[some] = hilbert_index(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "dim", "v")), pa.array(curve)], ["vec_id", "label", "dim", "v", "curve"])

    sums = _component_sums(rows)
    return rows.join(sums, "dim").select("vec_id", "label", "dim", "v", "mean", "dev").mapInArrow(
        run, "vec_id long, label long, dim int, v array<double>, curve long")


def build_blocks(rows: DataFrame, shard_vectors: int = SHARD_VECTORS, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Written blocks of ``candidates`` rows in curve order, a shard being a range of them."""

    def run(batches):
        shard, block, held = None, 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            shard = table.column("shard")[0].as_py()
            dim, label = table.column("dim").to_numpy(), table.column("label").to_numpy()
            new = np.flatnonzero((np.diff(dim) != 0) | (np.diff(label) != 0)) + 1
            edges = [0, *new.tolist(), len(dim)]
            out = []
            for a, b in zip(edges, edges[1:]):
                last = b == len(dim)
                for at in range(a, b, block_vectors):
                    end = min(at + block_vectors, b)
                    if last and end == b:  # may go on in the next batch
                        held = table.slice(at, end - at)
                        break
                    out.append((block, table.slice(at, end - at)))
                    block += 1
            yield from (_block(shard, *x) for x in out)
        if held is not None:
            yield _block(shard, block, held)

    shards = max(1, -(-rows.count() // shard_vectors))
    order = ["dim", "label", "curve", "vec_id"]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    blocks = staged(dealt.mapInArrow(run, BLOCK_SCHEMA), "negatives-blocks")
    # Spark may have dealt more parts than asked for: neighbouring parts are one shard then
    parts = 1 + blocks.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    return blocks.withColumn("shard", F.floor(F.col("shard") * shards / parts).cast("int"))


def _block(shard: int, block: int, rows: pa.Table) -> pa.RecordBatch:
    dim = rows.column("dim")[0].as_py()
    flat = rows.column("v").combine_chunks().flatten().to_numpy()
    m = flat.reshape(-1, dim)
    one = np.array([0, len(m)])
    lists = [list_column(x, np.array([0, len(x)])) for x in (m.min(axis=0), m.max(axis=0), rows.column("vec_id").to_numpy(), flat)]
    plain = [pa.array([x], t) for x, t in ((shard, pa.int32()), ((shard << 32) + block, pa.int64()), (dim, pa.int32()),
                                          (rows.column("label")[0].as_py(), pa.int64()), (int(one[1]), pa.int32()))]
    return pa.RecordBatch.from_arrays(plain + lists, ["shard", "block", "dim", "label", "n", "least", "greatest", "ids", "v"])


def _same_length(zones: pd.DataFrame, asks: pd.DataFrame):
    for dim in sorted(set(zones["dim"]) & set(asks["dim"])):
        z, q = zones[zones["dim"] == dim], asks[asks["dim"] == dim]
        yield z, q, np.stack(q["v"].tolist())


def _eligible(z: pd.DataFrame, q: pd.DataFrame, same: bool) -> np.ndarray:
    return (z["label"].to_numpy()[None, :] == q["label"].to_numpy()[:, None]) == same


def choose_blocks(blocks: DataFrame, asks: DataFrame, same: bool, best_only: bool = False) -> DataFrame:
    """``grp, shard, block, who``: which anchors of a group must read which block, from zone maps alone.

    A block is read for an anchor if its label is the same (or not the same) and its
    interval meets a window of the anchor; with ``best_only``, if none has a higher bound.
    """

    def run(z: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for z, q, m in _same_length(z, q):
            low, high = interval_bounds(m, np.stack(z["least"].tolist()), np.stack(z["greatest"].tolist()))
            fits = _eligible(z, q, same)
            if not best_only:
                meets = np.zeros_like(fits)
                for i, (a, b) in enumerate(zip(q["low"], q["high"])):
                    meets[i] = ((low[i] <= np.asarray(b)[:, None]) & (high[i] >= np.asarray(a)[:, None])).any(axis=0)
                fits &= meets
            else:
                high = np.where(fits, high, -np.inf)
                fits &= np.arange(len(z)) == high.argmax(axis=1)[:, None]
            ids, shard, block, grp = q["vec_id"].to_numpy(), z["shard"].to_numpy(), z["block"].to_numpy(), q["grp"].iloc[0]
            for j in np.flatnonzero(fits.any(axis=0)).tolist():
                who = fits[:, j]
                out.append((grp, shard[j], block[j], ids[who], high[who, j]))
        return pd.DataFrame(out, columns=["grp", "shard", "block", "who", "bound"])

    zones = blocks.select("shard", "block", "dim", "label", "least", "greatest")
    last = [frame.agg(F.coalesce(F.max(c), F.lit(0))).first()[0] for frame, c in ((blocks, "shard"), (asks, "grp"))]
    left = zones.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(last[1]))))
    right = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last[0]))))
    chosen = left.groupBy("grp", "shard").cogroup(right.groupBy("grp", "shard")).applyInPandas(
        run, "grp int, shard int, block long, who array<long>, bound array<double>")
    if not best_only:
        return chosen.drop("bound")
    each = chosen.select("grp", "shard", "block", F.explode(F.arrays_zip("who", "bound")).alias("w"))
    best = each.groupBy("grp", F.col("w.who").alias("vec_id")).agg(
        F.max(F.struct("w.bound", "shard", "block")).alias("b"))
    return best.groupBy("grp", "b.shard", "b.block").agg(F.collect_list("vec_id").alias("who"))


class BestRows:
    """The best ``k`` rows of every window met so far."""

    def __init__(self, windows: int, k: int):
        self.k, self.floor = k, np.full(windows, LEAST, np.int64)
        self.row = self.score = self.ids = np.zeros(0, np.int64)

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, ~score, row))  # ~ turns the order around without overflow
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[row[full]] = score[full]
        self.row, self.score, self.ids = row[keep], score[keep], ids[keep]


def read_blocks(blocks: DataFrame, chosen: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """``vec_id, tag, other, score``: the best ``k`` rows in every window of every anchor, from the chosen blocks."""

    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for z, q, m in _same_length(data, asked):
            ids = q["vec_id"].to_numpy()
            place = dict(zip(ids.tolist(), range(len(ids))))
            counts = q["tags"].map(len).to_numpy()
            owner = np.repeat(np.arange(len(q)), counts)
            first = np.concatenate([[0], np.cumsum(counts)])
            tags, low, high = (np.concatenate(q[c].tolist()).astype(np.int64) for c in ("tags", "low", "high"))
            best = BestRows(len(owner), k)
            for who, least, greatest, own, body in zip(z["who"], z["least"], z["greatest"], z["ids"], z["v"]):
                at = np.array([place[w] for w in who.tolist()])
                lines = np.concatenate([np.arange(first[i], first[i + 1]) for i in at])
                under, bound = interval_bounds(m[at], least[None, :], greatest[None, :])
                under, bound = np.repeat(under[:, 0], counts[at]), np.repeat(bound[:, 0], counts[at])
                lines = lines[(bound >= np.maximum(low[lines], best.floor[lines])) & (under <= high[lines])]
                need = np.unique(owner[lines])
                if not len(need):
                    continue
                score = products(m[need], np.asarray(body).reshape(len(own), -1))[np.searchsorted(need, owner[lines])]
                fits = (score >= np.maximum(low[lines], best.floor[lines])[:, None]) & (score <= high[lines][:, None]) & (
                    own[None, :] != ids[owner[lines]][:, None])
                line, column = np.nonzero(fits)
                best.offer(lines[line], score[line, column], own[column])
            out.append(pd.DataFrame({"vec_id": ids[owner[best.row]], "tag": tags[best.row], "other": best.ids, "score": best.score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("vec_id", "tag", "other", "score")})

    chosen = staged(chosen, "negatives-chosen")
    left = chosen.join(blocks.drop("label", "n"), ["shard", "block"])
    tasks = chosen.select(F.col("grp").alias("g"), F.col("shard").alias("s")).distinct()
    right = asks.join(tasks, F.col("grp") == F.col("g")).select(
        F.col("g").alias("grp"), F.col("s").alias("shard"), "vec_id", F.col("dim").alias("dim"), "v", "tags", "low", "high")
    found = left.groupBy("grp", "shard").cogroup(right.groupBy("grp", "shard")).applyInPandas(
        run, "vec_id long, tag long, other long, score long")
    ranked = Window.partitionBy("vec_id", "tag").orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low_tenths: int = 3, high_tenths: int = 9,
         scale: float = 256.0, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         shard_vectors: int = SHARD_VECTORS, block_vectors: int = BLOCK_VECTORS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on ``vec_id``.  A negative's score lies between ``low_tenths``
    and ``high_tenths`` tenths of the positive's.
    """
    base = staged(on_curve(staged(candidates(rows, scale, id_col, label_col, vector_col), "negatives-rows")), "negatives-curve")
    blocks = build_blocks(base, shard_vectors, block_vectors)
    asked = base.where(anchors).drop("curve")
    groups = max(1, -(-asked.count() // group_anchors))
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    every = asked.select("*", F.array(F.lit(0).cast("long")).alias("tags"), F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high"))
    seeds = read_blocks(blocks, choose_blocks(blocks, every, same=True, best_only=True), every, positives)
    floor = seeds.where(F.col("rank") == positives).select("vec_id", F.array("score").alias("reached"))
    near = staged(every.join(floor, "vec_id", "left").withColumn("low", F.coalesce("reached", "low")).drop("reached"), "negatives-floors")
    best = staged(read_blocks(blocks, choose_blocks(blocks, near, same=True), near, positives), "negatives-positives")
    # tenths of a 64-bit score without overflow: 10 q + r
    score = F.col("score")
    tens, ones = F.expr("score div 10"), score % 10
    low = tens * low_tenths + F.ceil(ones * low_tenths / F.lit(10.0))
    high = tens * high_tenths + F.floor(ones * high_tenths / F.lit(10.0))
    windows = best.select("vec_id", F.struct(F.col("other").alias("tag"), low.alias("low"), high.alias("high")).alias("w")).where("w.low <= w.high")
    lists = windows.groupBy("vec_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    wanted = staged(asked.join(lists, "vec_id").select(
        "vec_id", "label", "dim", "v", "grp", F.col("w.tag").alias("tags"), F.col("w.low").alias("low"), F.col("w.high").alias("high")),
        "negatives-windows")
    found = read_blocks(blocks, choose_blocks(blocks, wanted, same=False), wanted, negatives)
    scores = best.select("vec_id", F.col("other").alias("tag"), F.col("score").alias("positive_score"))
    return found.join(scores, ["vec_id", "tag"]).select(
        F.col("vec_id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
