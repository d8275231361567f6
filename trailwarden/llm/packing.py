"""Packing of token sequences: first-fit decreasing in randomised groups.

Every document is cut at multiples of the sequence length; only its last piece
is shorter.  Pieces are dealt by a hash to groups of about ``group_docs`` documents,
and of ``group_bytes`` of text if that makes more groups; within a group first-fit decreasing places each piece into the first open
sequence with room.  A tournament tree over the free room of the sequences finds
that one in logarithmic time.  What stays free is small once a group has some
hundred pieces, so groups are independent, a group's memory is bounded by the
parameter, and the plan has one shuffle.  A sequence whose length is a power of
two is not padded.

Defined results: a null or empty text has the end id alone; a null ``doc_id`` is
kept; a text of any length is cut into pieces that go to different groups; pieces of
equal length are placed in order of document, copy and start; repeated rows are packed each (numbered by ``copy``); an empty table gives
no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, list_column, text_slices
from .token_files import crc32_of_ids
from .tokens import SLICE_BYTES, library_encoder, with_end

SEQUENCE = 2048
GROUP_DOCS = 2048
GROUP_BYTES = 8 << 20


class RoomTree:
    """Tournament tree of the free room in open sequences; finds the first with enough."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.node = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        node, size, i = self.node, self.size, 1
        while i < size:
            i = 2 * i if node[2 * i] >= need else 2 * i + 1
        found = i - size
        node[i] -= need
        i >>= 1
        while i:
            best = max(node[2 * i], node[2 * i + 1])
            if node[i] == best:
                break
            node[i] = best
            i >>= 1
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece (lengths within 1..capacity)."""
    order = np.argsort(-lengths, kind="stable")
    tree = RoomTree(max(1, len(lengths)), capacity)
    used: dict[int, int] = {}
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        b = tree.place(need)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + need
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE, with_space: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, copy, start, length, doc_tokens, ids``: the pieces of every whole text, no shuffle.

    ``copy`` numbers the input rows and keeps pieces of rows with equal ids apart.
    """

    def run(batches):
        encoder = library_encoder(tokenizer_path, with_space)
        for batch in (b for whole in batches for b in text_slices(whole, limit=SLICE_BYTES)):
            flat, offsets = with_end(*encoder.encode(batch.column("text")), end_id)
            total = np.diff(offsets)
            many = -(-total // sequence)
            row = np.repeat(np.arange(len(total)), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * sequence
            length = np.minimum(sequence, total[row] - start)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("copy").take(at), pa.array(start), pa.array(length), pa.array(total[row]),
                 list_column(flat.view("<i4"), np.concatenate([[0], np.cumsum(length)]))],
                ["doc_id", "copy", "start", "length", "doc_tokens", "ids"])

    numbered = id_text(docs, id_col, text_col).withColumn("copy", F.monotonically_increasing_id())
    return numbered.mapInArrow(
        run, "doc_id long, copy long, start long, length long, doc_tokens long, ids array<int>")


def pack(piece_rows: DataFrame, groups: int, sequence: int = SEQUENCE, seed: int = 17) -> DataFrame:
    """Add ``sequence_id`` (group and number of the sequence in it: unique, not dense) and ``offset``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("copy", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), sequence)
        first = group.column("group")[0].as_py() << 32
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(first + bins)).append_column(
            "offset", pa.array(offsets))

    dealt = piece_rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(
        run, "doc_id long, copy long, start long, length long, doc_tokens long, ids array<int>, "
             "sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE,
                   group_docs: int = GROUP_DOCS, with_space: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Encode, cut and pack whole texts; the number of groups follows the number and the bytes of the documents."""
    rows, size = id_text(docs).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-rows // group_docs), -(-size // group_bytes))
    return pack(pieces(docs, tokenizer_path, end_id, sequence, with_space), groups, sequence)


def digests(packed: DataFrame) -> DataFrame:
    """Contract form: the ids of each piece as their unsigned CRC-32."""
    rows = packed.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    return crc32_of_ids(rows)
