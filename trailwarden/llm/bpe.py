"""Byte-level BPE encoding and decoding with a segment tree over adjacent pairs.

The leaves of the tree are the symbols of one word; a leaf holds the merge rank
of the pair that starts there.  The root names the leftmost pair of the lowest
rank.  A merge changes three leaves, each repaired in logarithmic time, so a
word of n bytes takes O(n log n) however long it is; the merging stops when the
root is empty.

The vocabulary is a ``tokenizers`` JSON file (a path every worker can read).
Strings of added tokens inside a text become their ids, as in that library.

Defined results: a null or empty text has no ids and decodes to the empty
string; ids outside the vocabulary or null decode to nothing; bytes that are no
UTF-8 decode to U+FFFD; repeated rows are encoded each; all other columns are
left out.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, list_column, text_slices
from .tokens import SLICE_BYTES, PieceEncoder, by_units

PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        letters = byte_alphabet()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pretoken = regex.compile(PRETOKEN)
        self.bytes_of = [b""] * (1 + max([*ids.values(), *added.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.bytes_of.append(b"")

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word.

        A tree node is the least ``rank * 2^32 + leaf`` below it, so the root is
        the leftmost of the lowest-ranked pairs.
        """
        symbols = [self.byte_ids[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        ranks = self.ranks
        size = 1 << (n - 2).bit_length()
        tree = [NO_PAIR] * (2 * size)
        for i in range(n - 1):
            rank = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            if tree[i] == value:
                return
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                least = value if value < other else other
                if tree[i] == least:
                    return
                tree[i] = value = least

        while (root := tree[1]) != NO_PAIR:
            i = root & 0xFFFFFFFF
            j = after[i]
            symbols[i] = merged = self.merged[root >> 32]
            symbols[j] = -1
            after[i] = k = after[j]
            if j < n - 1:
                put(j, NO_PAIR)
            if k < n:
                before[k] = i
                rank = ranks.get(merged << 20 | symbols[k])
                put(i, NO_PAIR if rank is None else rank << 32 | i)
            else:
                put(i, NO_PAIR)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] << 20 | merged)
                put(h, NO_PAIR if rank is None else rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        if self.splitter is None or not self.splitter.search(text):
            return [i for word in self.pretoken.findall(text) for i in self.merge(word.encode("utf-8"))]
        ids: list[int] = []
        for part in self.splitter.split(text):
            if part in self.added:
                ids.append(self.added[part])
                continue
            for word in self.pretoken.findall(part):
                ids += self.merge(word.encode("utf-8"))
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, tuple[Vocabulary, PieceEncoder]] = {}


def vocabulary(path: str) -> tuple[Vocabulary, PieceEncoder]:
    """One per Python worker."""
    if path not in _LOADED:
        vocab = Vocabulary(path)
        _LOADED[path] = vocab, PieceEncoder(True, by_units(vocab.encode), vocab.added)
    return _LOADED[path]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: one row per input row, no shuffle."""

    def run(batches):
        _, encoder = vocabulary(vocab_path)
        for batch in (b for whole in batches for b in text_slices(whole, limit=SLICE_BYTES)):
            flat, offsets = encoder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(flat.view("<i4"), offsets)], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: one row per input row, no shuffle."""

    def run(batches):
        vocab, _ = vocabulary(vocab_path)
        n = len(vocab.bytes_of) - 1
        for batch in batches:
            column = batch.column("ids")
            offsets = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
            flat = column.flatten()
            ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids[(ids < 0) | (ids >= n)] = n  # one past the vocabulary: decodes to nothing
            texts = pa.array([vocab.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, texts], ["doc_id", "ids", "text"])

    chosen = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return chosen.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Contract form: ids and decoded text of every document as digests."""
    decoded = decode(encode(docs, vocab_path), vocab_path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
