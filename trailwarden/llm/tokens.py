"""Token ids of whole texts, by way of the distinct pieces of a slice.

A token never spans the place where white space begins, nor a letter followed by a mark.
Texts are first cut at such places, on their bytes, a slice of texts at once; the pieces are dictionary-encoded in
Arrow, so that every distinct piece of a slice is looked up once and only those not met
before are encoded.  The ids of a slice are then gathered from the ids of its pieces.
Known pieces are two Arrow buffers; beyond ``CACHE_PIECES`` only those of the present slice
stay, which costs time only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

# white space as the tokenizers' patterns see it: \s of `re` without the four ASCII separators
_WS, _NON_WS = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
# letters and marks on which all engines agree; between the two a token always ends
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,!?;:|$%&#*]"
_WORD = f"{_LETTERS}++(?={_MARKS}|{_WS}|\\Z)|{_NON_WS}++"
UNIT = re.compile(f"{_WS}*+(?:{_WORD})|{_WS}+")
# one word of letters that stay letters in lower case: a single word to the tokenizers
_ONE_WORD = "[A-Za-zÀ-ÖØ-öø-ÿĀ-įı-ɏА-яぁ-ゖァ-ヺ一-龥]++"
CACHE_PIECES = 1 << 19
SLICE_BYTES = 1 << 21  # of text that is encoded at once
AT_ONCE = 2000
# bytes that cannot begin white space: a blank before one of them is a token edge
_PLAIN = np.ones(256, bool)
_PLAIN[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER, _INK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_INK[33:127] = True

Encoded = tuple[np.ndarray, np.ndarray]  # ids of some pieces, one after another, and how many each has


class PieceEncoder:
    """Texts to unsigned 32-bit ids; ``encode_pieces`` encodes a list of distinct pieces.

    ``with_space`` tells whether white space belongs to the word after it or is left out;
    ``added`` are the vocabulary's added tokens, which no cut may split.
    """

    def __init__(self, with_space: bool, encode_pieces: Callable[[list[str]], Encoded], added: Iterable[str] = ()):
        self.with_space, self.encode_pieces = with_space, encode_pieces
        inside = {b for token in added for a, b in zip(token, token[1:]) if a.isalpha()}
        self.mark = np.zeros(256, bool)
        self.mark[[ord(c) for c in ".,!?;:|$%&#*" if c not in inside]] = True
        self.known, self.flat, self.sizes = pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts, one after another, and where each text's begin."""
        body, offsets = text_bytes(texts)
        first = np.zeros(len(body) + 1, bool)
        if len(body):
            blank = body == 32
            if self.with_space:
                first[:-2] = blank[:-1] & _PLAIN[body[1:]]
                first[np.maximum(offsets[1:] - 1, 0)] = False  # a blank that ends a text
            else:
                first[:-1] = blank
            letter = _LETTER[body]
            letter[1:] |= (body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7)
            first[1:-1] |= letter[:-1] & self.mark[body[1:]] | (letter[:-1] | _INK[body[:-1]]) & (body[1:] == 10)
            first[offsets[:-1]] = True
            first[-1] = False
        starts = np.flatnonzero(first)
        at = np.append(starts, len(body)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(body)])
        return pieces, np.concatenate([[0], np.cumsum(first)])[offsets]

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces are kept; the new ones are encoded first."""
        found = pc.index_in(pieces, value_set=self.known)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = pieces.take(pa.array(missing))
            flat, sizes = self.encode_pieces(new.cast(pa.string()).to_pylist())
            place[missing] = len(self.known) + np.arange(len(missing))
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text's."""
        pieces, at = self.cut(texts)
        coded = pieces.dictionary_encode()
        place = self.places(coded.dictionary)
        begins, sizes = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        code = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[code])])
        out = self.flat[np.repeat(begins[code] - ends[:-1], sizes[code]) + np.arange(ends[-1])]
        if len(self.known) > CACHE_PIECES:
            kept = np.concatenate([[0], np.cumsum(sizes)])
            self.flat = self.flat[np.repeat(begins - kept[:-1], sizes) + np.arange(kept[-1])]
            self.known, self.sizes = pa.concat_arrays([coded.dictionary]), sizes
        return out, ends[at]

    def __call__(self, texts: list[str]) -> list[bytes]:
        flat, offsets = self.encode(pa.array(texts, pa.string()))
        body = flat.tobytes()
        return [body[4 * a:4 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with the end id after each text's."""
    wider = offsets + np.arange(len(offsets))
    out = np.full(len(flat) + len(offsets) - 1, end_id, "<u4")
    inner = np.ones(len(out), bool)
    inner[wider[1:] - 1] = False
    out[inner] = flat
    return out, wider


def joined(parts: list[list[int]]) -> Encoded:
    return np.array([i for p in parts for i in p], "<u4"), np.fromiter(map(len, parts), np.int64, len(parts))


def by_units(encode_unit: Callable[[str], list[int]], limit: int = 1 << 16) -> Callable[[list[str]], Encoded]:
    """Encode pieces unit by unit (word, mark, white space), every unit once while it is remembered."""
    known: dict[str, list[int]] = {}

    def encode(pieces: list[str]) -> Encoded:
        if len(known) > limit:
            known.clear()
        out = []
        for piece in pieces:
            ids: list[int] = []
            for unit in UNIT.findall(piece):
                found = known.get(unit)
                if found is None:
                    found = known[unit] = encode_unit(unit)
                ids += found
            out.append(ids)
        return joined(out)

    return encode


_LOADED: dict[tuple[str, bool], PieceEncoder] = {}


def library_encoder(path: str, with_space: bool) -> PieceEncoder:
    """The tokenizers library's ids without added special tokens; one per Python worker.

    New pieces are sent to the library many at a time, as one text, and its ids are cut
    again: for plain words where the tokens themselves show that a word begins or ends;
    other pieces are parted by a special token, which always stands alone; lists that hold
    that token are sent one by one.
    """
    if (path, with_space) not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        mark = next(iter(special), None)
        # the side on which a plain word shows its edge, and which ids show it
        suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        edge = np.zeros(1 + max(tokenizer.get_vocab().values()), bool)
        for token, i in tokenizer.get_vocab().items():
            edge[i] = token.endswith(suffix) if suffix else token.startswith("Ġ")
        one_word = re.compile(f" {_ONE_WORD}").fullmatch

        def words(pieces: list[str]) -> Encoded:
            ids = np.array(tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(edge[ids])
            if len(at) != len(pieces):  # the vocabulary shows no edges
                return parted(pieces)
            return ids, np.diff(np.concatenate([[-1], at]) if suffix else np.append(at, len(ids)))

        def alone(pieces: list[str]) -> Encoded:
            return joined([e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)])

        def parted(pieces: list[str]) -> Encoded:
            text = mark.join(pieces) if mark is not None else ""
            if mark is None or text.count(mark) != len(pieces) - 1:
                return alone(pieces)
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(ids == special[mark])
            return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

        def lists(pieces: list[str], one: Callable[[list[str]], Encoded]) -> Encoded:
            parts = [one(pieces[at:at + AT_ONCE]) for at in range(0, len(pieces), AT_ONCE)] or [joined([])]
            return tuple(np.concatenate(x) for x in zip(*parts))

        def encode(pieces: list[str]) -> Encoded:
            plain = np.array([one_word(p) is not None for p in pieces], bool)
            found = [lists([p for p, w in zip(pieces, plain.tolist()) if w == kind], one) for kind, one in ((True, words), (False, parted))]
            sizes, begins = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
            before = 0
            for rows, (flat, n) in zip((plain, ~plain), found):
                sizes[rows], begins[rows] = n, before + np.cumsum(n) - n
                before += len(flat)
            flat = np.concatenate([f for f, _ in found])
            return flat[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))], sizes

        _LOADED[path, with_space] = PieceEncoder(with_space, encode, [t.content for t in tokenizer.get_added_tokens_decoder().values()])
    return _LOADED[path, with_space]
