"""Encoding, token files, packing and chat formatting against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailwarden.llm import bpe, chat, packing, token_files, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "a" * 3000, "  two  spaces \n\n and\r\nlines\t", "x<|endoftext|> y <|endoftext|>", "don't we'll 'S",
       "é̀ ñ中文😀 ǅ ²Ⅷ \x1c\x1d \x85 　end ", "Same text", "Same text"]
SCHEMA = "doc_id long, text string, ids string, part string, copy int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "p", 3) for i, t in enumerate(ODD)]
    rows += [(90, None, None, None, None), (None, "no id", "x", "y", 1), (7, ODD[7], "clash", "p", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    letters = [*"abcXYZ éüßñ'’.,!?|$%<>  \n\t\r0129_²中\x1c\x85　😀ǅ", "<|endoftext|>", "'s", "  ", "\n\n", "the", " of"]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("path,with_space", [(BYTE, True), (WORD, False)])
def test_units_give_the_librarys_ids(path, with_space):
    texts = random_texts(3000) + ODD
    encoder, plain = tokens.library_encoder(path, with_space), Tokenizer.from_file(path)
    for text, ids in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_segment_tree_gives_the_librarys_ids_and_texts():
    texts = random_texts(3000, seed=6) + ODD
    vocab, plain = bpe.Vocabulary(BYTE), Tokenizer.from_file(BYTE)
    rnd = random.Random(1)
    for text in texts:
        ids = vocab.encode(text)
        assert ids == plain.encode(text, add_special_tokens=False).ids
        assert vocab.decode(np.array(ids, np.int64)) == plain.decode(ids, skip_special_tokens=False)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert vocab.decode(np.array(ids, np.int64)) == plain.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_on_odd_rows(spark, odd):
    rows = bpe.decode(bpe.encode(odd, BYTE), BYTE).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in rows) == sorted((i or -1, t) for i, t in texts_of(odd))
    strange = spark.createDataFrame([(1, [262, None, -4, 99999999]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(strange, BYTE).collect()} == {1: " the", 2: ""}
    assert bpe.digests(odd.limit(0), BYTE).count() == 0


def test_token_files_round_trip(spark, odd, tmp_path):
    plain = Tokenizer.from_file(BYTE)
    token_files.write(odd, str(tmp_path / "a"), BYTE)
    rows = token_files.crc32_of_ids(token_files.read(spark, str(tmp_path / "a"))).collect()
    want, start = [], 0
    for doc_id, text in sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0], r[1])):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((s, d, n, c) for d, s, n, c in want)
    found = token_files.lookup(spark, str(tmp_path / "a"), [3])
    assert [r["n_tokens"] for r in found.collect()] == [len(plain.encode(ODD[3], add_special_tokens=False).ids) + 1]
    assert "PushedFilters" in found._jdf.queryExecution().executedPlan().toString()
    token_files.write(odd.limit(0), str(tmp_path / "b"), BYTE)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_packing_is_whole_and_tight(spark, odd):
    long = spark.createDataFrame([(100 + i, "word " * (700 * i % 5000), "c", "p", 1) for i in range(300)], SCHEMA)
    docs = odd.union(long)
    plain = Tokenizer.from_file(WORD)
    rows = packing.digests(packing.pack_documents(docs, WORD, group_docs=64)).toPandas()
    ids = {}
    for doc_id, text in texts_of(docs):
        ids.setdefault(doc_id, []).append(np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4"))
    assert rows["length"].sum() == sum(len(x) for v in ids.values() for x in v)
    for doc_id, copies in ids.items():
        own = rows[rows["doc_id"] == doc_id] if doc_id is not None else rows[rows["doc_id"].isna()]
        for r in own.itertuples():
            assert any(zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in copies)
    padded = 0
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group["offset"].to_numpy() == np.cumsum(group["length"].to_numpy()) - group["length"].to_numpy()).all()
        used = int(group["length"].sum())
        assert used <= 2048
        padded += 0 if used & (used - 1) == 0 else 2048 - used
    assert padded < 0.1 * rows["length"].sum()
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    rnd = random.Random(2)
    lengths = np.array([rnd.randint(1, 100) for _ in range(500)])
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((j for j, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        free[b] -= lengths[i]
        assert bins[i] == b


CONVERSATIONS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>␛ <|␛"), (1, 1, "assistant", "<|im_end|>␛ <|␛"), (1, None, "system", None),
                 (2, 5, "assistant", ""), (None, 1, None, "text"), (3, 0, "<|im_start|>", "assistant")]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, position int")


def test_chat_round_trip_and_loss(spark):
    many = [(9, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 7)) for i in range(333)]
    rows = CONVERSATIONS + many
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(conversations(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        turns = [(r, x) for _, _, r, x in own]
        loss = "".join(x for r, x in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["formatted_chars"] == len(chat.chatml(turns))
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_turns(conversations(spark, rows).limit(0))).count() == 0


def test_templates_that_rewrite_history_are_detected(spark):
    def counts(turns):
        return f"{len(turns)} turns\n" + chat.chatml(turns)

    def looks_back(turns):  # changes with a turn further back than the declared context
        return "".join(f"[{turns[max(0, i - 40)][1][:3]}]{r}:{t}\n" for i, (r, t) in enumerate(turns))

    rows = conversations(spark, [(1, i, "user", f"{i:03d}") for i in range(100)])
    assert all(r["rewrites"] for r in chat.format_turns(rows, counts).collect())
    assert any(r["rewrites"] for r in chat.format_turns(rows, looks_back).collect())
    assert not any(r["rewrites"] for r in chat.format_turns(rows).collect())


def test_templates_that_rewrite_only_long_conversations_are_detected(spark):
    def drops(turns):
        return chat.chatml(turns if len(turns) <= 60 else turns[1:])

    def looks_back(turns):
        return "".join(f"[{turns[max(0, i - 40)][1][:3]}]{r}:{t}\n" for i, (r, t) in enumerate(turns))

    rows = conversations(spark, [(c, i, "assistant", f"{i:03d}") for c, n in ((1, 100), (2, 40), (3, 63), (None, 90), (4, 2)) for i in range(n)])
    for template, kept in ((drops, {2, 4}), (looks_back, {4})):
        got = chat.format_turns(rows, template).collect()
        assert len(got) == 295
        for r in got:
            assert (r["rewrites"], r["in_loss"], r["text_start"] is None) == ((False, True, False) if r["conv_id"] in kept else (True, False, True))


def test_escaping_is_reversible():
    rnd = random.Random(1)
    parts = ["<", "|", "im_start", "|>", "im_end", chat.ESCAPE, chat.END, chat.START, "a"]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and chat.START not in escaped and chat.END not in escaped


def test_token_queries_keep_every_document(spark, sf_dir):
    from trailwarden.llm.queries import QUERIES

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op7_bpe", "op9_token_files"):
        assert QUERIES[name](spark, sf_dir).count() == documents
    assert QUERIES["op4_packing"](spark, sf_dir).agg(F.countDistinct("doc_id")).first()[0] == documents


@pytest.mark.parametrize("path,with_space", [(BYTE, True), (WORD, False)])
def test_ids_of_odd_texts_equal_the_library(path, with_space):
    """Runs of white space, control characters, several scripts, added tokens; later batches meet known pieces."""
    pick = random.Random(3)
    letters = " \n\t\r 　\u0085\x1c\x1f\x00'.,aBcéÉßİıǅſ́漢か9½²<|>_-"
    longer = ["word", " the", "  ", "<|endoftext|>", "'s", "n't "]
    texts = ["".join(pick.choice(letters) + (pick.choice(longer) if pick.random() < 0.3 else "")
                     for _ in range(pick.randrange(30))) for _ in range(6000)]
    encoder = tokens.library_encoder(path, with_space)
    found = [ids for at in range(0, len(texts), 500) for ids in encoder(texts[at:at + 500])]
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert found == [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in expected]


def test_bpe_digests_match_the_library(spark, odd):
    plain = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text in texts_of(odd):
        ids = plain.encode(text, add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False))]
        want.append((doc_id, len(ids), *sha))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in bpe.digests(odd, BYTE).collect()), key=key) == sorted(want, key=key)


def test_very_long_texts_and_words(spark, tmp_path):
    texts = ["word, and " * 110_000, "x" * 1_000_000, "é" * 300_000 + " end", "\n" * 1_000_000]
    docs = spark.createDataFrame([(i, t, "c", "p", 1) for i, t in enumerate(texts)], SCHEMA)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    token_files.write(docs, str(tmp_path / "long"), BYTE)
    rows = {r["doc_id"]: r for r in token_files.crc32_of_ids(token_files.read(spark, str(tmp_path / "long"))).collect()}
    packed = packing.pack_documents(docs, WORD).toPandas()
    for i, text in enumerate(texts):
        ids = byte.encode(text, add_special_tokens=False).ids + [0]
        assert (rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        own = packed[packed["doc_id"] == i].sort_values("start")
        assert np.concatenate(own["ids"].tolist()).tolist() == word.encode(text, add_special_tokens=False).ids + [1]
        assert (own["start"].to_numpy() == np.arange(len(own)) * packing.SEQUENCE).all()
    shorter = [t[:120_000] for t in texts]
    encoded = bpe.encode(spark.createDataFrame(list(enumerate(shorter)), "doc_id long, text string"), BYTE).collect()
    assert {r["doc_id"]: r["ids"] for r in encoded} == {i: byte.encode(t, add_special_tokens=False).ids for i, t in enumerate(shorter)}


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    plain = Tokenizer.from_file(BYTE)
    encoder = tokens.PieceEncoder(True, tokens.by_units(lambda u: plain.encode(u, add_special_tokens=False).ids, limit=20), ["<|endoftext|>"])
    for seed in range(6):
        texts = random_texts(60, seed)
        assert encoder(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(encoder.known) == len(encoder.sizes) and encoder.sizes.sum() == len(encoder.flat)
