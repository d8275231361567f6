"""Lexical search, hard negatives and personal data against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from trailwarden.llm import hard_negatives, lexical, pii

DOCS = "doc_id long, text string, root string, n int, label string, spans int, terms string"
ITEMS = "item_id long, text string, block int, c string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, "l", 2, "t") for i, t in rows], DOCS)


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_search(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(Counter)
    for i, t in {x for x in items if x[0] is not None and x[1] is not None}:
        wanted[i].update(TERM.findall(t.translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // max(total, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t, c in terms.items() if bag[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: r[:2])


def odd_documents(seed, n):
    rnd = random.Random(seed)
    words = ["a", "B", "ab", "Ünï", "ÄB", "9", "x1", "of", "the", "naïve", "東京", "É"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", "-", "\n", "_", "", "."]) for _ in range(k))
    rows = [(rnd.choice([i, i, 7]), text(rnd.choice([0, 1, 5, 40]))) for i in range(n)]
    same = text(12)
    return rows + [(i, same) for i in range(900, 960)] + [(None, same), (None, None), (5000, ""), (5001, None), (5002, "?! \n"),
                                                         (5003, "word " * 300_000), (5004, "w" * 1_200_000)]


@pytest.mark.parametrize("block", [400_000, 15])
def test_lexical_search_matches_a_plain_version(spark, block):
    docs = odd_documents(2, 200)
    items = [(1, "a b ab the the"), (2, "ÄB naïve 東京 unknown"), (3, ""), (4, None), (None, "a b"), (5, "word w"), (1, "a b ab the the"),
             (6, "of"), (6, "of the"), (7, "nothing here matches zz"), (8, "x1 x1 9 É"), (9, docs[3][1] * 3)]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in items], ITEMS)
    got = lexical.search(documents(spark, docs).repartition(7), frame, k=9, block_postings=block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain_search(docs, items, 9), key=lambda r: r[:2])


def test_lexical_search_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "a")]), spark.createDataFrame([(1, "a", 1, "c")], ITEMS)
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**7], np.int64)
    assert lexical.lengths_norm(n, 10**12, 10**15).tolist() == [75 + 25 * x * 10**12 // 10**15 for x in n.tolist()]


# ---- hard negatives

def test_hilbert_index_visits_every_cell_by_single_steps():
    for dims, bits in ((1, 4), (2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), float)
        place = hard_negatives.hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def test_interval_bounds_hold_every_product():
    rnd = np.random.default_rng(4)
    q, v = rnd.integers(-50, 50, (20, 7)).astype(float), rnd.integers(-50, 50, (60, 7)).astype(float)
    low, high = hard_negatives.interval_bounds(q, v.min(axis=0)[None], v.max(axis=0)[None])
    score = q @ v.T
    assert (low <= score.min(axis=1, keepdims=True)).all() and (high >= score.max(axis=1, keepdims=True)).all()


def vector_rows(clusters, n=420, seed=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, 12)) * (3 if clusters else 0)
    base = (centres[np.arange(n) % 6] + rnd.normal(size=(n, 12)) * 0.4).round(2)
    base[100:140] = base[100]  # one vector many times
    rows = [(i, base[i].tolist(), int(rnd.integers(0, 4)) if i % 3 else 1) for i in range(n)]
    rows += [(None, [1.0] * 12, 1), (500, None, 1), (501, [], 1), (502, [1.0, None] * 6, 1), (503, [float("nan")] * 12, 1), (504, [1.0] * 12, None),
             (520, [1.0, 2.0], 1), (521, [2.0, 1.0], 1), (540, [2.0, 4.0], 2), rows[3], rows[3], (600, [1e17] * 12, 1), (601, [-1e30] * 12, 2)]
    return rows


def plain_negatives(rows, step, positives, negatives):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) if abs(256 * x) < 2**52 else int(256 * x) for x in v]) for i, (label, v) in good.items()}
    low, high = -(1 << 63), (1 << 63) - 1
    out = []
    for a, (label, q) in whole.items():
        if a % step:
            continue
        score = {i: min(max(sum(x * y for x, y in zip(q, v)), low), high) for i, (_, v) in whole.items() if i != a and len(v) == len(q)}
        first = sorted((-s, i) for i, s in score.items() if whole[i][0] == label)[:positives]
        for s, p in first:
            inside = sorted((-t, i) for i, t in score.items() if whole[i][0] != label and 30 * -s <= 100 * t <= 90 * -s)[:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [False, True])
def test_hard_negatives_match_brute_force(spark, clusters):
    rows = vector_rows(clusters)
    frame = spark.createDataFrame([(i, v, label, "x", 1, "s") for i, v, label in rows],
                                  "vec_id long, embedding array<double>, label int, block string, n int, shard string")
    from pyspark.sql import functions as F
    got = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, shard_vectors=100, block_vectors=16, group_anchors=8)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, 20, 5, 10)


def test_zone_maps_leave_out_blocks(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(i, v, label) for i, v, label in vector_rows(True) if i is not None and i < 500],
                                 "vec_id long, embedding array<double>, label int")
    base = hard_negatives.on_curve(hard_negatives.candidates(rows, 256.0, "vec_id", "label", "embedding"))
    blocks = hard_negatives.build_blocks(base, shard_vectors=100, block_vectors=16)
    asks = base.where("vec_id % 20 = 0").withColumn("grp", F.lit(0)).drop("curve").select(
        "*", F.array(F.lit(1).cast("long")).alias("tags"), F.array(F.lit(4_000_000).cast("long")).alias("low"),
        F.array(F.lit(1 << 62)).alias("high"))
    chosen = hard_negatives.choose_blocks(blocks, asks, same=False).select(F.sum(F.size("who"))).first()[0]
    assert 0 < chosen < blocks.count() * asks.count() / 2


def test_hard_negatives_of_an_empty_table(spark):
    from pyspark.sql import functions as F
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).collect() == []


# ---- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
            fits = (True, kind != 1 or all(int(p) <= 255 for p in m.group().split(".")),
                    13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, 9 <= len(digits) <= 15)[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns():
    rnd = random.Random(1)
    parts = ["a", "@", ".", "1", "25", "300", "+", " ", "-", "(", ")", "é", ".a", "@b.c", "0123456789", "4845168114407329", "12.3.4.5"]
    for _ in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "+1", "@", "a@", "１"])
def test_very_long_texts_are_scanned_in_linear_time(unit):
    text = unit * (1_000_000 // len(unit)) + " 4845168114407329 x@y.zz"
    spans = pii.base_spans(text)
    assert (0, len(text) - 6, len(text)) in spans
    assert len(pii.codes_of(text)) == len(text) and len(pii.window_starts(text)) <= len(text) / 48 + 1


def test_gradient_agrees_with_differences():
    rnd = np.random.default_rng(2)
    tagger = pii.Tagger.new(3, hidden=3, embed=2)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    codes, tags = rnd.integers(0, pii.VOCABULARY, (4, 7)), np.array([[0, 1, 2, 2, 0, 3, 0]] * 4)
    _, grad = tagger.gradient(codes, tags)
    for name, weight in tagger.weights.items():
        for at in [tuple(rnd.integers(0, n) for n in weight.shape) for _ in range(6)]:
            kept, losses = weight[at], []
            for step in (1e-3, -1e-3):
                weight[at] = kept + step
                losses.append(tagger.gradient(codes, tags)[0])
            weight[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 2e-3, name


def test_decoding_finds_the_best_path():
    rnd = np.random.default_rng(8)
    tagger = pii.Tagger.new(1, hidden=2, embed=2)
    tagger.weights["move"] = rnd.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    codes = rnd.integers(0, pii.VOCABULARY, (3, 4))
    tags, _ = tagger.decode(codes)
    emit, move = tagger.run(codes), tagger.weights["move"] + pii._FORBIDDEN
    for n in range(3):
        value = {p: sum(emit[t, n, x] for t, x in enumerate(p)) + pii._NO_START[p[0]] + sum(move[a, b] for a, b in zip(p, p[1:]))
                 for p in itertools.product(range(pii.TAGS), repeat=4)}
        assert max(value, key=value.get) == tuple(tags[n])


def test_global_choice_of_spans():
    text = "x" * 10 + " +1 (974) 555-3436 and 10 [.] 20 [.] 30 [.] 40 "
    phone, ip = (3, text.index("+"), text.index(" and")), (1, text.index("10"), len(text) - 1)
    found = [(5.0, *phone), (4.0, 3, phone[1] + 3, phone[2]), (3.0, *ip), (1.0, 3, 0, 9), (9.0, 2, *ip[1:])]
    assert pii.reconciled(text, found, []) in ([phone, ip], [ip, phone])
    assert pii.reconciled(text, found, [(3, phone[1] + 2, phone[1] + 4)]) == [ip]
    assert pii.reconciled(text, [], []) == []


def test_all_that_passes_lies_in_a_tagged_window():
    rnd = random.Random(12)
    parts = ["jo", "x", " at ", "\tat\n", " AT ", "[ at ]", "(  at  )", "（at）", " ａｔ ", "@", "＠", "mail", ".", " dot ", "[.]", "com", "١٢٣", "10", " ", "+1 ", "-", "4845", "é", "that "]
    seen = 0
    for _ in range(20):
        text = "y" * rnd.randint(0, 60) + "".join(rnd.choice(parts) for _ in range(8)) + "z" * 100 + rnd.choice([" jo at ", " jo (  at  ) ", " jo（at）"]) + "mail.com"
        starts = pii.window_starts(text)
        for a in range(len(text)):
            for b in range(a + 7, min(len(text), a + 48) + 1):
                if any(pii.passes(k, text[a:b]) for k in range(4)):
                    seen += 1
                    assert any(s <= a and b <= s + 96 for s in starts), text[a:b]
    assert seen >= 20


def test_spans_of_48_characters_at_any_place_are_found():
    class Marked:
        """Tags runs of a and 1 as an e-mail."""
        def decode(self, codes):
            inside = np.isin(codes, pii.codes_of("a1"))
            begins = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
            return np.where(begins, 1, np.where(inside, 2, 0)), np.ones(codes.shape)

    for before in range(100):
        for after in (0, 1, 60):
            text = "-" * before + "a" * 47 + "1" + "-" * after
            assert (0, before, before + 48) in [f[1:] for f in pii.tagged_spans(Marked(), [text])[0]], (before, after)


@pytest.fixture(scope="module")
def teacher(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    return docs, pii.learn(docs)


def test_private_data_of_held_out_documents(spark, teacher):
    _, tagger = teacher
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1").limit(2000)
    rnd, rows, want = random.Random(3), [], {}
    forms = ["jo.{n} (at) mail{d}.example.com", "jo{n}[at]mail{d}.example.com", "10[.]{d}0[.]2{d}[.]40", "4845.1681.1440.7329", "+{d} (974) 555-3{n}",
             "+{d} (974) 555-3{n} 4736962573099582"]
    for r in docs.toPandas().itertuples():
        if r.text and not pii._TRIGGER.search(r.text) and len(r.text) > 200:
            at = r.text.index(" ", len(r.text) // 2)
            span = rnd.choice(forms).format(n=rnd.randint(100, 999), d=rnd.randint(1, 9))
            rows.append((len(rows), r.text[:at] + " " + span + r.text[at:] if len(rows) % 2 else r.text))
            if len(rows) % 2 == 0:
                want[len(rows) - 1] = (at + 1, at + 1 + len(span.removesuffix(" 4736962573099582")))
    found = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in pii.find(documents(spark, rows), tagger).collect()}
    assert len(found) == len(rows) > 300
    assert all(not spans for i, spans in found.items() if i not in want)  # nothing in clean texts
    caught = sum(span in found[i] for i, span in want.items()) / len(want)
    print(f"altered spans caught exactly: {caught:.3f}")
    assert caught >= 0.9


def test_private_data_digests_and_odd_rows(spark, teacher):
    _, tagger = teacher
    texts = ["mail a.b@c.de, host 10.0.0.1 or 999.1.1.1", "", None, "card 4845 1681 1440 7329 tel +1 (974) 555-3436", "é" * 50 + "x@y.zz",
             "a" * 3000 + " 10.1.2.3", "a@b.c a@b.c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    got = pii.digests(pii.find(documents(spark, rows), tagger)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows) and by[0][0] == by[0][1]
    for i, text in [*enumerate(texts), (None, texts[0])]:
        base = plain_base(text or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = by[i][0]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == n for s in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))
    assert pii.digests(pii.find(documents(spark, rows).limit(0), tagger)).collect() == []
    assert pii.learn(documents(spark, [(1, "no numbers"), (2, None)])) is None
    assert pii.digests(pii.find(documents(spark, rows[:1]), None)).first()["n_ip"] == 1


def test_redaction(spark, teacher):
    _, tagger = teacher
    got = pii.redacted(documents(spark, [(1, "to a.b@c.de now"), (2, None), (3, "plain")]), tagger).orderBy("doc_id").collect()
    assert [(r["text"], r["n_spans"]) for r in got] == [("to <email> now", 1), ("", 0), ("plain", 0)]
