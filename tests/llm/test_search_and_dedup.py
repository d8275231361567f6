"""Similarity join, suffix dedup, neighbours and top-k against brute force; classifiers by held-out rows; the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailwarden.llm import jaccard, labelled, neighbours, quality, suffix_dedup, topk, toxicity

DOCS = "doc_id long, text string, root string, spans int, label string, copies int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, "l", 2) for i, t in rows], DOCS)


def varied_texts(seed=3, n=150):
    """Originals, edited copies at all similarities, a passage in many texts, odd texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(rnd.choice([1, 3, 5, 6, 30, 90, 300]))))
        if rnd.random() < 0.3:
            texts[-1] += " " + passage + "\n" + word()
    texts += ["ab " * 400, "ab " * 400 + "x", "", " \t\n", "One two", "one\ttwo", "é" * 500, "xé" + "é" * 300]
    return texts


def brute_components(rows):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, text in rows:
        w = words.findall((text or "").encode().translate(lower))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(d, len(s), d if not s else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


ROWS = [(1000 - i, t) for i, t in enumerate(varied_texts())] + [(5, None), (None, "no id here at all"), (None, "one two"), (7, "same id"), (7, "same id"), (7, "other text of seven")]


def in_order(rows):
    return sorted(rows, key=repr)


def test_jaccard_matches_brute_force(spark, monkeypatch):
    got = [tuple(r) for r in jaccard.near_duplicates(documents(spark, ROWS).repartition(4)).collect()]
    assert in_order(got) == in_order(brute_components(ROWS))
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 3)  # every block and cluster in many chunks
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 100)
    got = [tuple(r) for r in jaccard.near_duplicates(documents(spark, ROWS).repartition(4)).collect()]
    assert in_order(got) == in_order(brute_components(ROWS))
    assert jaccard.near_duplicates(documents(spark, ROWS).limit(0)).count() == 0


def test_count_tree_finds_all_rows_within_the_bound():
    rnd = np.random.default_rng(1)
    points = rnd.poisson(2, (700, 32))
    points[350:] = np.maximum(points[:350] + rnd.integers(-1, 2, (350, 32)) * (rnd.random((350, 32)) < 0.2), 0)
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    for i in range(0, 700, 7):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero((bound >= jaccard.needed(int(sizes[i]), sizes)) & (100 * sizes >= 80 * sizes[i]) & (80 * sizes <= 100 * sizes[i]))
        assert sorted(tree.search(points[i], int(sizes[i])).tolist()) == want.tolist()


def brute_suffix(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    met = Counter(b[i:i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if met[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot,block", [(20_000, 512 << 10), (1, 1)])
def test_suffix_dedup_matches_brute_force(spark, hot, block):
    ids, left = suffix_dedup.dedup(documents(spark, ROWS).repartition(4), hot=hot, block_bytes=block)
    got = ids.join(left, "text_id").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert in_order(map(tuple, got)) == in_order(brute_suffix(ROWS, 200))


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.digests(documents(spark, ROWS).limit(0)).count() == 0


def test_cut_characters_go_and_the_rest_of_the_text_stays(spark):
    # the repeated bytes begin with the end of é and ũ, and in the first two texts end with the beginning of é and è
    same, more = ("".join(chr(97 + i * i % 23) + str(i + n) for i in range(120)) for n in (0, 500))
    texts = ["own \ufffd start é" + same + "é own \ufffd end", "other ũ" + same + "è other end", "\ufffd one é" + more, "two ũ" + more]
    docs = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_strings(spark, docs, "").collect()}
    assert got == {0: "own \ufffd start  own \ufffd end", 1: "other  other end", 2: "\ufffd one ", 3: "two "}


def test_prefix_classes_on_small_alphabets():
    rnd = random.Random(3)
    for _ in range(300):
        contexts = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(1, 6))})
        length = rnd.randint(1, 6)
        met = Counter(c[i:i + length] for c in contexts for i in range(len(c) - length + 1))
        want = [[i for i in range(len(c) - length + 1) if met[c[i:i + length]] > 1] for c in contexts]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(contexts, length)] == want


VECTORS = "vec_id long, embedding array<float>, v string, ids int, shard int"


def vectors(spark, extra=()):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(300, 16)).astype("float32")
    rows = [(i, base[i % 200].tolist()) for i in range(300)]  # a third are copies
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, None] + [0.0] * 14), (504, [float("nan")] * 16),
             (505, [float("inf")] * 16), (None, [1.0] * 16), (520, [1.0, 2.0]), (540, [2.0, 4.0]), (3, base[3].tolist()), *extra]
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS)


def test_topk_matches_brute_force(spark):
    rows = vectors(spark, [(560, [1e30, -1e30] + [0.5] * 14)])
    got = defaultdict(list)
    for r in topk.search(rows, rows.where("vec_id % 20 = 0"), 20, block_vectors=50, block_queries=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = {}
    for r in rows.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good[r["vec_id"]] = [int(np.floor(64 * float(x))) for x in v]
    low, high = -(1 << 63), (1 << 63) - 1
    for q, a in good.items():
        if q % 20 == 0:
            scores = sorted((-min(max(sum(x * y for x, y in zip(a, b)), low), high), v) for v, b in good.items() if v != q and len(a) == len(b))[:20]
            assert got.get(q, []) == [(v, -s) for s, v in scores]
    assert topk.search(rows.limit(0), rows.limit(0), 20).count() == 0


def test_neighbours_recall_and_scores(spark):
    rows = vectors(spark)
    got = neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), 5, shard_vectors=80).toPandas()
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect() if r["vec_id"] is not None and r["embedding"]
            and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    hits = total = 0
    for q, a in good.items():
        if q % 50 == 0:
            score = {v: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for v, b in good.items() if v != q and len(a) == len(b)}
            best = sorted(score, key=lambda v: (-round(score[v], 12), v))[:5]
            own = got[got["query_id"] == q].sort_values("rank")
            assert own["rank"].tolist() == list(range(1, len(own) + 1))
            assert np.allclose(own["score"], [score[v] for v in own["vec_id"]], atol=1e-12)
            hits, total = hits + len(set(best) & set(own["vec_id"])), total + len(best)
    assert hits >= 0.9 * total
    assert neighbours.nearest(rows.limit(0), rows.limit(0), 5).count() == 0


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), 5).groupBy("query_id").agg(F.collect_set("vec_id").alias("v"))
    table = rows.toPandas()
    m = np.stack(table["embedding"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, hits, total = table["vec_id"].to_numpy(), 0, 0
    for r in got.collect():
        s = m @ m[ids == r["query_id"]][0]
        s[ids == r["query_id"]] = -9
        hits, total = hits + len(set(ids[np.argsort(-s)[:5]].tolist()) & set(r["v"])), total + 5
    assert hits >= 0.9 * total


@pytest.mark.parametrize("noise", [0.1, 0.5, 1.0])
def test_recall_on_full_shards(spark, noise):
    table = np.stack(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"]).astype(float)
    rnd = np.random.default_rng(8)
    m = table[np.arange(3 * neighbours.SHARD_VECTORS) % len(table)]
    m = (m + noise * table.std() * rnd.normal(size=m.shape)).astype("float32")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>")
    got = neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), 5).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    m = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    hits = 0
    for r in got:
        s = m @ m[r["query_id"]]
        s[r["query_id"]] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(r["v"]))
    assert len(got) == -(-len(m) // 50)
    print(f"recall@5 of {len(got)} queries over {len(m)} vectors, noise {noise}: {hits / (5 * len(got)):.4f}")
    assert hits >= 0.9 * 5 * len(got)


def accuracy(rows, label):
    rows = rows[rows["held_out"] & rows[label].notna()]
    return [(rows[rows[label] == x]["predicted"] == x).mean() for x in (0, 1)]


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        rows = module.predictions(docs, labels)
        got = rows.join(labels, "doc_id", "left").toPandas()
        assert len(got) == docs.count() and got["score"].between(0, 1).all()
        assert min(accuracy(got, label)) > 0.9


def test_classifiers_on_odd_rows(spark):
    odd = documents(spark, [(1, None), (2, ""), (None, "text"), (3, "You idiot"), (3, "You idiot"), (4, "x" * 200_000)])
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.predictions(odd, labels).collect()} == {0.0}
    assert {r["score"] for r in quality.predictions(odd, labels).collect()} == {1.0}
    assert toxicity.keep_clean(odd, toxicity.learn(odd, labels)).count() == 6
    assert quality.keep_good(odd, quality.learn(odd, labels)).columns == odd.columns
    assert toxicity.predictions(odd.limit(0), labels).count() == 0
    assert quality.predictions(odd.limit(0), labels).count() == 0


def test_folding_and_exceptions():
    assert toxicity.fold_text("1D10T, Ïdiоt! tr@sh 2024") == " idiot idiot trash 2024 "
    lexicon = toxicity.Lexicon({" clown ": 4.0, " scum": 3.0, " clown fish ": -4.0}, (-4.0, 2.0, 1.0))
    assert lexicon.features("a clown fish")[0] == 0.0
    assert lexicon.features("a clown walks")[0] > 0 and lexicon.features("scummy")[0] > 0 and lexicon.features("fish")[0] == 0


def test_exceptions_around_every_entry(spark):
    ones = [f"what a clown you {w} are" for w in ("scumbag", "scummy")] * 12
    zeros = ["the clown fish swims"] * 8 + ["a scumble glaze dries"] * 8 + [f"plain text number {i}" for i in range(250)]
    rows = spark.createDataFrame([(t, 1) for t in ones] + [(t, 0) for t in zeros], "text string, label int")
    lexicon = toxicity.fit(rows)
    weights = lexicon.weights
    assert weights[" clown "] > 0 and not {" clow", " clown"} & set(weights)  # one word is no reason for a stem
    assert weights[" scum"] > 0 and weights[" scumbag "] > 0
    assert weights[" clown fish "] < 0 and weights[" scumble glaze "] < 0
    assert lexicon.features("a clown fish, a scumble glaze") == (0.0, 0.0)
    once = lexicon.features("clown fish or clown")
    assert once == pytest.approx((25 * weights[" clown "], np.log(2)))
    assert lexicon.features("scumbag")[0] == pytest.approx(100 * weights[" scumbag "])  # the stem inside does not count again


def test_training_sample_is_bounded_and_leaves_out_the_fold(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 1)], "doc_id long, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", 5, 0, 50).withColumn("f", labelled.fold("doc_id", 5)).collect()
    assert len(rows) == 50 and all(r["f"] != 0 and r["doc_id"] != 4 for r in rows)


def test_training_sample_holds_each_document_once(spark):
    docs = documents(spark, [(1, f"copy {i % 3}") for i in range(400)] + [(i, f"text {i}") for i in range(2, 20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    sample = lambda d: sorted(map(tuple, labelled.training_rows(d, labels, "toxic", 5, 9, 10).collect()))
    assert len({r[0] for r in sample(docs)}) == len(sample(docs)) == 10
    assert sample(docs) == sample(docs.orderBy(F.col("text").desc()).repartition(7))
    every = labelled.training_rows(docs, labels, "toxic", 5, 9, 50).collect()
    assert len(every) == 19 and {r["label"] for r in every if r["doc_id"] == 1} == {1}


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert ids(docs) == {c for _, _, c in brute_components(rows)}
        elif name == "suffix_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            removed = {d: n for d, _, n, _, _ in brute_suffix(rows, 200)}
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert ids(docs) == ids(before)
            for d, t in rows:
                assert 0 <= len(t.encode()) - removed[d] - len(texts[d].encode()) <= 8 * (removed[d] > 0)
        else:
            assert ids(docs) < ids(before)
            labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
            lost = [labels[i] for i in ids(before) - ids(docs) if i in labels]
            assert sum((r["toxic"] == 1) if name == "toxicity" else (r["quality"] == 0) for r in lost) >= 0.9 * len(lost)
    assert docs.select("doc_id").distinct().count() == before.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = documents(spark, [(1, None), (2, ""), (None, "some words are here today"), (3, "same text of five words"),
                             (3, "same text of five words"), (4, "same text of five words"), (None, None)])
    (tmp_path / "labels.parquet").mkdir()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    for docs in (rows, rows.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}-{docs.count()}-{i}")
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(out)
            docs = spark.read.parquet(out)
            if name == "near_duplicates" and docs.count():
                assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in docs.collect()) == [
                    (-1, ""), (-1, "some words are here today"), (1, ""), (2, ""), (3, "same text of five words")]


def test_long_words_do_not_collide():
    """The Thue-Morse word and its complement have equal sums for every odd base modulo 2^64."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (1, 2, 64, 1024, 4096):
        text = f"\t{word[:n]} {other[:n]}  {word[:n].upper()} x".encode()
        h, at = jaccard.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert h[0] == h[2] and len(set(h.tolist())) == 3 and at.tolist() == [0, 4]
    one, two = ("left right up " + w + " down" for w in (word[:2048], other[:2048]))
    bodies = [np.frombuffer(t.encode(), np.uint8) for t in (one, two)]
    assert jaccard.shingle_sets(bodies[0], np.array([0, len(bodies[0])]))[0] != jaccard.shingle_sets(bodies[1], np.array([0, len(bodies[1])]))[0]
