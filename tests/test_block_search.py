"""Block-max search against plain sums over all documents."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailwarden.operators import block_search, retrieval


def weighted_documents(seed, n):
    """Documents with term weights; a frequent term, equal documents, null id."""
    rnd = random.Random(seed)
    docs = [(i, {rnd.choice("abcdefghij"): round(rnd.random() * 3, 3) for _ in range(rnd.randint(0, 6))} | ({"the": 0.1} if i % 3 else {}))
            for i in range(n)]
    return docs + [(1000 + i, docs[5][1]) for i in range(20)] + [(None, {"a": 2.5, "b": 2.5})]


def plain_hits(docs, queries, k, every_term):
    out = []
    for q, terms in queries.items():
        scored = []
        for i, bag in docs:
            shared = terms.keys() & bag.keys()
            score = round(sum(terms[t] * bag[t] for t in shared), 6)
            if score > 0 and (not every_term or len(shared) == len(terms)):
                scored.append((-score, i is None, i))
        out += [(q, i, -s, r) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


QUERIES = {"q1": {"a": 1.0, "the": 0.5}, "q2": {"b": 0.7, "c": 0.2, "d": 2.0}, "q3": {"the": 1.0}, "q4": {"zz": 1.0}, "q5": {"a": 1.0, "b": 1.0}}


@pytest.mark.parametrize("every_term", [False, True])
@pytest.mark.parametrize("limit", [200_000, 3])
def test_hits_match_plain_sums(spark, every_term, limit):
    docs = weighted_documents(3, 300)
    postings = spark.createDataFrame([(i, t, w) for i, bag in docs for t, w in bag.items()], "doc_id long, term string, weight double")
    blocks = block_search.block_rows(postings.withColumn("block", block_search.block_of("doc_id", 20)))
    asked = spark.createDataFrame([(q, t, w) for q, terms in QUERIES.items() for t, w in terms.items()], "query string, term string, weight double")
    got = block_search.top_documents(blocks, asked, 7, every_term, limit)
    assert sorted((r["query"], r["hit_rank"], r["doc_id"], r["score"]) for r in got.collect()) == sorted(
        (q, r, i, pytest.approx(s, abs=2e-6)) for q, i, s, r in plain_hits(docs, QUERIES, 7, every_term))
    assert block_search.top_documents(blocks.limit(0), asked, 7).collect() == []
    assert block_search.top_documents(blocks, asked.limit(0), 7).collect() == []


def test_closed_blocks_cannot_hold_a_hit():
    """Every block is either opened or its documents' scores are below the floor at that time."""
    rows = [(q, t, w) for q, terms in QUERIES.items() for t, w in terms.items()]
    group = block_search.QueryGroup.of(pa.table({"query": [r[0] for r in rows], "term": [r[1] for r in rows], "weight": [r[2] for r in rows]}))
    hits, closed = block_search.Hits(len(group.queries), 3), 0
    docs = [d for d in weighted_documents(9, 600) if d[0] is not None]
    for at in range(0, len(docs), 8):
        inverted = defaultdict(list)
        for i, bag in docs[at:at + 8]:
            for t, w in bag.items():
                inverted[t].append((i, w))
        if not inverted:
            continue
        floors = hits.floor.copy()
        lists = list(inverted.values())
        skipped = block_search.evaluate_block(
            group, pa.array(list(inverted)), np.array([max(w for _, w in x) for x in lists]), pa.array([i for x in lists for i, _ in x]),
            np.array([w for x in lists for _, w in x]), np.array([len(x) for x in lists]), hits, False)
        closed += skipped
        for n, q in enumerate(group.queries):
            best = max(round(sum(QUERIES[q].get(t, 0) * w for t, w in bag.items()), 6) for _, bag in docs[at:at + 8])
            assert best < floors[n] + 1e-9 or best <= -hits.lists[n][0][0] + 1e-9
    assert closed > 100
    want = plain_hits(docs, QUERIES, 3, False)
    got = [(q, d, -s, r) for q, some in zip(group.queries, hits.lists) for r, (s, _, d) in enumerate(some, 1)]
    assert sorted(got) == sorted((q, i, pytest.approx(s, abs=2e-6), r) for q, i, s, r in want)


def test_no_exchange_of_pairs_before_the_cut(spark):
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 5}") for i in range(50)], "id long, body string")
    queries = spark.createDataFrame([(1, ["alpha", "w3"])], "q long, words array<string>")
    plan = retrieval.and_search(docs, "id", "body", queries, "q", "words")._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert above.count("Exchange") == 1 and "Join" not in above


def test_keyword_search_against_a_plain_version(spark):
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "Delta", "x1", "für"]) for _ in range(rnd.randint(0, 8)))) for i in range(200)]
    texts += [(200, None), (201, "")]
    queries = {1: ["alpha", "beta"], 2: ["Gamma"], 3: ["für", "x1", "alpha"], 4: ["absent", "alpha"]}
    got = retrieval.and_search(spark.createDataFrame(texts, "id long, body string"), "id", "body",
                               spark.createDataFrame(list(queries.items()), "q long, words array<string>"), "q", "words", limit=6)
    want = []
    for q, words in queries.items():
        scored = []
        for i, text in texts:
            bag = Counter((text or "").lower().split())
            if all(bag[w.lower()] for w in words):
                scored.append((-round(sum(math.log(1 + bag[w.lower()]) for w in words), 6), i))
        want += [(q, i, pytest.approx(-s, abs=2e-6), r) for r, (s, i) in enumerate(sorted(scored)[:6], 1)]
    assert sorted(tuple(r) for r in got.select("query_id", "doc_id", "score", "hit_rank").collect()) == sorted(want)
