import json
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailwarden.operators import network, retrieval
from trailwarden.sources import knowledge

HEADER = "Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,Extra,Label\n"


def test_network_flows(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "80,6,t3,1,2,3,x,Bot\n")
    (tmp_path / "a.csv").write_text(HEADER + "80,6,t1,1,2,3,x, Benign \n" + HEADER + "443,6,t2,1,2,3,x,Bot\n22,6,t4,1,2,3,x,Brute\n")
    flows = network.read_flows(spark, str(tmp_path))
    assert "Extra" not in flows.columns
    row = network.flow_summary(flows).first()
    assert (row.file_count, row.total_rows, row.header_rows_removed, row.benign_flow_count, row.suspicious_flow_count) == (2, 4, 1, 1, 3)
    assert row.suspicious_ratio == 0.75
    counts = {(r.label, r.file_name): r.flow_count for r in network.flow_label_counts(flows).collect()}
    assert counts[("Bot", None)] == 2 and counts[("Bot", "b.csv")] == 1
    assert [r.timestamp for r in network.suspicious_examples(flows, 2).collect()] == ["t2", "t4"]
    package = network.evidence_package(flows, 2)
    first = package.first()
    assert [(x.label, x["count"]) for x in first.top_suspicious_labels] == [("Bot", 2), ("Brute", 1)]
    cases = spark.createDataFrame([("i1",), ("i2",)], "incident_id string")
    open_review = network.review_attachment(cases, package, reviewed=False).collect()
    assert {r.network_status for r in open_review} == {"available_not_reviewed"} and open_review[0].suspicious_flow_examples is None
    assert len(network.review_attachment(cases, package, reviewed=True).first().suspicious_flow_examples) == 2


def test_no_flow_files_give_no_summary(spark):
    flows = spark.createDataFrame([], "label string, file_name string")
    assert network.flow_summary(flows).count() == 0


def test_pattern_sections(spark, tmp_path):
    (tmp_path / "patterns.md").write_text("# Head\nintro\n## One\nbody 1\n### sub\nmore\n##  Two \n\nlast\n## no-body")
    rows = knowledge.read_pattern_documents(spark, str(tmp_path / "patterns.md")).orderBy("title").collect()
    assert [(r.title, r.text, r.source, r.kb_type) for r in rows] == [
        ("One", "body 1\n### sub\nmore", "patterns.md::One", "pattern"), ("Two", "last", "patterns.md::Two", "pattern")]


def test_feature_rows_and_union(spark, tmp_path):
    (tmp_path / "features.csv").write_text('tags,text\nTag A,"some, text"\n,other\n')
    features = knowledge.read_feature_rows(spark, str(tmp_path / "features.csv"))
    base = knowledge.knowledge_base(features, spark.createDataFrame([("P", None, "s", "pattern")], "title string, text string, source string, kb_type string"))
    rows = {r.title: (r.source, r.fulltext) for r in base.collect()}
    assert rows == {"Tag A": ("features.csv", "tag a some, text"), "": ("features.csv", " other"), "P": ("s", "p ")}


def test_technique_bundle_is_idempotent(spark, tmp_path):
    tactic = {"type": "x-mitre-tactic", "name": "credential-access", "description": "d"}
    pattern = {"type": "attack-pattern", "id": "ap--1", "name": "Brute Force", "description": "x",
               "kill_chain_phases": [{"phase_name": "credential-access"}],
               "external_references": [{"source_name": "other", "external_id": "no"}, {"source_name": "mitre-attack", "external_id": "T1110"}]}
    lonely = {"type": "attack-pattern", "id": "ap--2", "name": "Loose"}
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps({"objects": [tactic, pattern, {"type": "malware"}, lonely, tactic, {**pattern, "name": "Brute Force 2"}]}))
    objects = knowledge.read_technique_bundle(spark, str(path))
    domains = knowledge.tactic_domains(objects)
    assert domains.count() == 1
    rows = {r.external_ref: (r.title, r.domain, r.confidence) for r in knowledge.technique_entries(objects, domains).collect()}
    assert rows == {"T1110": ("Brute Force 2", "credential-access", 0.95), "ap--2": ("Loose", None, 0.95)}


def test_slug_matching_is_optional(spark):
    objects = spark.createDataFrame(
        [(0, "attack-pattern", "a", "T", "", [("initial-access",)], [])],
        "pos int, type string, id string, name string, description string, kill_chain_phases array<struct<phase_name:string>>, "
        "external_references array<struct<source_name:string,external_id:string>>")
    domains = spark.createDataFrame([(1, "Initial Access")], "domain_id long, name string")
    assert knowledge.technique_entries(objects, domains).first().domain is None
    assert knowledge.technique_entries(objects, domains, match_slugs=True).first().domain == "Initial Access"


DOCS = [(1, "Root login from console. Root login!"), (2, "console login failed"), (3, "bucket listing"), (4, "ROOT root root")]


def _tfidf(docs, query):
    import re
    grams = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\w\w+", t.lower()))
    bags = {i: grams(t) for i, t in docs}
    vocab = {g for b in bags.values() for g in b}
    idf = {g: math.log((1 + len(bags)) / (1 + sum(g in b for b in bags.values()))) + 1 for g in vocab}
    def vec(b):
        w = {g: b.count(g) * idf[g] for g in set(b) if g in vocab}
        n = math.sqrt(sum(v * v for v in w.values()))
        return {g: v / n for g, v in w.items()} if n else {}
    q = vec(grams(query))
    return {i: round(sum(q.get(g, 0) * v for g, v in vec(b).items()), 6) for i, b in bags.items()}


@pytest.mark.parametrize("block_docs,stored", [(1, False), (128, False), (2, True)])
def test_search_matches_plain_cosine(spark, block_docs, stored):
    docs = spark.createDataFrame(DOCS, "id long, body string")
    index = retrieval.tfidf_index(docs, "id", "body", block_docs=block_docs)
    index = retrieval.stored_index(index) if stored else index
    queries = spark.createDataFrame([(1, "root-login"), (2, "root login"), (3, "!!"), (4, "nothing known")], "q long, text string")
    hits = retrieval.search(index, queries, "q", "text", k=2).orderBy("query_id", "hit_rank").collect()
    want = sorted(((s, i) for i, s in _tfidf(DOCS, "root login").items() if s > 0), key=lambda x: (-x[0], x[1]))[:2]
    for q in (1, 2):
        assert [(h.score, h.doc_id) for h in hits if h.query_id == q] == [(pytest.approx(s, abs=1e-6), i) for s, i in want]
    assert {h.query_id for h in hits} == {1, 2}


def test_terms_are_dealt_once_and_repeated_ids_add_up(spark):
    rnd = random.Random(4)
    words = ["aa", "bb", "cc", "dd", "été"]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9)))) for i in range(30)]
    texts += [(3, "aa bb aa"), (3, "zz"), (None, "aa"), (None, "aa cc"), (99, None), (100, "x")]
    bags = {}
    for i, t in texts:
        w = [x for x in (t or "").split() if len(x) > 1]
        bags.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in b for b in bags.values()))) + 1 for b in bags.values() for t in b}
    want = {}
    for i, b in bags.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in b.items()))
        want |= {(i, t): n * idf[t] / norm for t, n in b.items()}
    index = retrieval.tfidf_index(spark.createDataFrame(texts, "id long, body string"), "id", "body")
    assert {(r["doc_id"], r["term"]): r["weight"] for r in index.postings.collect()} == pytest.approx(want)
    vectors = {r["doc_id"]: r[1:] for r in retrieval.document_vectors(index).collect()}
    assert vectors == {i: (len(b), pytest.approx(max(want[i, t] for t in b)), pytest.approx(sum(want[i, t] for t in b))) for i, b in bags.items() if b}
    frequent = retrieval.tfidf_index(spark.createDataFrame(texts, "id long, body string"), "id", "body", max_terms=2)
    assert frequent.vocabulary.count() == 2 and {r["term"] for r in frequent.postings.collect()} == {r["term"] for r in frequent.vocabulary.collect()}

    index = retrieval.tfidf_index(spark.createDataFrame(DOCS, "id long, body string"), "id", "body")
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(term") == 1 and "Join" not in plan


@pytest.mark.parametrize("tokens", [1, 3, 1000])
def test_terms_of_slices_match_plain_counts(monkeypatch, tokens):
    monkeypatch.setattr(retrieval, "SLICE_TOKENS", tokens)
    lists = [["a1", "b1", "a1", "b1"], None, [], ["b1"], ["a1", "b1"], ["c1"] * 5]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, None, 11, 12], pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "tokens"])
    got = Counter()
    for out in retrieval._count_batches([batch.slice(1), batch.slice(0, 1)]):
        for r in out.to_pylist():
            got.update({(r["term"], d["doc_id"]): d["tf"] for d in [r, *(r["more"] or [])]})
    assert got == Counter((t, i) for i, w in zip([7, 8, 9, None, 11, 12], lists) for t in (w or []) + [f"{a} {b}" for a, b in zip(w or [], (w or [])[1:])])


def test_and_search_needs_every_keyword(spark):
    docs = spark.createDataFrame(DOCS, "id long, body string")
    queries = spark.createDataFrame([(1, ["root", "login"]), (2, ["login"]), (3, ["login", "absent"]), (4, [])], "q long, words array<string>")
    hits = retrieval.and_search(docs, "id", "body", queries, "q", "words").orderBy("query_id", "hit_rank").collect()
    assert [(h.query_id, h.doc_id) for h in hits] == [(1, 1), (2, 1), (2, 2)]


def test_keyword_dialects(spark):
    text = F.lit("Brute force login at from host 10.0.0.1:443 2024-01-01T00:00:00Z")
    row = spark.range(1).select(
        retrieval.search_expression(retrieval.alert_keywords(text)).alias("alert"),
        F.size(retrieval.alert_keywords(F.lit("10.0.0.1 2024-01-01T00:00:00Z"))).alias("none"),
        retrieval.search_keywords(F.lit("a-b's to cat_x")).alias("kb"), retrieval.context_keywords(F.lit("re-used host_name ok")).alias("ctx")).first()
    assert row.alert == "Brute & force & login & from & host" and row.none == 0
    assert row.kb == ["abs", "cat_x"] and row.ctx == ["used", "host", "name"]


def test_domain_join_and_lookup(spark):
    entries = spark.createDataFrame([("Brute Force", 1), ("Phishing", None)], "title string, domain_id long")
    domains = spark.createDataFrame([(1, "credential-access")], "domain_id long, domain string")
    assert {r.title: r.domain for r in retrieval.with_domain(entries, domains).collect()} == {"Brute Force": "credential-access", "Phishing": None}
    assert retrieval.technique_by_name(entries, "brute").first().title == "Brute Force"
    gone = knowledge.purge_unreferenced(spark.createDataFrame(
        [("mitre_attack", None), ("mitre_attack", "T1"), (None, None)], "source string, external_ref string"))
    assert gone.count() == 2
