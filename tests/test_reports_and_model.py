import math

import pytest
from pyspark.sql import functions as F

from trailwarden import rules
from trailwarden.operators import labels, metrics, model, quality

INCIDENT = """incident_id string, actor_key string, primary_source_ip_address string, error_event_count long, success_event_count long,
  event_count long, incident_duration_seconds double, distinct_event_names long, distinct_event_sources long, distinct_regions long,
  contains_recon_like_api boolean, contains_privilege_change_api boolean, contains_resource_creation_api boolean,
  contains_console_login boolean, ordered_event_source_sequence string, first_event_name string, last_event_name string, top_event_name string"""


def _incident(i, actor="arn:aws:iam::1:root", errors=0, recon=True, privilege=True, login=True, sources="iam.amazonaws.com|sts.amazonaws.com"):
    return (f"i{i}", actor, f"10.0.0.{i % 3}", errors, 5 - errors, 5, 60.0 + i, 3, 2, 1, recon, privilege, False, login, sources, "A", "B", f"E{i % 4}")


def test_weak_labels(spark):
    table = spark.createDataFrame([_incident(1), _incident(2, "user", recon=False, privilege=False, login=False, sources=None)], INCIDENT)
    rows = {r.incident_id: r for r in labels.apply_weak_labels(table, {**rules.LABEL_RULES, "label_threshold": 3}).collect()}
    assert {r.rule for r in rows["i1"].weak_label_reasons} >= {"console_login", "recon_activity", "privilege_change", "root_actor"}
    assert (rows["i1"].weak_label_suspicious, rows["i2"].weak_label_suspicious, rows["i2"].weak_label_score) == (1, 0, 0.0)
    assert rows["i1"].weak_label_reasons_json.startswith('[{"rule":"recon_activity","weight":2.0}')
    report = labels.label_report(labels.apply_weak_labels(table)).first()
    assert (report.incident_count, report.positive_count, report.hits_iam_sequence, report.score_min) == (2, 1, 1, 0.0)


def test_missing_weights_count_zero(spark):
    table = spark.createDataFrame([_incident(1)], INCIDENT)
    bare = {"weights": {"root_actor": 2}, "thresholds": rules.LABEL_RULES["thresholds"], "label_threshold": 1}
    assert labels.apply_weak_labels(table, bare).first().weak_label_score == 2.0


def test_rule_files(tmp_path):
    (tmp_path / "flags.yaml").write_text("console_login_event_names: [ConsoleLogin, 7]\n")
    assert rules.load_flag_rules(tmp_path / "flags.yaml") == {"console_login_event_names": ["7", "ConsoleLogin"]}
    (tmp_path / "labels.yaml").write_text("weights: {root_actor: 2}\n")
    assert rules.load_label_rules(tmp_path / "labels.yaml") == {"weights": {"root_actor": 2}, "thresholds": {}, "label_threshold": 1}
    (tmp_path / "policy.yaml").write_text("allowed_actions: [bad]\n")
    with pytest.raises(ValueError):
        rules.load_policy(tmp_path / "policy.yaml")


EVENT = """global_sort_key string, event_id string, event_time timestamp, source_file_name string, record_index_in_file long, event_name string,
  event_source string, actor_key string, source_ip_address string, aws_region string"""


def _quality(spark, rows, incidents):
    events = spark.createDataFrame(rows, EVENT.replace("event_time timestamp", "event_time string")).withColumn(
        "event_time", F.col("event_time").cast("timestamp"))
    return events, spark.createDataFrame(incidents, "event_count long, incident_duration_seconds double")


def test_quality_report_and_validation(spark):
    events, cases = _quality(spark, [
        ("2", "e1", "2024-01-01 00:00:00", "f", 0, "n", "s", "a", "ip", "r"),
        ("1", "e1", "2024-01-01 00:01:00", "f", 1, "n", None, "a", None, "r"),
        ("3", None, None, "f", 2, None, None, "b", None, None)], [(0, -1.0)])
    report = quality.quality_report(events, cases).first()
    assert (report.duplicate_event_ids, report.invalid_timestamps, report.rows_missing_event_name_and_event_source,
            report.impossible_incident_durations) == (1, 1, 1, 1)
    parsed = spark.createDataFrame([(5,)], "total_records_parsed long")
    errors = quality.validate_outputs(events, cases, parsed).first().errors
    assert [e.split()[0] for e in errors] == ["Event", "Event", "Every"]
    rates = {r.column_name: r.null_rate for r in quality.null_rates(events).collect()}
    assert rates["source_ip_address"] == 0.666667 and rates["actor_key"] == 0.0
    described = {r.column_name: (r.data_type, r.nullable) for r in quality.describe_schema(events, "t").collect()}
    assert described["event_time"] == ("timestamp", True) and described["actor_key"] == ("string", False)
    top = quality.top_values(events, ["actor_key"], 1).first()
    assert (top.value, top.value_count) == ("a", 2)


def test_valid_output_has_no_errors(spark):
    events, cases = _quality(spark, [
        ("1", "e1", "2024-01-01 00:00:00", "f", 0, "n", "s", "a", "ip", "r"),
        ("2", "e2", "2024-01-01 00:01:00", "f", 1, "n", "s", "a", "ip", "r")], [(2, 60.0)])
    assert quality.validate_outputs(events, cases, spark.createDataFrame([(2,)], "total_records_parsed long")).first().errors == []


def test_ranking_metrics_against_pairs(spark):
    rows = [(i * 7 % 3 == 0, (i * 13 % 17) / 10) for i in range(60)]
    table = spark.createDataFrame([(int(y), float(s)) for y, s in rows], "label int, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = tp = seen = 0
    for score in sorted({s for _, s in rows}, reverse=True):
        hit = sum(1 for y, s in rows if s == score and y)
        tp, seen = tp + hit, seen + sum(1 for _, s in rows if s == score)
        ap += hit / len(pos) * tp / seen
    got = metrics.ranking_metrics(table).first()
    assert (got.roc_auc, got.average_precision) == (pytest.approx(auc, abs=1e-6), pytest.approx(ap, abs=1e-6))
    assert metrics.ranking_metrics(table.where("label = 1")).first().roc_auc is None


@pytest.fixture(scope="module")
def labeled(spark):
    rows = [_incident(i, "arn:root:root" if i % 5 == 0 else f"arn:user/{i % 7}", errors=i % 6, recon=i % 2 == 0, privilege=i % 3 == 0, login=i % 4 == 0,
                      sources="iam.amazonaws.com" if i % 3 == 0 else "s3.amazonaws.com") for i in range(240)]
    return labels.apply_weak_labels(spark.createDataFrame(rows, INCIDENT)).cache()


def test_split_is_stratified_and_exact(labeled):
    split = model.stratified_split(labeled)
    n = {r.weak_label_suspicious: r["count"] for r in labeled.groupBy("weak_label_suspicious").count().collect()}
    test = {r.weak_label_suspicious: r["count"] for r in split.where("is_test").groupBy("weak_label_suspicious").count().collect()}
    assert test == {k: round(v * 0.2) for k, v in n.items()}
    assert split.count() == 240


def test_balanced_sample(labeled):
    assert model.balanced_sample(labeled, 1000).count() == 240
    counts = {r.weak_label_suspicious: r["count"] for r in model.balanced_sample(labeled, 100).groupBy("weak_label_suspicious").count().collect()}
    assert sum(counts.values()) == 100 and min(counts.values()) >= min(50, labeled.groupBy("weak_label_suspicious").count().agg(F.min("count")).first()[0])


@pytest.mark.parametrize("kind", [model.LOGISTIC, model.ADDITIVE])
def test_contributions_add_up_to_the_logit(labeled, kind):
    fitted = model.fit_incident_model(labeled, kind, max_iter=15, bins=4, interactions=3, rounds=4)
    scored = model.score_incidents(fitted, labeled)
    explained = model.contributions(fitted, scored, k=100, least=0.0)
    intercept = fitted.intercept
    for row in explained.limit(40).collect():
        logit = math.log(row.ml_suspicion_proba / (1 - row.ml_suspicion_proba))
        assert intercept + sum(c.contribution for c in row.contributions) == pytest.approx(logit, abs=1e-3)
        sizes = [abs(c.contribution) for c in row.contributions]
        assert sizes == sorted(sizes, reverse=True)
        assert {c.direction for c in row.contributions} <= {"increases suspicion", "reduces suspicion"}
    assert metrics.ranking_metrics(scored, model.LABEL, "ml_suspicion_proba").first().roc_auc > 0.95
    top = model.top_coefficients(fitted, labeled, 3).collect()
    assert len(top) == 6 and top[0].coefficient >= top[1].coefficient


@pytest.mark.parametrize("kind", [model.LOGISTIC, model.ADDITIVE])
def test_saved_models_score_alike_and_unseen_values_count_nothing(spark, labeled, tmp_path, kind):
    fitted = model.fit_incident_model(labeled, kind, max_iter=10, bins=4, interactions=2, rounds=3)
    model.save_model(fitted, spark, str(tmp_path / kind))
    again = model.load_model(spark, str(tmp_path / kind))
    scores = [{r.incident_id: r.ml_suspicion_proba for r in model.score_incidents(m, labeled).collect()} for m in (fitted, again)]
    assert scores[0] == scores[1]
    strange = labeled.limit(5).withColumn("top_event_name", F.lit("never met before"))
    for m in (fitted, again):
        for r in model.contributions(m, strange, k=100, least=0.0).collect():
            own = [c for c in r.contributions if c.column_name == "top_event_name"]
            assert [c.contribution for c in own] == [0.0] and own[0].raw_value == "never met before"


def test_single_class_gives_a_constant(labeled):
    fitted = model.fit_incident_model(labeled.where("weak_label_suspicious = 1"))
    row = model.score_incidents(fitted, labeled).agg(F.min("ml_suspicion_proba"), F.max("ml_suspicion_pred")).first()
    assert tuple(row) == (1.0, 1)


def test_names_and_sentences(spark):
    row = spark.range(1).select(
        F.lit("Login").alias("top_event_name"), model.friendly_name(F.lit("bool__contains_console_login")).alias("n"),
        model.confidence(F.lit(0.9)).alias("c")).select(
        "n", "c", model.contribution_text(F.col("n"), F.lit(-1.0)).alias("t"),
        model.contribution_text(F.lit("Top event name X"), F.lit(1.0)).alias("u")).first()
    assert (row.n, row.c) == ("Contains console login", 0.8)
    assert row.t == "An interactive console login reduced suspicion."
    assert row.u == "The dominant event pattern around Login increased suspicion."
