import pytest
from pyspark.sql import functions as F

from trailwarden import rules
from trailwarden.operators import casework, triage, views

CASE = """incident_id string, title string, summary string, risk_score double, risk_band string, severity_hint string,
  top_signals array<struct<label:string,weight:double>>, counter_signals array<string>, detector_labels array<string>,
  retrieved_patterns array<string>, completeness_level string, incompleteness_reasons array<string>,
  checks array<struct<name:string,status:string,detail:string>>, missing_sources array<string>, event_sequence array<string>"""


def case(spark, **changes):
    row = dict(
        incident_id="i1", title="Unusual login", summary="s", risk_score=0.6, risk_band="medium", severity_hint="high",
        top_signals=[("privilege_change", 3.0)], counter_signals=[], detector_labels=["privilege_change"],
        retrieved_patterns=["Suspicious console login"], completeness_level="medium", incompleteness_reasons=["Network was not checked."],
        checks=[("network_logs", "not_checked", None), ("console_login", "checked_signal_found", None)],
        missing_sources=["network_logs"], event_sequence=["ConsoleLogin", "AttachUserPolicy", "DoOtherThing"])
    row.update(changes)
    return spark.createDataFrame([tuple(row.values())], CASE)


def test_privilege_change_recommends_a_reset(spark):
    row = triage.triage(case(spark)).first()
    assert row.recommended_action.action_id == "reset_credentials"
    offered = [a.action_id for a in row.alternative_actions]
    assert len(offered) == 3 and "reset_credentials" not in offered and set(offered) <= set(rules.POLICY["allowed_actions"])
    assert row.completeness_reasons == ["Network was not checked.", "Missing source: network_logs"]
    assert row.completeness_warning == "This recommendation may be incomplete."
    assert row.review_candidates == ["Review network_logs", "Review network_logs if available"]
    assert row.result_errors == []
    assert row.operator_summary.startswith("Unusual login is currently assessed as medium risk. The recommended next step is reset credentials")


def test_low_completeness_prefers_evidence(spark):
    row = triage.triage(case(spark, completeness_level="low", detector_labels=[], retrieved_patterns=[])).first()
    assert row.recommended_action.action_id == "collect_more_evidence"
    assert row.completeness_warning.startswith("This recommendation may be incomplete because")


def test_policy_limits_actions(spark):
    policy = {**rules.POLICY, "allowed_actions": ["continue_monitoring", "collect_more_evidence"], "high_impact_actions": []}
    row = triage.triage(case(spark), policy).first()
    assert row.recommended_action.action_id == "continue_monitoring" or row.recommended_action.action_id == "collect_more_evidence"
    assert len(row.alternative_actions) == 1
    for bad in ({"allowed_actions": []}, {"allowed_actions": ["format_disk"]},
                {"allowed_actions": ["continue_monitoring"], "default_non_expert_safe_action": "collect_more_evidence"}):
        with pytest.raises(ValueError):
            rules.check_policy(bad)


def test_complete_case_has_no_warning(spark):
    row = triage.coverage_review(triage.triage(case(
        spark, completeness_level="high", incompleteness_reasons=[], missing_sources=[], checks=[("console_login", "checked_signal_found", None)]))).first()
    assert row.completeness_warning is None and row.recommendation_may_be_incomplete is False
    assert row.decision_risk_note == "Coverage appears sufficient for the current recommendation."
    assert row.review_candidates == ["Review the incident sequence and top supporting signals"]


def test_coverage_categories_and_note(spark):
    row = triage.coverage_review(triage.triage(case(spark, counter_signals=["known host"]))).first()
    status = {r.category: r.status for r in row.coverage_status_by_category}
    assert status == {"login": "checked_signal_found", "network": "not_checked"}
    assert "disruptive action" in row.decision_risk_note
    assert row.what_could_change_the_decision[0].startswith("If network_logs shows")
    assert len(row.what_could_change_the_decision) == 5


def test_rejects_carry_reasons(spark):
    both = case(spark).unionByName(case(spark, incident_id="i2", completeness_level="none", checks=[("x", "odd", None)]))
    good, bad = triage.split_valid(both)
    assert [r.incident_id for r in good.collect()] == ["i1"]
    assert bad.first().input_errors == ["Invalid completeness_level.", "Invalid coverage check status."]


def test_missing_fields_and_policies_are_rejected(spark):
    rows = case(spark).unionByName(case(spark, incident_id="i2").withColumns({"title": F.lit(None).cast("string"), "summary": F.lit(None).cast("string")}))
    results, rejected = triage.triage_or_reject(rows)
    assert [r.incident_id for r in results.collect()] == ["i1"]
    assert rejected.first().input_errors == ["incident missing required fields: title, summary"]
    assert triage.policy_errors({}) == ["policy missing required fields: allowed_actions"]
    assert triage.policy_errors({"allowed_actions": []}) == ["policy.allowed_actions must not be empty."]
    results, rejected = triage.triage_or_reject(case(spark), {**triage.POLICY, "default_non_expert_safe_action": "other"})
    assert results.count() == 0 and rejected.first().input_errors == ["default_non_expert_safe_action must be in allowed_actions."]


def test_double_check_changes_the_decision(spark):
    first = case(spark, risk_score=0.5)
    late = spark.createDataFrame([("i1", 0.9, [], ["Resource creation after sensitive activity", "root"])],
                                 "incident_id string, risk_score double, detector_labels array<string>, retrieved_patterns array<string>")
    row = triage.double_check(first, late).first()
    assert (row.first_action_id, row.recommended_action.action_id, row.decision_changed) == (
        "reset_credentials", "temporary_access_lock", True)


def test_hypotheses(spark):
    plain = triage.triage(case(spark)).first().hypotheses
    assert [(h.hypothesis_id, h.confidence) for h in plain] == [("compromised_identity", "medium"), ("misconfigured_automation", "low")]
    root = triage.triage(case(spark, detector_labels=["root_actor"])).first().hypotheses
    assert root[2].hypothesis_id == "high_privilege_operator_activity"


def test_alerts_are_sent_once(spark):
    cases = triage.triage(case(spark))
    nothing = spark.createDataFrame([], "dedupe_key string")
    first = casework.pending_alerts(casework.alert_candidates(cases, casework.parse_recipients("a@x.org; b@x.org,")), nothing)
    assert {r.recipient for r in first.collect()} == {"a@x.org", "b@x.org"}
    assert casework.pending_alerts(casework.alert_candidates(cases, ["a@x.org", "b@x.org"]), first).count() == 0
    assert casework.alert_candidates(triage.triage(case(spark, severity_hint="medium")), ["a@x.org"]).count() == 0


def _request(spark, kind, action=None, rationale=None):
    return spark.createDataFrame([("i1", kind, action, rationale, False, None)],
                                 "incident_id string, decision_type string, action_id string, rationale string, used_double_check boolean, actor string"
                                 ).withColumn("created_at", F.lit("2025-01-01 00:00:00").cast("timestamp"))


def test_operator_decisions_and_report(spark):
    reviewed = triage.coverage_review(triage.triage(case(spark)))
    decide = lambda *args: casework.apply_decisions(_request(spark, *args), reviewed).first()
    assert decide("approve_recommendation").chosen_action_id == "reset_credentials"
    assert decide("choose_alternative", "temporary_access_lock").rejected is True
    assert decide("choose_alternative", "escalate_to_expert").selected_from == "alternative"
    assert decide("escalate").chosen_action_id == "escalate_to_expert"
    more = decide("request_more_analysis")
    assert (more.chosen_action_id, more.selected_from) == ("collect_more_evidence", "double_check")

    decision = casework.apply_decisions(_request(spark, "approve_recommendation", None, "<b>ok</b>"), reviewed)
    assert casework.decision_events(decision).first().event_type == "approval_report_generated"
    report = casework.approval_reports(decision, triage.triage(case(spark)), F.lit("2025-01-02 00:00:00").cast("timestamp"))
    row = report.select("*", casework.report_html().alias("html"), casework.report_lines().alias("lines")).first()
    assert row.why_concerned == ["Permissions or access levels changed during the incident."]
    assert row.blind_spots == ["Network: Some important checks were not completed yet."]
    assert "<b>ok" not in row.html and "&lt;b&gt;ok&lt;/b&gt;" in row.html
    assert row.lines[0] == "Incident desk Approval Report" and "- Network: Some important checks were not completed yet." in row.lines


def test_views(spark):
    row = case(spark).select(
        views.timeline().alias("timeline"), views.concern_summary().alias("concern"),
        views.actor_short_name(F.lit("arn:aws:iam::1:user/ann")).alias("who"),
        views.severity_tone(F.lit("Medium-high")).alias("tone"), views.coverage_tone(F.lit("checked_no_signal")).alias("cover"),
        views.display_label(F.lit("device_context")).alias("label"),
        views.human_list(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("list")).first()
    assert row.timeline == ["Signed in to the AWS console", "Attached a new permission policy to a user", "Do Other Thing"]
    assert row.concern.startswith("Someone signed in interactively through the AWS console, and permissions or access")
    assert (row.who, row.tone, row.cover, row.label, row.list) == ("ann", "critical", "safe", "Device Context", "a, b, and c")


def test_newest_rows(spark):
    rows = spark.createDataFrame([("i", 1, 1, "low"), ("i", 2, 2, "high"), ("i", 2, 3, "higher"), ("j", 1, 4, "x")],
                                 "incident_id string, created_at int, row_id int, v string")
    assert {r.incident_id: r.v for r in casework.latest(rows, ["incident_id"], ["created_at", "row_id"]).collect()} == {"i": "higher", "j": "x"}
    assert casework.latest_n(rows, ["incident_id"], ["created_at", "row_id"], 2).count() == 3
    twice = casework.upsert(casework.upsert(rows.limit(0), rows, ["incident_id"], "row_id"), rows, ["incident_id"], "row_id")
    assert {r.v for r in twice.collect()} == {"higher", "x"}
    replaced = casework.replace_by_key(rows, spark.createDataFrame([("i", 9, 9, "new")], rows.schema), "incident_id")
    assert {r.v for r in replaced.collect()} == {"new", "x"}
