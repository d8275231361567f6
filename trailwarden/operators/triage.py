"""Recommended action, alternatives, hypotheses and coverage review for every incident.

All of it is row-wise on the incident: the allowed actions are an array that is
scored and sorted inside the row, so triage adds no shuffle to the plan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import python_capitalize
from ..rules import ACTIONS, CHECK_STATUSES, COVERAGE_KEYWORDS, LEVELS, POLICY, check_policy
from .retrieval import pattern_titles

_CHECK = "struct<name:string,status:string,detail:string>"


def _texts(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def _has_any(array: str | Column, values: list[str]) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(v) for v in values]))


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.4, "medium").otherwise("low")


def _check(name: str, status: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), status.alias("status"), F.lit(None).cast("string").alias("detail"))


def with_coverage(incidents: DataFrame) -> DataFrame:
    """What was and was not looked at, judged from the incident row itself."""
    has_resources = F.coalesce(F.col("resource_types_seen"), F.lit("")) != ""
    has_agents = F.coalesce(F.col("user_agents_seen"), F.lit("")) != ""
    seen = lambda present: F.when(present, "checked_signal_found").otherwise("data_unavailable")
    reasons = _texts(
        F.lit("Network telemetry was not checked."),
        F.when(~has_resources, "No resource summary was available for this incident."),
        F.when(~has_agents, "User-agent context was missing."),
    )
    return incidents.withColumns({
        "incompleteness_reasons": reasons,
        "checks": F.array(_check("network_logs", F.lit("not_checked")), _check("resource_summary", seen(has_resources)),
                          _check("user_agent_context", seen(has_agents))),
        "completeness_level": F.when(F.size(reasons) <= 2, "medium").otherwise("low"),
        "missing_sources": F.array(F.lit("network_logs")),
    })


def decision_inputs(labeled: DataFrame, risk_score: Column) -> DataFrame:
    """Case fields for triage from a labeled (and scored) incident."""
    name = F.coalesce(F.nullif(F.col("top_event_name"), F.lit("")), F.lit("unknown activity"))
    described = labeled.withColumns({
        "title": F.concat(F.lit("Incident centered on "), name),
        "summary": F.concat(F.lit("Actor "), F.coalesce("actor_key", F.lit("None")), F.lit(" produced "),
                            F.col("event_count").cast("string"), F.lit(" events.")),
        "risk_score": risk_score,
        "risk_band": risk_band(risk_score),
        "severity_hint": risk_band(risk_score),
        "top_signals": F.transform("weak_label_reasons", lambda r: F.struct(r["rule"].alias("label"), r["weight"].alias("weight"))),
        "counter_signals": F.array().cast("array<string>"),
        "detector_labels": F.transform("weak_label_reasons", lambda r: r["rule"]),
        "retrieved_patterns": pattern_titles(),
        "event_sequence": F.coalesce(F.split("ordered_event_name_sequence", r"\|"), F.array().cast("array<string>")),
    })
    return with_coverage(described)


def policy_errors(policy: Mapping[str, Any]) -> list[str]:
    """What is wrong with a policy; it concerns every case alike."""
    allowed, default = list(policy.get("allowed_actions") or []), policy.get("default_non_expert_safe_action")
    if "allowed_actions" not in policy:
        return ["policy missing required fields: allowed_actions"]
    if not allowed:
        return ["policy.allowed_actions must not be empty."]
    return ["default_non_expert_safe_action must be in allowed_actions."] if default and default not in allowed else []


def _missing(part: str, *columns: str) -> Column:
    names = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in columns])
    return F.when(names != "", F.concat(F.lit(f"{part} missing required fields: "), names))


def input_errors(policy: Mapping[str, Any] = POLICY) -> Column:
    """Why a case cannot be triaged; an empty array means it can."""
    bad_status = F.exists("checks", lambda c: ~F.coalesce(c["status"].isin(CHECK_STATUSES), F.lit(False)))
    level = F.col("completeness_level")
    return _texts(
        _missing("incident", "incident_id", "title", "summary"),
        _missing("detector_output", "top_signals"),
        _missing("coverage", "completeness_level", "incompleteness_reasons", "checks"),
        F.when(~level.isin(LEVELS), "Invalid completeness_level."),
        F.when(F.coalesce(bad_status, F.lit(False)), "Invalid coverage check status."),
        *[F.lit(e) for e in policy_errors(policy)],
    )


def split_valid(cases: DataFrame, policy: Mapping[str, Any] = POLICY) -> tuple[DataFrame, DataFrame]:
    """Cases that can be triaged, and the rejects with their reasons."""
    checked = cases.withColumn("input_errors", input_errors(policy))
    valid = F.size("input_errors") == 0
    return checked.where(valid).drop("input_errors"), checked.where(~valid)


def with_completeness(cases: DataFrame) -> DataFrame:
    """Reasons with missing sources appended, and the warning that follows from them."""
    missing = F.transform(F.coalesce(F.col("missing_sources"), F.array().cast("array<string>")),
                          lambda s: F.concat(F.lit("Missing source: "), s))
    fresh = F.filter(F.array_distinct(missing), lambda m: ~F.array_contains("incompleteness_reasons", m))
    reasons = F.concat("incompleteness_reasons", fresh)
    level = F.col("completeness_level")
    return cases.withColumns({
        "completeness_reasons": reasons,
        "completeness_warning": F.when(
            level == "low", "This recommendation may be incomplete because key checks or sources are missing."
        ).when((level == "medium") & (F.size(reasons) > 0), "This recommendation may be incomplete."),
    })


def review_candidates() -> Column:
    open_checks = F.filter("checks", lambda c: c["status"].isin("not_checked", "data_unavailable"))
    found = F.slice(F.concat(
        F.transform(open_checks, lambda c: F.concat(F.lit("Review "), c["name"])),
        F.transform(F.coalesce(F.col("missing_sources"), F.array().cast("array<string>")),
                    lambda s: F.concat(F.lit("Review "), s, F.lit(" if available"))),
    ), 1, 5)
    default = F.array(F.lit("Review the incident sequence and top supporting signals"))
    return F.when(F.size(found) > 0, found).otherwise(default)


def action_score(action: str, policy: Mapping[str, Any]) -> Column:
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    low = F.col("completeness_level") == "low"
    patterns = F.lower(F.array_join("retrieved_patterns", " "))
    points = F.lit(0.0)
    if action == "continue_monitoring":
        points = F.lit(1.0) - risk
    elif action == "collect_more_evidence":
        points = F.when(low, 2.0).otherwise(0.5)
    elif action == "escalate_to_expert":
        points = F.when(low, 1.5).otherwise(0.5)
    elif action == "reset_credentials":
        elevated = _has_any("detector_labels", ["privilege_change", "root_actor"]) | patterns.contains("privilege")
        points = F.when(elevated, 2.5).otherwise(0.0) + risk
    elif action == "temporary_access_lock":
        exposed = patterns.contains("resource creation") | patterns.contains("root")
        points = F.when(risk >= 0.7, 2.0).otherwise(0.0) + F.when(exposed, 1.5).otherwise(0.0)
    if action in policy["high_impact_actions"]:
        points = points - F.when(low, 1.5).otherwise(0.0)
    return F.round(points - ACTIONS[action]["disruption"] * 0.1, 9)


def with_actions(cases: DataFrame, policy: Mapping[str, Any] = POLICY) -> DataFrame:
    """Score every allowed action; the best is recommended, the next three are alternatives."""
    policy = check_policy(dict(policy))
    options = []
    for action in policy["allowed_actions"]:
        about = ACTIONS[action]
        options.append(F.struct(
            (-action_score(action, policy)).alias("rank_score"), F.lit(action).alias("action_id"),
            *[F.lit(about[f]).alias(f) for f in ("label", "priority", "reason", "reversibility",
                                                 "requires_human_approval", "tradeoff")]))
    ranked = cases.withColumn("_ranked", F.array_sort(F.array(*options)))
    best = F.col("_ranked")[0]
    shown = ("action_id", "label", "priority", "reason", "reversibility", "requires_human_approval")
    return ranked.withColumns({
        "recommended_action": F.struct(*[best[f].alias(f) for f in shown]),
        "recommended_score": -best["rank_score"],
        "alternative_actions": F.transform(F.slice("_ranked", 2, 3), lambda a: F.struct(
            *[a[f].alias(f) for f in ("action_id", "label", "priority", "reason", "tradeoff")])),
    }).drop("_ranked")


def hypotheses() -> Column:
    """Competing explanations with what supports, weakens and is missing for each."""
    missing = F.slice("incompleteness_reasons", 1, 2)
    signals = F.transform(F.slice("top_signals", 1, 2), lambda s: s["label"])
    patterns = F.col("retrieved_patterns")
    root = F.array_contains("detector_labels", "root_actor") | F.exists(
        patterns, lambda p: F.lower(p).contains("root"))

    def entry(key: str, label: str, supporting: Column, weakening: str, confidence: Column) -> Column:
        return F.struct(
            F.lit(key).alias("hypothesis_id"), F.lit(label).alias("label"), supporting.alias("supporting_evidence"),
            F.array(F.lit(weakening)).alias("weakening_evidence"), missing.alias("missing_evidence"),
            confidence.alias("confidence"))

    cautious = F.when(F.array_contains("detector_labels", "privilege_change"), "low").otherwise("medium")
    return F.filter(F.array(
        entry("compromised_identity", "Compromised identity or credential misuse",
              F.when(F.size(signals) > 0, signals).otherwise(F.array(F.lit("Elevated detector signals"))),
              "No confirmed remediation outcome yet", F.lit("medium")),
        entry("misconfigured_automation", "Misconfigured or broken automation",
              F.concat(F.array(F.lit("Repeated or bursty control-plane activity")), F.slice(patterns, 1, 1)),
              "Some signals also match abuse patterns", cautious),
        F.when(root, entry("high_privilege_operator_activity", "High-privilege operator or root-driven activity",
                           F.array(F.lit("Root or high-privilege activity was observed")),
                           "Intent is not confirmed from CloudTrail alone", F.lit("medium"))),
    ), lambda h: h.isNotNull())


def operator_summary(non_expert: bool = True) -> Column:
    subject = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("This incident"))
    band = F.coalesce(F.nullif(F.col("risk_band"), F.lit("")), F.lit("unknown"))
    first = F.concat(
        subject, F.lit(" is currently assessed as "), band, F.lit(" risk. The recommended next step is "),
        F.lower("recommended_action.label"), F.lit(" because "), F.lower("recommended_action.reason"))
    closing = F.lit(None if non_expert else "Review the structured evidence before taking disruptive action.")
    return F.concat_ws(" ", first, F.col("completeness_warning"), closing.cast("string"))


def result_errors(policy: Mapping[str, Any] = POLICY) -> Column:
    """What is wrong with a triage result; an empty array means it is valid."""
    allowed = list(policy["allowed_actions"])
    ids = F.concat(F.array("recommended_action.action_id"), F.transform("alternative_actions", lambda a: a["action_id"]))
    level = F.col("completeness_level")
    return _texts(
        F.when(F.exists(ids, lambda i: i.isNotNull() & ~i.isin(allowed)), "Out-of-policy action_id detected."),
        F.when(F.col("recommended_action.action_id").isNull(), "Missing recommended action."),
        F.when(~F.coalesce(level.isin(LEVELS), F.lit(False)), "Invalid completeness assessment."),
        F.when((level == "low") & (F.size("completeness_reasons") == 0), "Low completeness requires reasons."),
    )


def triage(cases: DataFrame, policy: Mapping[str, Any] = POLICY, non_expert: bool = True) -> DataFrame:
    """Complete triage result per case."""
    decided = with_actions(with_completeness(cases), policy)
    return decided.withColumns({
        "hypotheses": hypotheses(),
        "review_candidates": review_candidates(),
        "operator_summary": operator_summary(non_expert),
    }).withColumn("result_errors", result_errors(policy))


def triage_or_reject(cases: DataFrame, policy: Mapping[str, Any] = POLICY, non_expert: bool = True) -> tuple[DataFrame, DataFrame]:
    """Triage results of the valid cases, and the other cases with their ``input_errors`` (all, if the policy is invalid)."""
    valid, rejected = split_valid(cases, policy)
    return triage(valid, POLICY if policy_errors(policy) else policy, non_expert), rejected


# --- coverage review -----------------------------------------------------------------
def _in_category(name: Column, words: list[str]) -> Column:
    plain = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit("_"))
    return plain.rlike("|".join(re.escape(word) for word in words))


def _category(words: list[str], category: str) -> Column:
    """The category as an array of one, or of null; what was found is bound once."""
    found = F.array(F.struct(
        F.filter("checks", lambda c: _in_category(c["name"], words)).alias("checks"),
        F.filter(F.coalesce(F.col("missing_sources"), F.array().cast("array<string>")),
                 lambda s: _in_category(s, words)).alias("sources")))

    def described(f: Column) -> Column:
        any_is = lambda status: F.exists(f["checks"], lambda c: c["status"] == status)
        has_sources = F.size(f["sources"]) > 0
        status = (
            F.when(any_is("checked_signal_found"), "checked_signal_found")
            .when(any_is("checked_no_signal"), "checked_no_signal")
            .when(any_is("not_checked"), "not_checked")
            .when(any_is("data_unavailable") | has_sources, "data_unavailable")
            .otherwise("unknown")
        )
        return F.when((F.size(f["checks"]) > 0) | has_sources, F.struct(
            F.lit(category).alias("category"), status.alias("status"), f["checks"].alias("checks"),
            f["sources"].alias("missing_sources")))

    return F.transform(found, described)


def coverage_by_category() -> Column:
    """Status per category with at least one matching check or missing source."""
    rows = [_category(words, category) for category, words in COVERAGE_KEYWORDS.items()]
    return F.filter(F.concat(*rows), lambda r: r.isNotNull())


def decision_risk_note() -> Column:
    warning = F.col("completeness_warning")
    label = F.lower(F.coalesce("recommended_action.label", "recommended_action.action_id", F.lit("the current action")))
    return (
        F.when(warning.isNull(), "Coverage appears sufficient for the current recommendation.")
        .when(F.col("recommended_action.requires_human_approval"), F.concat(
            warning, F.lit(" "), python_capitalize(label),
            F.lit(" should be reviewed carefully because it is a disruptive action.")))
        .otherwise(F.concat(warning, F.lit(" Review missing checks before relying on "), label, F.lit(".")))
    )


def decision_change_hints() -> Column:
    sources = F.transform(F.coalesce(F.col("missing_sources"), F.array().cast("array<string>")), lambda s: F.concat(
        F.lit("If "), s, F.lit(" shows additional suspicious activity, the recommended action may need to change.")))
    open_items = F.transform(F.slice("review_candidates", 1, 3), lambda c: F.concat(
        F.lit("Completing "), F.lower(c), F.lit(" could confirm or weaken the current recommendation.")))
    others = _texts(
        F.when(F.col("recommended_action.requires_human_approval"),
               "If the missing checks do not support elevated misuse, a lower-disruption alternative may be safer."),
        F.when(F.size("counter_signals") > 0,
               "Counter-signals may justify a less disruptive response after review."),
    )
    return F.slice(F.array_distinct(F.concat(sources, open_items, others)), 1, 5)


def coverage_review(triaged: DataFrame) -> DataFrame:
    """Review record per incident: what was checked, what is open, what could change."""
    return triaged.withColumns({
        "coverage_status_by_category": coverage_by_category(),
        "recommendation_may_be_incomplete": F.col("completeness_warning").isNotNull(),
        "decision_risk_note": decision_risk_note(),
        "what_could_change_the_decision": decision_change_hints(),
        "double_check_prompt": F.lit("Double check missing branches before taking disruptive action."),
    })


OVERRIDABLE = ["risk_score", "risk_band", "top_signals", "counter_signals", "detector_labels", "retrieved_patterns",
               "completeness_level", "incompleteness_reasons", "checks", "missing_sources"]


def double_check(cases: DataFrame, overrides: DataFrame, policy: Mapping[str, Any] = POLICY) -> DataFrame:
    """Re-triage with evidence that arrived later and say whether the action changes.

    ``overrides`` holds at most one row per incident; its null fields keep the
    first value.
    """
    given = [c for c in OVERRIDABLE if c in overrides.columns]
    renamed = overrides.select("incident_id", *[F.col(c).alias(f"_new_{c}") for c in given])
    before = with_actions(with_completeness(cases), policy).select(
        *cases.columns, F.col("recommended_action.action_id").alias("first_action_id"))
    merged = before.join(renamed, "incident_id", "left").withColumns(
        {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in given}).drop(*[f"_new_{c}" for c in given])
    again = triage(merged, policy)
    return again.withColumn("decision_changed", F.col("recommended_action.action_id") != F.col("first_action_id"))
