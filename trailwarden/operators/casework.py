"""Case history: latest views, append/upsert rules, decisions, alerts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import phrase, python_capitalize
from ..rules import ACTIONS, COVERAGE_STATUS_EXPLANATIONS, SIGNAL_EXPLANATIONS
from .triage import coverage_review


# --- lookups -----------------------------------------------------------------------
def incident_by_id(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == incident_id)


def earliest_matching(
    incidents: DataFrame, source_ip: str | None = None, actor: str | None = None
) -> DataFrame:
    """The first incident with the hinted IP and actor (either may be left out)."""
    if source_ip:
        incidents = incidents.where(F.col("primary_source_ip_address") == source_ip)
    if actor:
        incidents = incidents.where(F.col("actor_key") == actor)
    return incidents.orderBy(F.asc_nulls_last("incident_start_time"), "incident_id").limit(1)


def recent_high_severity(cases: DataFrame, now: Column, lookback_hours: float = 1, limit: int = 100) -> DataFrame:
    touched = F.coalesce("updated_at", "created_at")
    recent = F.coalesce(touched, now) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_hours * 3600.0))
    return (
        cases.where((F.lower(F.coalesce("severity_hint", F.lit(""))) == "high") & recent)
        .orderBy(touched.desc_nulls_last(), F.desc("incident_id")).limit(limit)
    )


def suspicious_first(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("ml_suspicion_pred") == 1).orderBy(F.desc("ml_suspicion_proba"), "incident_id")


def incident_list(cases: DataFrame, limit: int = 25) -> DataFrame:
    return cases.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.desc("incident_id")).limit(limit)


# --- history views --------------------------------------------------------------------
def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, as an aggregate that is combined before the shuffle."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def latest_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 10) -> DataFrame:
    """Newest ``n`` rows per key, numbered from one; cut map-side before the shuffle."""
    by_age = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("recency", F.row_number().over(by_age)).where(F.col("recency") <= n)


def policy_snapshot(policies: DataFrame, version: str | None = None) -> DataFrame:
    if version is not None:
        return policies.where(F.col("policy_version") == version)
    return policies.agg(F.max_by(F.struct(*policies.columns), F.struct("created_at", "policy_version")).alias("_row")).select("_row.*")


# --- write rules: each returns the next snapshot --------------------------------------
def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace by key; among incoming rows the highest ``order`` (of any type that sorts) wins."""
    columns = current.columns
    old = current.withColumns({"_new": F.lit(0), "_order": F.lit(None).cast(incoming.select(order).schema[0].dataType)})
    new = incoming.select(*columns, F.lit(1).alias("_new"), F.col(order).alias("_order"))
    return latest(old.unionByName(new), keys, ["_new", "_order"]).select(*columns)


def insert_if_absent(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` to append: one per key that ``current`` does not hold."""
    fresh = incoming.join(current.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(*incoming.columns)).alias("_row")).select("_row.*")


def replace_by_key(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Drop every current row of the incoming keys, then add the incoming rows."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


# --- context --------------------------------------------------------------------------
def members_in_order(members: DataFrame, limit: int = 50) -> DataFrame:
    """First ``limit`` events per incident, by place, time (nulls last) and id."""
    order = Window.partitionBy("incident_id").orderBy("event_index", F.asc_nulls_last("event_time"), "event_id")
    return members.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def member_events(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """The listed events of every incident, joined on the canonical row index."""
    listed = incidents.select("incident_id", F.posexplode("ordered_row_indices").alias("event_index", "raw_event_row_index"))
    return listed.join(events, "raw_event_row_index").select(
        "incident_id", "event_index", "raw_event_row_index", "event_id", "event_time", "event_name", "event_source")


def context_bundle(
    incidents: DataFrame, evidence: DataFrame, detector: DataFrame, coverage: DataFrame, decision: DataFrame,
    members: DataFrame | None = None,
) -> DataFrame:
    """Incident with its latest records as structs; missing parts stay null and are flagged."""
    bundle = incidents
    for name, rows in {"evidence_package": evidence, "detector_result": detector,
                       "coverage_assessment": coverage, "decision_support_result": decision}.items():
        newest = latest(rows, ["incident_id"], ["created_at", "row_id"])
        bundle = bundle.join(newest.select("incident_id", F.struct(*newest.columns).alias(name)), "incident_id", "left")
        bundle = bundle.withColumn(f"has_{name}", F.col(name).isNotNull())
    if members is not None:
        listed = members_in_order(members).groupBy("incident_id").agg(
            F.array_sort(F.collect_list(F.struct("event_index", "event_time", "event_id", "event_name", "event_source")))
            .alias("incident_events"))
        bundle = bundle.join(listed, "incident_id", "left")
    return bundle


def assemble_inputs(bundle: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triage inputs from stored records, and the incidents that lack a required part."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    cases = bundle.withColumns({
        "title": F.coalesce(text("title"), text("evidence_package.title"), F.concat(F.lit("Incident "), "incident_id")),
        "summary": F.coalesce(text("summary"), text("evidence_package.summary"), F.lit("Stored incident context")),
        "missing_part": F.when(~F.col("has_detector_result"), "Detector result not found")
        .when(~F.col("has_coverage_assessment"), "Coverage assessment not found"),
    })
    return cases.where(F.col("missing_part").isNull()), cases.where(F.col("missing_part").isNotNull())


# --- operator decisions -----------------------------------------------------------------
def _action(action_id: Column, label: Column) -> Column:
    return F.struct(action_id.alias("action_id"), label.alias("label"))


def apply_decisions(requests: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Decision rows for operator requests.

    ``requests``: incident_id, decision_type, action_id, rationale,
    used_double_check, actor, created_at.  An alternative that is not offered
    gives a row with ``rejected`` set and no chosen action.
    """
    offered = reviewed.select("incident_id", "recommended_action", "alternative_actions", "review_candidates",
                              "completeness_level", "completeness_warning", "completeness_reasons", "decision_risk_note")
    joined = requests.join(offered, "incident_id")
    pick = lambda wanted: F.try_element_at(
        F.filter("alternative_actions", lambda a: a["action_id"] == wanted), F.lit(1))
    kind = F.col("decision_type")
    alternative, expert = pick(F.col("action_id")), pick(F.lit("escalate_to_expert"))
    fixed = lambda action: _action(F.lit(action), F.lit(ACTIONS[action]["label"]))
    chosen = (
        F.when(kind == "approve_recommendation", _action(F.col("recommended_action.action_id"), F.col("recommended_action.label")))
        .when((kind == "choose_alternative") & alternative.isNotNull(), _action(alternative["action_id"], alternative["label"]))
        .when((kind == "escalate") & expert.isNotNull(), _action(expert["action_id"], expert["label"]))
        .when(kind == "escalate", fixed("escalate_to_expert"))
        .when(kind == "request_more_analysis", fixed("collect_more_evidence"))
    )
    origin = (
        F.when(kind == "approve_recommendation", "recommended").when(kind == "choose_alternative", "alternative")
        .when(kind == "escalate", "manual").when(kind == "request_more_analysis", "double_check")
    )
    return joined.select(
        "incident_id", "decision_type", origin.alias("selected_from"), chosen["action_id"].alias("chosen_action_id"),
        chosen["label"].alias("chosen_action_label"), "rationale", "used_double_check", "actor", "created_at",
        chosen.isNull().alias("rejected"), "review_candidates", "decision_risk_note",
        F.struct("recommended_action", "alternative_actions", "completeness_level", "completeness_warning",
                 "completeness_reasons", "decision_risk_note").alias("decision_snapshot"))


def decision_events(decisions: DataFrame) -> DataFrame:
    """Review events that go with decisions: a double check asked for, a report generated."""
    kind = F.col("decision_type")
    event = F.when(kind == "request_more_analysis", "double_check_requested").when(
        kind == "approve_recommendation", "approval_report_generated")
    return decisions.where(~F.col("rejected")).select(
        "incident_id", event.alias("event_type"), "actor", "created_at",
        F.when(kind == "request_more_analysis", F.col("decision_risk_note")).alias("decision_risk_note"),
    ).where(F.col("event_type").isNotNull())


def operator_history(decisions: DataFrame, events: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """Latest decision, last ``n`` decisions and last ``n`` review events per incident."""
    def listed(rows: DataFrame, name: str) -> DataFrame:
        recent = latest_n(rows, ["incident_id"], order, n)
        fields = ["recency", *[c for c in rows.columns if c != "incident_id"]]
        return recent.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    both = listed(decisions, "recent_decisions").join(listed(events, "review_events"), "incident_id", "full")
    return both.withColumn("latest_decision", F.try_element_at("recent_decisions", F.lit(1)))


# --- alerts -----------------------------------------------------------------------------
def parse_recipients(text: str) -> list[str]:
    return [part.strip() for part in text.replace(";", ",").split(",") if part.strip()]


def alert_candidates(triaged: DataFrame, recipients: Sequence[str], product: str = "Incident desk") -> DataFrame:
    """One notification per high-severity incident and recipient (a literal list, not a join)."""
    high = triaged.where(F.lower(F.coalesce("severity_hint", F.lit(""))) == "high")
    action = F.coalesce("recommended_action.label", "recommended_action.action_id", F.lit(f"Review in {product}"))
    reason = F.coalesce("recommended_action.reason", F.lit("A response is ready for operator review."))
    body = F.concat_ws(
        "\n", F.lit(f"{product} detected a high-priority incident."), F.lit(""),
        F.concat(F.lit("Incident: "), "incident_id"),
        F.concat(F.lit("Title: "), F.coalesce("title", F.concat(F.lit("Incident "), "incident_id"))),
        F.concat(F.lit("Priority: "), python_capitalize(F.col("severity_hint"))),
        F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit("No summary available."))),
        F.concat(F.lit("Recommended action: "), action),
        F.concat(F.lit(f"Why {product} is recommending it: "), reason), F.lit(""),
        F.lit(f"Open {product} to review and approve the next step."))
    return high.select(
        "incident_id", F.explode(F.array(*[F.lit(r) for r in recipients])).alias("recipient"),
        F.lit("email").alias("channel"), F.lit("high_priority_incident").alias("alert_type"),
        F.concat(F.lit(f"[{product}] High-priority incident detected: "), "incident_id").alias("subject"),
        body.alias("body"), F.col("recommended_action.action_id").alias("recommended_action_id"),
    ).withColumn("dedupe_key", F.concat_ws(":", "incident_id", F.lit("high_priority_email"), "recipient"))


def pending_alerts(candidates: DataFrame, sent: DataFrame, status: str = "pending") -> DataFrame:
    """Alerts not yet known by their key; whoever sends them passes or sets another status."""
    return insert_if_absent(sent, candidates, "dedupe_key").withColumn("status", F.lit(status))


def notification_events(alerts: DataFrame) -> DataFrame:
    return alerts.select("incident_id", F.lit("notification_email_sent").alias("event_type"), "recipient", "subject", "alert_type")


def alert_scan_counts(scanned: DataFrame) -> DataFrame:
    failed = F.size("result_errors") > 0
    return scanned.agg(F.count("*").alias("candidates"), F.count_if(~failed).alias("processed"),
                       F.count_if(failed).alias("failed"))


# --- approval reports --------------------------------------------------------------------
def _or_default(items: Column, default: Column) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(F.array(default))


def explain_signal(label: Column) -> Column:
    known = phrase(label, SIGNAL_EXPLANATIONS)
    return F.coalesce(known, python_capitalize(F.replace(label, F.lit("_"), F.lit(" "))))


def blind_spot(row: Column) -> Column:
    words = phrase(F.lower(row["status"]), COVERAGE_STATUS_EXPLANATIONS)
    name = python_capitalize(F.replace(row["category"], F.lit("_"), F.lit(" ")))
    return F.concat(name, F.lit(": "), F.coalesce(words, F.lit("Some evidence is still incomplete.")))


def approval_reports(
    decisions: DataFrame, triaged: DataFrame, generated_at: Column, product: str = "Incident desk"
) -> DataFrame:
    """Report fields for every approved recommendation."""
    approved = decisions.where((F.col("decision_type") == "approve_recommendation") & ~F.col("rejected")).select(
        "incident_id", "chosen_action_id", "chosen_action_label", "rationale", "actor", "used_double_check")
    reviewed = coverage_review(triaged)
    stripped = lambda c: F.nullif(F.trim(c), F.lit(""))
    open_rows = F.filter("coverage_status_by_category",
                         lambda r: r["status"].isin("not_checked", "data_unavailable", "unknown"))
    return approved.join(reviewed, "incident_id").select(
        "incident_id", F.coalesce(stripped("title"), F.concat(F.lit("Incident "), "incident_id")).alias("title"),
        python_capitalize(F.coalesce(stripped("risk_band"), F.lit("unknown"))).alias("severity"),
        F.coalesce(stripped("summary"), F.lit("Incident summary unavailable.")).alias("summary"),
        F.coalesce(stripped("chosen_action_id"), F.lit("action")).alias("approved_action_id"),
        F.coalesce(stripped("chosen_action_label"), F.lit("Approved action")).alias("approved_action_label"),
        F.coalesce(stripped("recommended_action.reason"), F.lit("No action rationale available.")).alias("approved_action_reason"),
        F.coalesce(stripped("rationale"), F.lit(
            "The operator approved this action without adding extra written rationale.")).alias("operator_rationale"),
        _or_default(F.transform("top_signals", lambda s: explain_signal(s["label"])),
                    F.lit(f"{product} observed risk signals that justified review.")).alias("why_concerned"),
        _or_default(F.transform(open_rows, blind_spot), F.col("decision_risk_note")).alias("blind_spots"),
        "what_could_change_the_decision", "used_double_check",
        F.coalesce(stripped("actor"), F.lit("Operator")).alias("approved_by"),
        F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
    )


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def report_html(product: str = "Incident desk") -> Column:
    """Printable page; every value is escaped."""
    def bullets(items: str) -> Column:
        kept = F.filter(items, lambda i: F.trim(i) != "")
        entries = F.transform(kept, lambda i: F.concat(F.lit("<li>"), escape_html(i), F.lit("</li>")))
        return F.when(F.size(kept) > 0, F.concat(F.lit("<ul>"), F.array_join(entries, ""), F.lit("</ul>"))).otherwise(
            F.lit("<p>None recorded.</p>"))

    def section(heading: str, *parts: Column) -> Column:
        return F.concat(F.lit(f"<section><h2>{heading}</h2>"), *parts, F.lit("</section>"))

    paragraph = lambda c: F.concat(F.lit("<p>"), escape_html(F.col(c)), F.lit("</p>"))
    return F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Approval report '),
        escape_html(F.col("incident_id")), F.lit("</title></head><body><h1>"), escape_html(F.col("title")),
        F.lit("</h1><p>Issue #"), escape_html(F.col("incident_id")), F.lit(" · Severity: "), escape_html(F.col("severity")),
        F.lit(" · Generated "), F.col("generated_at"), F.lit("</p>"),
        section("What happened", paragraph("summary")),
        section("Approved action", paragraph("approved_action_label"), paragraph("approved_action_reason")),
        section("Why the operator took this action", paragraph("operator_rationale")),
        section(f"Why {product} was concerned", bullets("why_concerned")),
        section("Known blind spots", bullets("blind_spots")),
        section("What could still change the decision", bullets("what_could_change_the_decision")),
        F.lit("</body></html>"),
    )


def report_lines(product: str = "Incident desk") -> Column:
    """The report as an array of plain text lines."""
    dashed = lambda items: F.transform(F.filter(items, lambda i: F.trim(i) != ""), lambda i: F.concat(F.lit("- "), i))
    changes = dashed("what_could_change_the_decision")
    lit = lambda *texts: F.array(*[F.lit(t) for t in texts])
    return F.concat(
        lit(f"{product} Approval Report", ""),
        F.array(F.concat(F.lit("Issue #"), "incident_id"), F.concat(F.lit("Severity: "), "severity"),
                F.concat(F.lit("Generated: "), "generated_at"), F.lit("")),
        F.array(F.lit("What happened"), F.col("summary"), F.lit("")),
        F.array(F.lit("Approved action"), F.col("approved_action_label"), F.col("approved_action_reason"), F.lit("")),
        F.array(F.lit("Why the action was taken"), F.col("operator_rationale"), F.lit("")),
        lit(f"Why {product} was concerned"), dashed("why_concerned"), lit("", "Known blind spots"), dashed("blind_spots"),
        F.when(F.size(changes) > 0, F.concat(lit("", "What could still change the decision"), changes)).otherwise(
            F.array().cast("array<string>")),
    )
