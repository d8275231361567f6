"""Queue, timeline and wording columns for an operator's view of incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import phrase, sentence_start
from ..rules import CONCERN_STATEMENTS, DISPLAY_LABELS, TIMELINE_PHRASES


def title_words(value: Column) -> Column:
    """``not_checked`` -> ``Not Checked``; inner capitals stay."""
    return F.array_join(F.transform(F.split(value, "[_-]"), sentence_start), " ")


def display_label(value: Column, fallback: str = "Unavailable") -> Column:
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    return F.when(blank, fallback).otherwise(F.coalesce(phrase(value, DISPLAY_LABELS), title_words(value)))


def severity_tone(value: Column) -> Column:
    word = F.lower(value)
    return (F.when(word.contains("high"), "critical").when(word.contains("medium"), "warning")
            .when(word.contains("low"), "safe").otherwise("neutral"))


def coverage_tone(value: Column) -> Column:
    word = F.lower(value)
    return (F.when(word.contains("signal_found"), "critical")
            .when(word.contains("not_checked") | word.contains("unavailable"), "warning")
            .when(word.contains("no_signal"), "safe").otherwise("neutral"))


def coverage_note(row: Column) -> Column:
    sources = F.filter(row["missing_sources"], lambda s: F.coalesce(s, F.lit("")) != "")
    first = F.try_element_at(row["checks"], F.lit(1))["detail"]
    available = F.concat(F.size(row["checks"]).cast("string"), F.lit(" checks available"))
    return (
        F.when(F.size(sources) > 0, F.concat(F.lit("Missing: "), F.array_join(sources, ", ")))
        .when(F.size(row["checks"]) > 0, F.coalesce(F.nullif(F.trim(first), F.lit("")), available))
        .otherwise("No additional detail available.")
    )


def coverage_view(reviewed: DataFrame) -> DataFrame:
    rows = reviewed.select("incident_id", F.explode("coverage_status_by_category").alias("row"))
    return rows.select(
        "incident_id", display_label(F.col("row.category"), "Coverage").alias("category"),
        display_label(F.col("row.status"), "Unknown").alias("status"), F.col("row.status").alias("raw_status"),
        coverage_tone(F.col("row.status")).alias("tone"), coverage_note(F.col("row")).alias("note"))


def _moment(column: Column) -> Column:
    return F.date_format(column, "MMM d, h:mm a 'UTC'")


def incident_window() -> Column:
    start, end = _moment(F.col("incident_start_time")), _moment(F.col("incident_end_time"))
    return F.coalesce(F.concat(start, F.lit(" - "), end), start, end)


def queue_view(cases: DataFrame, labels_by_title: Mapping[str, str] | None = None) -> DataFrame:
    known = phrase(F.col("title"), labels_by_title) if labels_by_title else F.lit(None).cast("string")
    return cases.select(
        F.col("incident_id").alias("id"), F.coalesce(known, F.col("incident_id")).alias("label"),
        F.coalesce("primary_source_ip_address", "title", F.lit("Unknown site")).alias("site"),
        title_words(F.coalesce("severity_hint", F.lit("unknown"))).alias("severity"),
        incident_window().alias("incident_window"), F.lit("Needs review").alias("state"),
        severity_tone(F.coalesce("severity_hint", F.lit(""))).alias("tone"))


def confidence_percent(model_confidence: Column, risk_score: Column) -> Column:
    """Rounded percentage, capped by completeness, never under 55."""
    level = F.lower(F.coalesce(F.col("completeness_level"), F.lit("medium")))
    cap = F.when(level.contains("high"), 92).when(level.contains("medium"), 78).when(level.contains("low"), 68).otherwise(85)
    cap = F.when(F.col("recommendation_may_be_incomplete"), F.least(cap, F.lit(78))).otherwise(cap)
    percent = F.floor(F.coalesce(model_confidence, risk_score, F.lit(0.72)) * 100 + 0.5)
    return F.greatest(F.lit(55), F.least(percent, cap)).cast("long")


def timeline_text(name: Column) -> Column:
    """Plain wording of an event name, else its camel case split into words."""
    split = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    words = F.trim(F.regexp_replace(split, "[_-]+", " "))
    return F.coalesce(phrase(F.lower(F.trim(name)), TIMELINE_PHRASES), sentence_start(words))


def timeline(limit: int = 6) -> Column:
    return F.transform(F.slice("event_sequence", 1, limit), timeline_text)


def actor_short_name(actor: Column) -> Column:
    """Last ARN part of an actor key."""
    trimmed = F.trim(actor)
    tail = F.regexp_extract(trimmed, "[:/]([^:/]+)$", 1)
    return F.when(trimmed == "", "this incident").when(tail != "", tail).otherwise(trimmed)


def _any_of(array: Column, values: Sequence[str]) -> Column:
    return F.arrays_overlap(array, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)


def human_list(items: Column) -> Column:
    size = F.size(items)
    return (
        F.when(size == 0, "").when(size == 1, F.get(items, 0))
        .when(size == 2, F.concat(F.get(items, 0), F.lit(" and "), F.get(items, 1)))
        .otherwise(F.concat(F.array_join(F.slice(items, 1, size - 1), ", "), F.lit(", and "), F.try_element_at(items, F.lit(-1))))
    )


def concern_summary() -> Column:
    """Up to three plain statements drawn from the signals and events of an incident."""
    lowered = lambda c: F.transform(c, lambda v: F.lower(F.trim(v)))
    signals, events = lowered("detector_labels"), lowered("event_sequence")
    fired = F.filter(F.array(*[
        F.when(_any_of(signals, on_signals) | _any_of(events, on_events), text)
        for text, on_signals, on_events in CONCERN_STATEMENTS
    ]), lambda s: s.isNotNull())
    first = sentence_start(F.get(fired, 0))
    named = F.transform(F.slice("detector_labels", 1, 3), lambda s: F.lower(display_label(s)))
    return (
        F.when(F.size(fired) >= 3, F.concat(
            first, F.lit(", "), F.get(fired, 1), F.lit(", and "), F.get(fired, 2),
            F.lit(". This sequence is concerning because it looks like hands-on activity after access was gained.")))
        .when(F.size(fired) == 2, F.concat(
            first, F.lit(", and "), F.get(fired, 1),
            F.lit(". Together, that pattern is more concerning than any one event on its own.")))
        .when(F.size(fired) == 1, F.concat(
            first, F.lit(". The system flagged it because this kind of activity often appears in suspicious "
                         "hands-on sessions.")))
        .when(F.size(named) > 0, F.concat(
            F.lit("The system is concerned because it saw signs of "), human_list(named),
            F.lit(" in the same incident. That combination can indicate suspicious account activity.")))
        .otherwise("The system is concerned because several actions in this incident, taken together, look less "
                   "like routine work and more like suspicious hands-on activity.")
    )


def audit_feed(decisions: DataFrame, events: DataFrame, order: Sequence[str], limit: int = 8) -> DataFrame:
    """Per incident: decisions newest first, then review events; the first ``limit`` entries."""
    rationale = F.when(F.trim(F.coalesce("rationale", F.lit(""))) != "", F.concat(F.lit(". Rationale: "), "rationale"))
    chosen = F.coalesce("chosen_action_label", "chosen_action_id", F.lit("Decision recorded"))
    detail = F.concat(chosen, F.when(F.col("used_double_check"), " after double check").otherwise(""),
                      F.coalesce(rationale, F.lit("")))
    keep = ["incident_id", "created_at", *[c for c in order if c != "created_at"]]
    entries = decisions.select(*keep, F.lit(0).alias("part"), title_words(F.col("decision_type")).alias("title"), detail.alias("detail"))
    entries = entries.unionByName(events.select(
        *keep, F.lit(1).alias("part"), title_words(F.col("event_type")).alias("title"),
        F.coalesce("decision_risk_note", F.lit("Additional review context recorded.")).alias("detail")))
    by_place = Window.partitionBy("incident_id").orderBy("part", *[F.desc(c) for c in order])
    return entries.withColumn("position", F.row_number().over(by_place)).where(F.col("position") <= limit).select(
        "incident_id", "position", "created_at", "title", "detail")


def status_line() -> Column:
    """One grounded sentence set from the latest context of an incident."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("incident_id"))
    action = F.coalesce("recommended_action.label", "recommended_action.action_id", F.lit("review the incident"))
    level = F.col("completeness_level")
    missing = F.coalesce(F.col("missing_sources"), F.array().cast("array<string>"))
    return F.concat_ws(
        " ", F.concat(F.lit("For "), title, F.lit(", the current recommended action is "), action, F.lit(".")),
        F.concat(F.lit("The detector currently rates the incident as "), F.col("risk_band"), F.lit(" risk.")),
        F.concat(F.lit("Coverage completeness is "), level, F.lit(".")),
        F.when(F.size(missing) > 0, F.concat(
            F.lit("Missing sources still affecting the decision: "), F.array_join(missing, ", "), F.lit(".")))
        .when(level.isin("high", "complete"), "No major missing sources are currently recorded."))
