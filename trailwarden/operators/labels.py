"""Rule-based weak labels for incidents."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import LABEL_RULES, RULE_COLUMNS, SEQUENCE_SERVICES


def with_label_features(incidents: DataFrame, rules: Mapping[str, Any] = LABEL_RULES) -> DataFrame:
    limits = rules["thresholds"]
    actor = F.coalesce(F.col("actor_key"), F.lit(""))
    sources = F.coalesce(F.col("ordered_event_source_sequence"), F.lit(""))
    errors, events = F.col("error_event_count"), F.col("event_count")
    duration = F.col("incident_duration_seconds")
    failing = errors >= int(limits["min_failure_events"])
    recon, privilege = F.col("contains_recon_like_api"), F.col("contains_privilege_change_api")
    creation = F.col("contains_resource_creation_api")
    ratio = F.coalesce(F.try_divide(errors.cast("double"), events.cast("double")), F.lit(0.0))
    is_root = actor.contains(":root")
    return incidents.withColumns({
        "actor_is_root": is_root,
        "actor_is_assumed_role": actor.contains(":assumed-role/"),
        "failure_ratio": ratio,
        "events_per_minute": F.coalesce(events / (F.greatest(duration, F.lit(1.0)) / 60.0), F.lit(0.0)),
        "has_high_failure_ratio": (ratio >= float(limits["high_failure_ratio"])) & failing,
        "has_failure_burst": failing & (F.col("success_event_count") == 0),
        "has_event_burst": (events >= int(limits["high_event_count"]))
        & (duration <= float(limits["short_incident_seconds"])),
        "has_broad_surface_area": F.col("distinct_event_names") >= int(limits["high_distinct_event_names"]),
        "has_recon_plus_privilege": recon & privilege,
        "has_recon_plus_resource_creation": recon & creation,
        "has_privilege_plus_resource_creation": privilege & creation,
        "has_root_plus_privilege": is_root & privilege,
        **{flag: sources.contains(service) for flag, service in SEQUENCE_SERVICES.items()},
    })


def _weights(rules: Mapping[str, Any]) -> dict[str, float]:
    return {rule: float(rules["weights"].get(rule, 0)) for rule in RULE_COLUMNS}


def fired_reasons(rules: Mapping[str, Any] = LABEL_RULES) -> Column:
    """Array of (rule, weight) for the rules that fired, in rule order."""
    entries = [
        F.when(F.col(column), F.struct(F.lit(rule).alias("rule"), F.lit(weight).alias("weight")))
        for (rule, column), weight in zip(RULE_COLUMNS.items(), _weights(rules).values())
    ]
    return F.filter(F.array(*entries), lambda entry: entry.isNotNull())


def apply_weak_labels(incidents: DataFrame, rules: Mapping[str, Any] = LABEL_RULES) -> DataFrame:
    """Score, label and reasons; row-wise only, so it stays in the scan's stage."""
    score = sum(
        (F.col(column).cast("double") * weight for column, weight in zip(RULE_COLUMNS.values(), _weights(rules).values())),
        F.lit(0.0),
    )
    labeled = with_label_features(incidents, rules).withColumn("weak_label_score", score)
    return labeled.withColumns({
        "weak_label_suspicious": (F.col("weak_label_score") >= float(rules["label_threshold"])).cast("int"),
        "weak_label_reasons": fired_reasons(rules),
        "weak_label_reasons_json": F.to_json(fired_reasons(rules)),
    })


def label_report(labeled: DataFrame, rules: Mapping[str, Any] = LABEL_RULES) -> DataFrame:
    """One row: counts, rate, hits per rule and the score distribution."""
    score, label = F.col("weak_label_score"), F.col("weak_label_suspicious")
    return labeled.agg(
        F.count("*").alias("incident_count"),
        F.coalesce(F.sum(label), F.lit(0)).alias("positive_count"),
        F.coalesce(F.round(F.avg(label), 6), F.lit(0.0)).alias("positive_rate"),
        F.lit(float(rules["label_threshold"])).alias("label_threshold"),
        *[F.count_if(column).alias(f"hits_{rule}") for rule, column in RULE_COLUMNS.items()],
        F.round(F.min(score), 6).alias("score_min"),
        # exact: the buffer holds distinct scores with counts, and scores are sums of 17 weights
        F.round(F.median(score), 6).alias("score_median"),
        F.round(F.max(score), 6).alias("score_max"),
    )


def score_prior(labeled: DataFrame) -> DataFrame:
    """Mean label per score, scores rounded half to even."""
    bucket = F.bround("weak_label_score", 0).cast("long")
    return labeled.groupBy(bucket.alias("score_bucket")).agg(
        F.round(F.avg("weak_label_suspicious"), 6).alias("positive_rate")
    )
