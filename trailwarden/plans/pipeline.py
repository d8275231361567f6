"""The batch pipeline from log files to tables and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import sinks
from ..operators import quality
from ..operators.features import canonical_order, derive_event_features
from ..operators.incidents import SPLIT, build_incidents
from ..operators.labels import apply_weak_labels, label_report
from ..operators.normalize import normalize_records
from ..rules import FLAG_RULES, LABEL_RULES
from ..session import materialize
from ..sources import logs


def run_pipeline(
    spark: SparkSession, log_path: str, output: str, gap_minutes: float = 30, sequence_limit: int = 50, mode: str = SPLIT,
    flag_rules: Mapping[str, Sequence[str]] = FLAG_RULES, label_rules: Mapping[str, Any] = LABEL_RULES,
    csv_sample_limit: int = 100_000, write_full_csv: bool = False, write_csv_sample: bool = True,
) -> DataFrame:
    """Ingest, normalize, featurize, build and label incidents; returns the violated output rules.

    Each table is written once and read back by the next step.
    """
    root = output.rstrip("/")
    split = materialize(logs.split_records(logs.read_log_files(spark, log_path)), "log-entries")
    metrics = logs.ingest_metrics(split)
    logs.ingest_errors(split).write.mode("overwrite").parquet(f"{root}/ingest_errors")

    sinks.write_events(derive_event_features(normalize_records(logs.records(split)), flag_rules), f"{root}/events_flat")
    events = spark.read.parquet(f"{root}/events_flat")
    sinks.write_incidents(build_incidents(events, gap_minutes, sequence_limit, mode), f"{root}/incidents")
    incidents = spark.read.parquet(f"{root}/incidents")
    labeled = apply_weak_labels(incidents, label_rules)
    sinks.write_incidents(labeled, f"{root}/incidents_labeled")

    if write_csv_sample:
        sinks.write_csv(events, f"{root}/events_flat_sample_csv", canonical_order(), csv_sample_limit)
    if write_full_csv:
        sinks.write_csv(events, f"{root}/events_flat_csv", canonical_order())
    sinks.write_json_report(quality.quality_report(events, incidents, metrics), f"{root}/data_quality_report")
    sinks.write_json_report(label_report(spark.read.parquet(f"{root}/incidents_labeled"), label_rules), f"{root}/label_report")
    quality.describe_schema(events, "events_flat").unionByName(
        quality.describe_schema(incidents, "incidents")).write.mode("overwrite").json(f"{root}/schema")
    sinks.feature_dictionary_lines(sinks.feature_dictionary(spark)).write.mode("overwrite").text(f"{root}/feature_dictionary")
    return quality.validate_outputs(events, incidents, metrics)
