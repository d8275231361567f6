"""The batch pipeline as Parquet-backed stages shared by later queries.

Each stage is written once per application and state of the input folder (the names,
sizes and times of its files), so changed data are read again: events feed the
incident build, labeled incidents feed triage, stored triage results feed
reviews, decisions, alerts and views.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import derive_event_features
from ..operators.incidents import INDEPENDENT, ISLAND, assign_incidents, build_incidents, incident_id
from ..operators.labels import apply_weak_labels
from ..session import materialize
from ..sources.tables import audit_events

_written: dict[tuple[str, str, str, str], Any] = {}

CASE_GAP_MINUTES = 12 * 60


def folder_state(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files of a folder, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def remember(spark: SparkSession, folder: str, name: str, build: Callable[[], Any]) -> Any:
    key = (spark.sparkContext.applicationId, folder, folder_state(spark, folder), name)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def stage(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], small: bool = False) -> DataFrame:
    return remember(spark, folder, name, lambda: materialize(build(), name, small))


def forget_stages() -> None:
    _written.clear()


def events_flat(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "events-flat", lambda: derive_event_features(audit_events(spark, folder)), small=True)


def incidents(
    spark: SparkSession, folder: str, gap_minutes: int = CASE_GAP_MINUTES, mode: str = INDEPENDENT
) -> DataFrame:
    name = f"incidents-{mode}-{gap_minutes}"
    return stage(spark, folder, name, lambda: build_incidents(events_flat(spark, folder), gap_minutes, mode=mode), small=True)


def labeled(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "incidents-labeled", lambda: apply_weak_labels(incidents(spark, folder)))


def incident_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the id of its incident and its place in it."""
    def build() -> DataFrame:
        assigned = assign_incidents(events_flat(spark, folder), CASE_GAP_MINUTES, INDEPENDENT)
        return assigned.withColumn("incident_id", incident_id(F.col(ISLAND)))
    return stage(spark, folder, "incident-members", build, small=True)
