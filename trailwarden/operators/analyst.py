"""Analyst queries over the event and incident tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import attach_row


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def actors_by_event_count(events: DataFrame, limit: int | None = None) -> DataFrame:
    counts = events.groupBy("actor_key").agg(F.count("*").alias("event_count"))
    return _first(counts.orderBy(F.desc("event_count"), "actor_key"), limit)


def ips_by_failed_calls(events: DataFrame, limit: int | None = None) -> DataFrame:
    counts = events.where(F.col("is_error")).groupBy("source_ip_address").agg(F.count("*").alias("failed_calls"))
    return _first(counts.orderBy(F.desc("failed_calls"), F.asc_nulls_last("source_ip_address")), limit)


def event_names_over_time(events: DataFrame, unit: str = "day") -> DataFrame:
    return events.groupBy(F.date_trunc(unit, "event_time").alias("period"), "event_name").agg(
        F.count("*").alias("event_count")
    )


def incidents_with_privilege_actions(incidents: DataFrame) -> DataFrame:
    return incidents.where("contains_privilege_change_api")


def incidents_with_repeated_attempts(assigned: DataFrame, at_least: int = 5, incident: str = "incident_id") -> DataFrame:
    """Incidents that hold one event name at least ``at_least`` times."""
    counts = assigned.where(F.col("event_name").isNotNull()).groupBy(incident, "event_name").agg(
        F.count("*").alias("attempts"))
    return counts.where(F.col("attempts") >= at_least)


def actors_from_recon_to_creation(events: DataFrame) -> DataFrame:
    """Actors whose first reconnaissance comes before a creation or permission change.

    One pass: the earliest and latest times per actor decide it, no self join.
    """
    acting = F.col("is_resource_creation_api") | F.col("is_privilege_change_api") | F.col("is_iam_related")
    spans = events.groupBy("actor_key").agg(
        F.min(F.when(F.col("is_recon_like_api"), F.col("event_time"))).alias("first_recon"),
        F.max(F.when(acting, F.col("event_time"))).alias("last_creation"),
    )
    return spans.where(F.col("first_recon") < F.col("last_creation"))


def sanity_slice(events: DataFrame, incidents: DataFrame, order: list, columns: list[str], n: int = 5) -> DataFrame:
    """First rows of the event table with the row counts of both tables beside them."""
    head = events.orderBy(*order).limit(n).select(*columns)
    counts = events.agg(F.count("*").alias("event_rows"))
    return attach_row(attach_row(head, counts), incidents.agg(F.count("*").alias("incident_rows")))
