"""Inactivity-bounded incidents.

Two readings of "the same run of activity" are offered:

* ``split``: events are read in one global time order and any change of
  (actor, IP) from one event to the next closes the incident, so interleaved
  actors split each other;
* ``independent``: each (actor, IP) is read on its own, so only its own gap
  closes an incident.  Streams can only follow this reading.

Both are one range sort plus a running count; they differ in the sort order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import seconds_between
from ..session import materialize
from . import ordering as o

SPLIT, INDEPENDENT = "split", "independent"
ISLAND = "_island"

EVENT_COLUMNS = [
    "event_time", "actor_key", "source_ip_address", "global_sort_key", "event_id", "event_name",
    "event_source", "aws_region", "is_error", "success", "is_console_login", "is_recon_like_api",
    "is_privilege_change_api", "is_resource_creation_api", "resource_types_concat", "user_agent",
    "raw_event_row_index",
]
SEQUENCES = {
    "event_name": "ordered_event_names",
    "event_source": "ordered_event_sources",
    "event_id": "ordered_event_ids",
    "raw_event_row_index": "ordered_row_indices",
}
CONTAINS = {
    "contains_console_login": "is_console_login",
    "contains_recon_like_api": "is_recon_like_api",
    "contains_privilege_change_api": "is_privilege_change_api",
    "contains_resource_creation_api": "is_resource_creation_api",
}
INCIDENT_COLUMNS = [
    "incident_id", "actor_key", "primary_source_ip_address", "incident_start_time", "incident_end_time",
    "incident_duration_seconds", "event_count", "distinct_event_names", "distinct_event_sources",
    "distinct_regions", "error_event_count", "success_event_count", "first_event_name", "last_event_name",
    "top_event_name", *CONTAINS, "resource_types_seen", "user_agents_seen", "ordered_event_name_sequence",
    "ordered_event_source_sequence", "event_ids_in_order", "raw_event_row_indices", "incident_start_date",
]


def _order(mode: str) -> list[Column]:
    time = F.col("event_time").asc_nulls_last()
    who = [F.col("actor_key").asc_nulls_last(), F.col("source_ip_address").asc_nulls_last()]
    ties = [F.col("global_sort_key").asc_nulls_last(), F.col("raw_event_row_index").asc_nulls_last()]
    if mode == SPLIT:
        return [time, *who, *ties]
    if mode == INDEPENDENT:
        return [*who, time, *ties]
    raise ValueError(f"unknown incident mode: {mode}")


def assign_incidents(events: DataFrame, gap_minutes: float = 30, mode: str = SPLIT) -> DataFrame:
    """Give every event its island number and its ordinal among the non-null values per sequence."""
    narrow = events.select(*EVENT_COLUMNS).withColumn(
        "_key", F.concat_ws("|", F.coalesce(F.col("actor_key"), F.lit("UNKNOWN_ACTOR")),
                            F.coalesce(F.col("source_ip_address"), F.lit("NO_IP"))))
    placed = o.positions(narrow, _order(mode), "incident-order", small=True)

    ends = placed.groupBy(o.PART).agg(F.max_by(F.struct("_key", "event_time"), o.ROW).alias("_last"))
    carried = ends.select(o.PART, o.from_previous_part("_last").alias("_carried"))
    previous = F.coalesce(F.lag(F.struct("_key", "event_time")).over(o.in_part()), F.col("_carried"))
    scan = o.with_part_state(placed, carried).withColumn("_prev", previous)
    gap = seconds_between(F.col("_prev.event_time"), F.col("event_time"))
    continues = (F.col("_prev._key") == F.col("_key")) & (gap <= gap_minutes * 60)
    scan = scan.withColumn("_starts", ~F.coalesce(continues, F.lit(False)))

    # running counts of islands and of non-null values, and the counts where the running island began
    running = {"_islands": F.sum(F.col("_starts").cast("long")).over(o.running())}
    running |= {f"_n_{c}": F.count(c).over(o.running()) for c in SEQUENCES}
    scan = scan.withColumns(running)
    begun = {c: F.when(F.col("_starts"), F.col(f"_n_{c}") - F.col(c).isNotNull().cast("long")) for c in SEQUENCES}
    scan = scan.withColumns({f"_base_{c}": F.max(begun[c]).over(o.running()) for c in SEQUENCES})
    scan = materialize(scan.drop("_prev", "_carried", "_key"), "incident-events", small=True)

    tails = [(F.count(c) - F.coalesce(F.max(f"_base_{c}"), F.lit(0))).alias(f"_open_{c}") for c in SEQUENCES]
    parts = scan.groupBy(o.PART).agg(F.count_if("_starts").alias("_opened"), *tails)
    parts = o.open_run_carry(parts, "_opened", [f"_open_{c}" for c in SEQUENCES])
    parts = parts.withColumn("_earlier", o.earlier_sum("_opened")).drop("_opened")
    ordinals = {
        c: F.col(f"_n_{c}") - F.coalesce(F.col(f"_base_{c}"), -F.col(f"_open_{c}")) for c in SEQUENCES
    }
    return o.with_part_state(scan, parts).select(
        (F.col("_earlier") + F.col("_islands")).alias(ISLAND), o.POS, *EVENT_COLUMNS,
        *[ordinal.alias(f"_ord_{c}") for c, ordinal in ordinals.items()],
    )


def incident_id(number: Column) -> Column:
    return F.format_string("incident_%09d", number)


def build_incidents(
    events: DataFrame, gap_minutes: float = 30, sequence_limit: int = 50, mode: str = SPLIT
) -> DataFrame:
    """One row per incident; sequences hold the first ``sequence_limit`` values."""
    assigned = assign_incidents(events, gap_minutes, mode)
    totals = _totals(assigned, sequence_limit)
    variety = _variety(assigned)
    agents = _first_distinct(assigned, "user_agent", sequence_limit).withColumnRenamed("values", "agents")
    joined = totals.join(variety, ISLAND, "left").join(agents, ISLAND, "left")

    def text(column: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, "|"))

    def json_list(items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    duration = seconds_between(F.col("incident_start_time"), F.col("incident_end_time"))
    quoted = F.transform("ordered_event_ids", lambda v: F.to_json(F.array(v)))
    finished = joined.withColumns({
        "incident_id": incident_id(F.col(ISLAND)),
        "incident_duration_seconds": F.coalesce(duration, F.lit(0.0)),
        "incident_start_date": F.date_format("incident_start_time", "yyyy-MM-dd"),
        "distinct_event_names": F.coalesce("distinct_event_names", F.lit(0)),
        "distinct_event_sources": F.coalesce("distinct_event_sources", F.lit(0)),
        "distinct_regions": F.coalesce("distinct_regions", F.lit(0)),
        "resource_types_seen": text("resource_types"),
        "user_agents_seen": text("agents"),
        "ordered_event_name_sequence": text("ordered_event_names"),
        "ordered_event_source_sequence": text("ordered_event_sources"),
        "event_ids_in_order": json_list(F.transform(quoted, lambda v: F.substring(v, 2, F.length(v) - 2))),
        "raw_event_row_indices": json_list(F.col("ordered_row_indices").cast("array<string>")),
    })
    return finished.select(*INCIDENT_COLUMNS, *SEQUENCES.values())


def _totals(assigned: DataFrame, limit: int) -> DataFrame:
    # each list gets at most `limit` entries per incident, cut before it is collected
    lists = [
        F.transform(
            F.array_sort(F.collect_list(F.when(
                F.col(column).isNotNull() & (F.col(f"_ord_{column}") <= limit), F.struct(F.col(o.POS).alias("p"), F.col(column).alias("v"))
            ))), lambda item: item["v"],
        ).alias(name)
        for column, name in SEQUENCES.items()
    ]
    named_at = F.when(F.col("event_name").isNotNull(), F.col(o.POS))
    return assigned.groupBy(ISLAND).agg(
        F.max("actor_key").alias("actor_key"),
        F.max("source_ip_address").alias("primary_source_ip_address"),
        F.min("event_time").alias("incident_start_time"),
        F.max("event_time").alias("incident_end_time"),
        F.count("*").alias("event_count"),
        F.count_if("is_error").alias("error_event_count"),
        F.count_if("success").alias("success_event_count"),
        F.min_by("event_name", named_at).alias("first_event_name"),
        F.max_by("event_name", named_at).alias("last_event_name"),
        *[F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias(name) for name, flag in CONTAINS.items()],
        *lists,
    )


def _variety(assigned: DataFrame) -> DataFrame:
    """Distinct counts, most frequent name and the union of resource types.

    (incident, value) pairs are counted first, so a long incident is reduced on
    the map side and its values are spread over tasks.
    """
    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    values = F.concat(
        tagged("name", F.array("event_name")), tagged("source", F.array("event_source")),
        tagged("region", F.array("aws_region")),
        tagged("resource", F.coalesce(F.split("resource_types_concat", r"\|"), F.array().cast("array<string>"))),
    )
    pairs = (
        assigned.select(ISLAND, F.inline(values))
        .where(F.col("value").isNotNull() & ~((F.col("kind") == "resource") & (F.col("value") == "")))
        .groupBy(ISLAND, "kind", "value").agg(F.count("*").alias("n"))
    )
    is_name = F.col("kind") == "name"
    return pairs.groupBy(ISLAND).agg(
        F.count_if(is_name).alias("distinct_event_names"),
        F.count_if(F.col("kind") == "source").alias("distinct_event_sources"),
        F.count_if(F.col("kind") == "region").alias("distinct_regions"),
        F.min_by("value", F.when(is_name, F.struct(-F.col("n"), "value"))).alias("top_event_name"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "resource", F.col("value")))).alias("resource_types"),
    )


def _first_distinct(assigned: DataFrame, column: str, limit: int) -> DataFrame:
    """Smallest ``limit`` distinct values per incident; the rank filter is applied map-side first."""
    distinct = assigned.where(F.col(column).isNotNull()).select(ISLAND, column).distinct()
    ranked = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(ISLAND).orderBy(column)))
    return ranked.where(F.col("_rank") <= limit).groupBy(ISLAND).agg(
        F.array_sort(F.collect_list(column)).alias("values")
    )


def incident_order() -> list[Column]:
    """Listing order of the incident table, applied when it is exported."""
    return [F.col(c).asc_nulls_last()
            for c in ("incident_start_time", "actor_key", "primary_source_ip_address", "incident_id")]
