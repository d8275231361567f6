"""Writers: partitioned Parquet, CSV exports, JSON reports and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.quality import derivation_notes


def write_partitioned(df: DataFrame, path: str, partition: str, mode: str = "overwrite") -> None:
    """Partitioned Parquet with right-sized files.

    The rebalance hint lets adaptive execution split a hot date over several
    tasks and merge quiet ones.
    """
    df.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_partitioned(events, path, "event_date", mode)


def write_incidents(incidents: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_partitioned(incidents, path, "incident_start_date", mode)


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: arrays and structs become JSON text."""
    nested = {f.name: F.to_json(F.col(f.name)) for f in df.schema.fields
              if f.dataType.typeName() in ("array", "struct", "map")}
    return df.withColumns(nested) if nested else df


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None, limit: int | None = None) -> None:
    """Full CSV, or the first ``limit`` rows of ``order``."""
    df = _flat(df)
    if order is not None:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    df.write.mode("overwrite").csv(path, header=True)


def write_json_report(report: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite").text(path)


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """Name and description of every derived feature."""
    # fixed values: descriptions of incident columns
    extra = {
        "incident_id": "Deterministic identifier for an inactivity-bounded actor/IP activity cluster.",
        "ordered_event_name_sequence": "Ordered pipe-delimited event sequence for each incident.",
        "ordered_event_source_sequence": "Ordered pipe-delimited event source sequence for each incident.",
        "raw_event_row_indices": "JSON array pointer back to row indices in events_flat.",
    }
    rows = list({**derivation_notes(), **extra}.items())
    return spark.createDataFrame(rows, "feature string, description string")


def feature_dictionary_lines(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.concat(F.lit("- `"), "feature", F.lit("`: "), "description").alias("value"))


def append_rows(df: DataFrame, path: str) -> None:
    """Insert-only case tables; ``created_at`` is stamped where it is missing."""
    if "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp())
    df.write.mode("append").parquet(path)
