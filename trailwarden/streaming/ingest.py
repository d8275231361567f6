"""Streams of audit events: new log files, duplicates, incidents and activity counts.

Streams follow the per-actor reading of incidents; the global interleaved
reading needs the whole order and stays a batch job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import with_row_features
from ..operators.normalize import normalize_records
from ..rules import FLAG_RULES
from ..session import use_utc
from ..sources import logs

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def stream_log_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New log files and archive members, as the batch reader gives them."""
    use_utc(spark)
    files = (
        spark.readStream.format("binaryFile").schema(_BINARY)
        .option("recursiveFileLookup", "true").option("pathGlobFilter", logs.SUFFIX_GLOB)
        .option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    return files.select("path", "content").mapInPandas(logs._texts, logs.TEXT_SCHEMA)


def stream_events(
    spark: SparkSession, folder: str, rules: Mapping[str, Sequence[str]] = FLAG_RULES, files_per_trigger: int = 1000
) -> DataFrame:
    """Normalized events with row features; ranks and exact counts stay batch."""
    split = logs.split_records(stream_log_files(spark, folder, files_per_trigger))
    return with_row_features(normalize_records(logs.records(split)), rules)


def drop_duplicate_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Keep the first of equal event ids seen within the watermark.

    Events without an id are told apart by file and place, so none is lost.
    """
    identity = F.coalesce(F.col("event_id"), F.concat_ws("#", "source_file_name", F.col("record_index_in_file").cast("string")))
    marked = events.withColumn("_identity", identity)
    if marked.isStreaming:
        marked = marked.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["_identity"])
    else:
        order = [x for c in ("event_time", "source_file_name", "record_index_in_file") if c in events.columns
                 for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]  # nulls last, as in canonical order
        rows = marked.groupBy("_identity").agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("_first"))
        return rows.select("_first.*")
    return marked.drop("_identity")


def inactivity_incidents(events: DataFrame, gap_minutes: int = 30, watermark: str = "1 hour") -> DataFrame:
    """Incidents per (actor, IP), closed by inactivity; later rows than the watermark are dropped.

    Partial sessions are merged before the shuffle when
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on,
    which keeps a busy actor's input small.
    """
    timed = events.where(F.col("event_time").isNotNull())
    if timed.isStreaming:
        timed = timed.withWatermark("event_time", watermark)
    session = F.session_window("event_time", f"{gap_minutes} minutes")
    ip = F.coalesce(F.col("source_ip_address"), F.lit("NO_IP"))
    named_at = F.when(F.col("event_name").isNotNull(), F.struct("event_time", "global_sort_key"))
    any_of = lambda flag: F.bool_or(F.coalesce(F.col(flag), F.lit(False)))
    grouped = timed.groupBy("actor_key", ip.alias("source_ip"), session).agg(
        F.min("event_time").alias("incident_start_time"), F.max("event_time").alias("incident_end_time"),
        F.count("*").alias("event_count"), F.count_if("is_error").alias("error_event_count"),
        F.count_if("success").alias("success_event_count"),
        F.min_by("event_name", named_at).alias("first_event_name"), F.max_by("event_name", named_at).alias("last_event_name"),
        any_of("is_console_login").alias("contains_console_login"),
        any_of("is_recon_like_api").alias("contains_recon_like_api"),
        any_of("is_privilege_change_api").alias("contains_privilege_change_api"),
        any_of("is_resource_creation_api").alias("contains_resource_creation_api"),
    )
    return grouped.drop("session_window")


def activity_counts(
    events: DataFrame, key: str | Column = "actor_key", width: str = "5 minutes", slide: str = "1 minute",
    watermark: str = "1 hour",
) -> DataFrame:
    """Events per key in sliding windows: an approximation of the exact prior-activity counts."""
    timed = events.where(F.col("event_time").isNotNull())
    if timed.isStreaming:
        timed = timed.withWatermark("event_time", watermark)
    column = F.col(key) if isinstance(key, str) else key
    return timed.groupBy(F.window("event_time", width, slide), column.alias("activity_key")).agg(
        F.count("*").alias("event_count")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "activity_key", "event_count")
