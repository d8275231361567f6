"""Column expressions for identity keys, sort keys and small text helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(column: Column, values) -> Column:
    """Exact membership, never null (``isin`` on an empty list is false)."""
    return F.coalesce(column, F.lit("")).isin([str(v) for v in values])


def phrase(column: Column, mapping: Mapping[str, str]) -> Column:
    """Look a value up in a small fixed mapping; null where there is no entry."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.element_at(F.create_map(*pairs), F.coalesce(column, F.lit("")))


def _after_first(column: Column) -> Column:
    return F.substr(column, F.lit(2))


def sentence_start(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), _after_first(column))


def python_capitalize(column: Column) -> Column:
    """First letter upper, everything else lower."""
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(_after_first(column)))


def zero_fill(value: Column, width: int) -> Column:
    """Zero padding that keeps a minus sign first and never shortens long numbers."""
    digits = F.abs(value).cast("string")
    negative = value < 0
    room = F.when(negative, width - 1).otherwise(width)
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(room - F.length(digits), F.lit(0))), digits)
    return F.when(negative, F.concat(F.lit("-"), padded)).otherwise(padded)


def actor_key() -> Column:
    return F.coalesce("user_arn", "principal_id", "access_key_id", "source_ip_address", F.lit("UNKNOWN_ACTOR"))


def session_key(event_date: Column) -> Column:
    day = F.coalesce(event_date, F.lit("UNKNOWN_DATE"))
    ip = F.coalesce(F.col("source_ip_address"), F.lit("UNKNOWN_IP"))
    agent = F.coalesce(F.col("user_agent"), F.lit("UNKNOWN_UA"))
    who = F.coalesce("user_arn", "principal_id")
    return F.coalesce(F.col("access_key_id"), F.concat_ws("|", F.coalesce(who, ip), F.when(who.isNull(), agent).otherwise(ip), day))


def global_sort_key() -> Column:
    return F.concat(
        zero_fill(F.coalesce(F.col("event_time_epoch_ms"), F.lit(-1).cast("long")), 13), F.lit("|"),
        F.col("source_file_name"), F.lit("|"),
        zero_fill(F.coalesce(F.col("record_index_in_file"), F.lit(-1).cast("long")), 9), F.lit("|"),
        F.coalesce(F.col("event_id"), F.lit("NO_EVENT_ID")),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)
