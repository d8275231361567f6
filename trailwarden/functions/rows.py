"""Attach the fields of a one-row table to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of ``one_row`` as a scalar subquery; null where it has no row.

    More than one row is an error, so this never multiplies ``df``.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_attached")).scalar()
    return df.withColumn("_attached", packed).select(
        *df.columns, *[F.col(f"_attached.{c}").alias(c) for c in one_row.columns])
