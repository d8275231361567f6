"""Global order without a single-task window.

``positions`` range-sorts a frame on a *total* order and writes it once, so
every row gets a fixed (part, row) address.  Range partitioning samples the
full order key, hence one key, timestamp or file holding a large share of the
rows is split across parts like any other data.  What has to flow from one
part to the next (offsets, last key, open runs) is one row per part; tables of
that size, at most one row per sort task, are the only ones that get an
un-partitioned window or a broadcast here.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize, small_parts

PART, ROW, POS = "_part", "_row", "_pos"
_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits

def in_part() -> WindowSpec:
    return Window.partitionBy(PART).orderBy(ROW)


def running() -> WindowSpec:
    return in_part().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return in_part().rowsBetween(Window.unboundedPreceding, -1)


def _parts() -> WindowSpec:
    return Window.orderBy(PART)


def positions(df: DataFrame, order: list[Column], label: str, small: bool = False) -> DataFrame:
    """Sort globally by ``order`` and give every row its part, row and position."""
    ordered = df.orderBy(*order).withColumn(POS, F.monotonically_increasing_id())
    ordered = ordered.withColumn(PART, F.shiftright(POS, _ROW_BITS)).withColumn(
        ROW, F.col(POS).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    with small_parts(df.sparkSession) if small else nullcontext():
        return materialize(ordered, label)


def earlier_sum(column: str) -> Column:
    """Over a one-row-per-part table: total of all earlier parts."""
    return F.coalesce(F.sum(column).over(_parts().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def earlier_max(column: str) -> Column:
    return F.max(column).over(_parts().rowsBetween(Window.unboundedPreceding, -1))


def from_previous_part(column: str | Column) -> Column:
    return F.lag(column).over(_parts())


def open_run_carry(parts: DataFrame, starts: str, tails: list[str]) -> DataFrame:
    """Carry the tail of a run that is still open at a part's end into the next part.

    ``starts`` counts the runs that begin in a part, each tail column holds the
    amount gathered since the last begin (or since the part's first row).
    """
    opened = parts.withColumn(
        "_run", F.sum((F.col(starts) > 0).cast("int")).over(_parts().rowsBetween(Window.unboundedPreceding, 0))
    )
    in_run = Window.partitionBy("_run").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    for tail in tails:
        opened = opened.withColumn(tail, F.sum(tail).over(in_run))
    for tail in tails:
        opened = opened.withColumn(tail, F.coalesce(F.lag(tail).over(_parts()), F.lit(0)))
    return opened.drop("_run")


def with_part_state(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Attach per-part state; ``parts`` has one row per sort task."""
    return df.join(F.broadcast(parts), PART)


def global_index(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Dense zero-based index under a total order."""
    placed = positions(df, order, label, small=True)
    offsets = placed.groupBy(PART).agg(F.count("*").alias("_n")).select(
        PART, earlier_sum("_n").alias("_before")
    )
    return with_part_state(placed, offsets).withColumn(name, F.col("_before") + F.col(ROW)).drop(
        "_before", PART, ROW, POS
    )


def order_violations(df: DataFrame, order: list[Column], key: str, label: str) -> DataFrame:
    """One row: how often ``key`` falls below its predecessor under ``order``."""
    placed = positions(df.select(key, *[c.alias(f"_o{i}") for i, c in enumerate(_plain(order))]),
                       _renamed(order), label)
    ends = placed.groupBy(PART).agg(F.max_by(key, ROW).alias("_last"))
    carried = ends.select(PART, from_previous_part("_last").alias("_carried"))
    previous = F.coalesce(F.lag(key).over(in_part()), F.when(F.col(ROW) == 0, F.col("_carried")))
    return with_part_state(placed, carried).select((F.col(key) < previous).alias("_down")).agg(
        F.count_if("_down").alias("order_violations")
    )


def _plain(order: list[str]) -> list[Column]:
    return [F.col(c) for c in order]


def _renamed(order: list[str]) -> list[Column]:
    return [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))]
