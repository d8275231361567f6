"""Session defaults and the durable staging area used to cut long plans.

Plans that need a fixed row placement (a global sort whose positions are read
twice) are written once as Parquet and read back, so a lost executor re-reads
files instead of recomputing a sort that might sample other boundaries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# staged tables: enough partitions for 8 GB per exchange at 4 MB each; small ones are put together again; packed harder, as they are most of what is written
STAGED_PARTS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
                "spark.sql.parquet.compression.codec": "zstd"}


def build_session(app_name: str = "trailwarden", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All times in the data model are UTC; every source reader calls this."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temp folder only on a local master."""
    configured = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailwarden-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def small_parts(spark: SparkSession) -> Iterator[None]:
    """Shuffles planned in here are read in parts of a fixed size, so that a task's memory does not grow with the input; files are packed with zstd."""
    before = {key: spark.conf.get(key, None) for key in STAGED_PARTS}
    for key, value in STAGED_PARTS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialize(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``df`` once to the staging area and continue from the files; ``small`` for tables as long as the events.

    Those are most of what a run writes, so their columns are packed harder.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with small_parts(spark) if small else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
