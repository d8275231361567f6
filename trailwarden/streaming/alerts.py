"""Alert stream: triage each micro-batch and record every alert once."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from ..operators.casework import alert_candidates, alert_scan_counts, pending_alerts

_KEYS = "dedupe_key string, run_id string, batch_id long"
_QUERY_ID = "sql.streaming.queryId"  # kept with the checkpoint: a new checkpoint has a new one


def _sent_before(spark: SparkSession, path: str, run_id: str, batch_id: int) -> DataFrame:
    """Keys recorded by other batches of any run; a retried batch does not see its own rows."""
    try:
        sent = spark.read.schema(_KEYS).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], "dedupe_key string")
    return sent.where((F.col("run_id") != run_id) | (F.col("batch_id") != batch_id)).select("dedupe_key")


def record_alerts(cases: DataFrame, batch_id: int, path: str, recipients: Sequence[str], run_id: str = "scan") -> None:
    """Append the alerts nobody was told about yet, under the partition of the run and batch.

    Writing replaces that one partition, so running a batch again gives the same
    table, and no other run's alerts are touched.
    """
    fresh = pending_alerts(alert_candidates(cases, recipients), _sent_before(cases.sparkSession, path, run_id, batch_id))
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}/batch_id={batch_id}")


def alert_stream(
    incidents: DataFrame, triage: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, recipients: Sequence[str]
) -> DataStreamWriter:
    """Writer of the alert table; ``triage`` turns incidents into triaged cases."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID)
        record_alerts(triage(batch), batch_id, path, recipients, run or uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex)

    return incidents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def scan_once(cases: DataFrame, batch_id: int, path: str, recipients: Sequence[str], run_id: str | None = None) -> DataFrame:
    """One scheduled scan: record alerts and give the processed and failed counts.

    A scan is a run of its own unless a retry passes the ``run_id`` of the first try.
    """
    record_alerts(cases.where(F.size("result_errors") == 0), batch_id, path, recipients, run_id or uuid.uuid4().hex)
    return alert_scan_counts(cases)
