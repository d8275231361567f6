"""Network flow samples: label counts, suspicious share and example flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import attach_row

# fixed values: file column -> output column
FLOW_COLUMNS = {
    "Timestamp": "timestamp",
    "Dst Port": "dst_port",
    "Protocol": "protocol",
    "Flow Duration": "flow_duration",
    "Tot Fwd Pkts": "tot_fwd_pkts",
    "Tot Bwd Pkts": "tot_bwd_pkts",
    "Label": "label",
}


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """The seven used columns of flow CSV files, with file name and line order."""
    rows = spark.read.csv(path, header=True, pathGlobFilter="*.csv", enforceSchema=False)
    return rows.select(
        *[F.col(f"`{name}`").alias(alias) for name, alias in FLOW_COLUMNS.items()],
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_order"),
    ).withColumn("label", F.trim("label"))


def flow_label_counts(flows: DataFrame) -> DataFrame:
    """Flows per file and label, and per label over all files (``file_name`` null)."""
    kept = flows.where(F.col("label") != "Label")
    return kept.rollup("label", "file_name").agg(F.count("*").alias("flow_count")).where(F.col("label").isNotNull())


def flow_summary(flows: DataFrame) -> DataFrame:
    """One row of totals; no row where there are no files."""
    header = F.col("label") == "Label"
    per_file = flows.groupBy("file_name").agg(
        F.count_if(header).alias("headers"), F.count_if(~header).alias("rows"),
        F.count_if(F.col("label") == "Benign").alias("benign"),
    )
    totals = per_file.agg(
        F.count("*").alias("file_count"), F.sum("rows").alias("total_rows"),
        F.sum("headers").alias("header_rows_removed"), F.sum("benign").alias("benign_flow_count"),
    ).where(F.col("file_count") > 0)
    suspicious = F.greatest(F.col("total_rows") - F.col("benign_flow_count"), F.lit(0))
    return totals.withColumn("suspicious_flow_count", suspicious).withColumn(
        "suspicious_ratio",
        F.coalesce(F.round(F.try_divide("suspicious_flow_count", "total_rows"), 4), F.lit(0.0)),
    )


def top_suspicious_labels(flows: DataFrame) -> DataFrame:
    return (
        flows.where((F.col("label") != "Label") & (F.lower("label") != "benign"))
        .groupBy("label").agg(F.count("*").alias("flow_count"))
    )


def suspicious_examples(flows: DataFrame, limit: int = 6) -> DataFrame:
    """The first suspicious flows in file order (a bounded top-k, not a full sort)."""
    picked = flows.where((F.col("label") != "Label") & (F.lower("label") != "benign"))
    order = ["file_name", "block_start", "line_order"]
    return picked.orderBy(*order).limit(limit).select(*FLOW_COLUMNS.values())


def review_attachment(incidents: DataFrame, summary: DataFrame, reviewed: bool) -> DataFrame:
    """Network review block per incident; example flows only once reviewed.

    ``summary`` is a single row, so every incident carries a copy of its fields.
    """
    block = summary.select(
        F.lit("reviewed" if reviewed else "available_not_reviewed").alias("network_status"),
        "file_count", "suspicious_flow_count", "suspicious_ratio", "top_suspicious_labels",
        (F.col("suspicious_flow_examples") if reviewed else F.lit(None)).alias("suspicious_flow_examples"),
    )
    return attach_row(incidents, block)


def evidence_package(flows: DataFrame, max_examples: int = 6) -> DataFrame:
    """Summary with nested label counts and examples; label sets are tiny by nature."""
    labels = top_suspicious_labels(flows).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("flow_count")).alias("n"), "label"))),
            lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("count")),
        ).alias("top_suspicious_labels")
    )
    examples = suspicious_examples(flows, max_examples).agg(
        F.collect_list(F.struct(*FLOW_COLUMNS.values())).alias("suspicious_flow_examples")
    )
    return attach_row(attach_row(flow_summary(flows), labels), examples)
