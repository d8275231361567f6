"""Table scans and the projection of a click-stream table onto audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet scan; filters and column pruning are pushed into it by the optimizer."""
    use_utc(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# event type -> (audit event name, service)
_EVENT_NAMES = {
    "signup": ("ConsoleLogin", "signin"),
    "view": ("ListBuckets", "s3"),
    "click": ("DescribeInstances", "ec2"),
    "purchase": ("RunInstances", "ec2"),
    "error": ("AttachUserPolicy", "iam"),
}


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table read as normalized audit events (nulls included on purpose)."""
    events = read_table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    user = F.col("user_id").cast("string")
    event_type = F.col("event_type")
    names, sources = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, (name, service) in _EVENT_NAMES.items():
        names = F.when(event_type == kind, name).otherwise(names)
        sources = F.when(event_type == kind, f"{service}.amazonaws.com").otherwise(sources)
    arn = F.lit("arn:aws:iam::1:")
    time = F.when(k % 50 != 49, F.col("ts").cast("timestamp"))
    base = events.select(
        F.when(k != 0, F.col("event_id").cast("string")).alias("event_id"),
        time.alias("event_time"),
        F.unix_millis(time).alias("event_time_epoch_ms"),
        F.when(k % 10 != 0,
               F.when(F.col("user_id") % 7 == 0, F.concat(arn, F.lit("root")))
               .when(F.col("user_id") % 7 == 1, F.concat(arn, F.lit("assumed-role/r/"), user))
               .otherwise(F.concat(arn, F.lit("user/"), user))).alias("user_arn"),
        F.when(k % 20 < 10, F.concat(F.lit("P"), user)).alias("principal_id"),
        F.when(k % 3 == 0, F.concat(F.lit("AK"), user)).alias("access_key_id"),
        F.when(k % 13 != 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string"))).alias("source_ip_address"),
        F.when(F.col("user_id") % 5 == 0, F.lit("IAMUser")).when(F.col("user_id") % 11 == 0, F.lit("AWSService")).alias("user_type"),
        F.when(k % 17 == 0, F.lit("svc.amazonaws.com")).alias("invoked_by"),
        names.alias("event_name"),
        sources.alias("event_source"),
        F.concat(F.lit("r"), (k % 3).cast("string")).alias("aws_region"),
        F.when(k % 5 != 0, F.concat(F.lit("ua"), (k % 2).cast("string"))).alias("user_agent"),
        F.when(F.col("value") < 30, F.lit("Denied")).alias("error_code"),
        F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string"), F.lit(".json")).alias("source_file_name"),
        F.floor(F.col("event_id") / 3).alias("record_index_in_file"),
        F.when(k % 4 == 0, F.lit("AWS::S3::Bucket|AWS::IAM::User"))
        .when(k % 4 == 1, F.lit("AWS::EC2::Instance")).alias("resource_types_concat"),
    )
    return base.withColumns({"success": F.col("error_code").isNull(), "is_error": F.col("error_code").isNotNull()})
