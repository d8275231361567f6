"""Queries for log normalization, quality, analyst reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyst, metrics, normalize, ordering, quality
from ..operators.features import CANONICAL_ORDER
from ..sources import logs
from ..sources.tables import read_table
from . import stages
from .core_queries import CASE_INCIDENTS, FEATURES, INCIDENT_TEXT, LABELED, _incident_view, time_text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


# --- raw log files derived from the events table -------------------------------------
def _record_json() -> F.Column:
    """One audit record per event as JSON text, with absent, null, empty and blank fields."""
    k = F.get_json_object("props", "$.k").cast("long")
    field = lambda cond, text: F.when(cond, text)
    parts = [
        F.concat(F.lit('"eventID":"e'), F.col("event_id").cast("string"), F.lit('"')),
        F.concat(F.lit('"eventTime":"'), F.when(k % 50 == 7, "not-a-time").otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit('"')),
        F.concat(F.lit('"eventName":" '), F.col("event_type"), F.lit(' "')),
        F.concat(F.lit('"readOnly":'), F.when(k % 4 == 0, "true").when(k % 4 == 1, '" FALSE"').when(k % 4 == 2, "null").otherwise('"maybe"')),
        field(k % 6 != 0, F.concat(
            F.lit('"userIdentity":'), F.when(k % 6 == 1, F.lit('"none"')).otherwise(F.concat(
                F.lit('{"type":"IAMUser","arn":'), F.when(k % 6 == 2, F.lit("null")).otherwise(
                    F.concat(F.lit('"arn:'), F.col("user_id").cast("string"), F.lit('"'))),
                F.when(k % 6 == 3, F.lit(',"accessKeyId":""')).otherwise(F.lit("")),
                F.lit(',"sessionContext":{"attributes":{"mfaAuthenticated":"true"}}}'))))),
        field(k % 5 != 0, F.concat(F.lit('"userAgent":'), F.when(k % 5 == 1, "null").when(k % 5 == 2, '""').otherwise('"  ua  "'))),
        field(k % 3 != 0, F.concat(F.lit('"errorCode":'), F.when(k % 3 == 1, '"  "').otherwise('""'))),
        field(k % 7 != 0, F.concat(F.lit('"resources":'), F.when(k % 7 == 1, "null").when(k % 7 == 2, "[]").when(
            k % 7 == 3, '{"type":"x"}').otherwise(
            '[{"type":" B ","ARN":"z"},"odd",{"type":"A","accountId":"9"},{"type":"B","ARN":"y"}]'))),
        field(k % 2 == 0, F.concat(F.lit('"requestParameters":{"b": 1, "a": {"d": "x", "c": [1, 2]}, "k": '), k.cast("string"), F.lit("}"))),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


EVENTS_PER_FILE = 50


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """Log file texts: fifty records and one stray entry each; beside every tenth file lies a broken copy."""
    events = read_table(spark, folder, "events")
    number = F.floor(F.col("event_id") / EVENTS_PER_FILE)
    entries = events.groupBy(number.alias("file_no")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", _record_json().alias("json")))).alias("entries"))
    body = F.concat(F.lit('{"Records":["stray",'), F.array_join(F.transform("entries", lambda e: e["json"]), ","), F.lit("]}"))
    broken = F.when(F.col("file_no") % 30 == 9, F.lit('{"notRecords":[]}')).when(
        F.col("file_no") % 30 == 19, F.expr("left(text, length(text) - 1)")).when(
        F.col("file_no") % 30 == 29, F.concat(F.lit("["), F.col("text"), F.lit("]")))
    files = entries.select("file_no", body.alias("text")).select("file_no", F.inline(F.array(
        F.struct(F.lit(".json").alias("suffix"), F.col("text").alias("text")), F.struct(F.lit("-broken.json").alias("suffix"), broken.alias("text")))))
    name = F.concat(F.lit("log-"), F.col("file_no").cast("string"), "suffix")
    return files.where("text IS NOT NULL").select(
        F.concat(F.lit("derived/"), name).alias("source"), name.alias("file_name"), "text",
        F.lit(None).cast("string").alias("reason"), F.lit(True).alias("counts_as_file"))


def _log_entries(spark: SparkSession, folder: str) -> DataFrame:
    return stages.stage(spark, folder, "log-entries", lambda: logs.split_records(log_files(spark, folder)))


RAW = f"""
src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // {EVENTS_PER_FILE} AS file_no,
    row_number() OVER (PARTITION BY event_id // {EVENTS_PER_FILE} ORDER BY event_id) AS pos FROM events)""".strip()


@query(f"WITH {RAW}" + """ SELECT 'e' || event_id AS event_id, pos AS record_index_in_file,
  'log-' || file_no || '.json' AS source_file_name,
  CASE WHEN k % 50 <> 7 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') END AS event_time,
  CASE WHEN k % 50 <> 7 THEN epoch_us(date_trunc('second', ts)) // 1000 END AS event_time_epoch_ms,
  event_type AS event_name, CASE WHEN k % 4 = 0 THEN true WHEN k % 4 = 1 THEN false END AS read_only,
  CASE WHEN k % 6 >= 3 THEN 'arn:' || user_id END AS user_arn, CASE WHEN k % 6 >= 2 THEN 'IAMUser' END AS user_type,
  CASE WHEN k % 6 >= 2 THEN true END AS session_mfa_authenticated,
  CASE WHEN k % 5 >= 3 THEN 'ua' END AS user_agent, CAST(NULL AS VARCHAR) AS error_code,
  k % 3 <> 1 AS success, k % 3 = 1 AS is_error,
  CASE WHEN k % 2 = 0 THEN '{"a":{"c":[1,2],"d":"x"},"b":1,"k":' || k || '}' END AS request_parameters_json
FROM src""")
def normalized_log_records(spark: SparkSession, folder: str) -> DataFrame:
    flat = normalize.normalize_records(logs.records(_log_entries(spark, folder)))
    return flat.select(
        "event_id", "record_index_in_file", "source_file_name", time_text("event_time").alias("event_time"),
        "event_time_epoch_ms", "event_name", "read_only", "user_arn", "user_type", "session_mfa_authenticated",
        "user_agent", "error_code", "success", "is_error", "request_parameters_json")


@query(f"WITH {RAW}" + """ SELECT 'e' || event_id AS event_id,
  CAST(CASE WHEN k % 7 = 2 THEN 0 WHEN k % 7 >= 4 THEN 4 END AS BIGINT) AS resource_count,
  CASE WHEN k % 7 >= 4 THEN 'A|B' END AS resource_types_concat,
  CASE WHEN k % 7 >= 4 THEN 'y|z' END AS resource_arns_concat,
  CASE WHEN k % 7 >= 4 THEN '9' END AS resource_account_ids_concat FROM src""")
def log_resource_summary(spark: SparkSession, folder: str) -> DataFrame:
    flat = normalize.normalize_records(logs.records(_log_entries(spark, folder)))
    return flat.select("event_id", "resource_count", *normalize.RESOURCE_FIELDS)


@query(f"WITH {RAW}" + """, st AS (SELECT 'e' || event_id AS event_id,
  CASE WHEN k % 6 < 2 THEN 'absent' WHEN k % 6 = 2 THEN 'null' ELSE 'present' END AS user_arn_presence_state,
  CASE WHEN k % 6 = 3 THEN 'empty' ELSE 'absent' END AS access_key_id_presence_state,
  'absent' AS source_ip_address_presence_state,
  CASE k % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' WHEN 2 THEN 'empty' ELSE 'present' END
    AS user_agent_presence_state,
  CASE WHEN k % 2 = 0 THEN 'present' ELSE 'absent' END AS request_parameters_presence_state,
  CASE k % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' WHEN 2 THEN 'empty' ELSE 'present' END
    AS resources_presence_state FROM src)
SELECT *, user_agent_presence_state <> 'present' AS missing_user_agent,
  resources_presence_state <> 'present' AS missing_resources FROM st""")
def log_presence_states(spark: SparkSession, folder: str) -> DataFrame:
    flat = normalize.normalize_records(logs.records(_log_entries(spark, folder)))
    return flat.select(
        "event_id", *[f"{name}_presence_state" for name in normalize.PRESENCE_PATHS], "missing_user_agent",
        "missing_resources")


@query(f"WITH {RAW}" + """ SELECT
  count(DISTINCT file_no) + count(DISTINCT file_no) FILTER (file_no % 10 = 9) AS total_files_read,
  count(*) AS total_records_parsed, count(DISTINCT file_no) FILTER (file_no % 10 = 9) AS total_malformed_files,
  count(DISTINCT file_no) AS total_malformed_records FROM src""")
def log_ingest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return logs.ingest_metrics(_log_entries(spark, folder))


@query(f"WITH {RAW}" + """ SELECT reason, count(*) AS entries FROM (
  SELECT DISTINCT file_no, 'NonObjectRecord' AS reason FROM src
  UNION ALL SELECT DISTINCT file_no, CASE file_no % 30 WHEN 19 THEN 'JSONDecodeError' ELSE 'ValueError' END FROM src WHERE file_no % 10 = 9)
GROUP BY reason""")
def log_malformed_reasons(spark: SparkSession, folder: str) -> DataFrame:
    errors = logs.ingest_errors(_log_entries(spark, folder))
    return errors.groupBy("reason").agg(F.count("*").alias("entries"))


# --- quality -------------------------------------------------------------------------
_RATE_COLUMNS = ["event_id", "event_time", "user_arn", "principal_id", "access_key_id", "source_ip_address",
                 "user_agent", "error_code", "resource_types_concat", "actor_key"]


@query(f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 6) AS null_rate FROM feat"
    for c in _RATE_COLUMNS))
def null_rate_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.null_rates(stages.events_flat(spark, folder).select(*_RATE_COLUMNS))


@query(f"WITH {FEATURES}, long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value FROM feat" for c in quality.TOP_VALUE_COLUMNS) + """)
SELECT column_name, value, value_count, value_rank FROM (
  SELECT column_name, value, count(*) AS value_count,
    row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS value_rank
  FROM long WHERE value IS NOT NULL GROUP BY column_name, value) WHERE value_rank <= 10""")
def top_value_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.top_values(stages.events_flat(spark, folder))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_event_ids FROM "
       "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def duplicate_id_count(spark: SparkSession, folder: str) -> DataFrame:
    return quality.duplicate_ids(read_table(spark, folder, "lineitem"), "l_orderkey")


@query(f"""WITH {CASE_INCIDENTS} SELECT (SELECT count(*) FROM feat) AS event_row_count,
  (SELECT count(*) FROM feat WHERE event_time IS NULL) AS invalid_timestamps,
  (SELECT count(*) FROM feat WHERE event_name IS NULL AND event_source IS NULL)
    AS rows_missing_event_name_and_event_source,
  (SELECT strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') FROM feat) AS event_time_min,
  (SELECT strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') FROM feat) AS event_time_max,
  (SELECT count(event_id) - count(DISTINCT event_id) FROM feat) AS duplicate_event_ids,
  count(*) AS incident_row_count, count(*) FILTER (incident_duration_seconds < 0) AS impossible_incident_durations
FROM inc""")
def data_quality_totals(spark: SparkSession, folder: str) -> DataFrame:
    report = quality.quality_report(stages.events_flat(spark, folder), stages.incidents(spark, folder))
    return report.withColumns({c: time_text(c) for c in ("event_time_min", "event_time_max")})


@query(f"""WITH {FEATURES}, o AS (SELECT global_sort_key AS key,
    lag(global_sort_key) OVER (ORDER BY raw_event_row_index) AS prev FROM feat)
SELECT count(*) FILTER (key < prev) AS order_violations FROM o""")
def sort_key_violations(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.order_violations(stages.events_flat(spark, folder), CANONICAL_ORDER, "global_sort_key", "sort-check")


@query(f"""WITH {FEATURES}, o AS (SELECT global_sort_key AS key,
    lag(global_sort_key) OVER (ORDER BY raw_event_row_index) AS prev FROM feat)
SELECT CASE WHEN count(*) FILTER (key < prev) > 0 THEN 'Event table is not canonically sorted by global_sort_key.'
  ELSE '' END AS errors FROM o""")
def output_validation(spark: SparkSession, folder: str) -> DataFrame:
    events = stages.events_flat(spark, folder)
    parsed = events.agg(F.count("*").alias("total_records_parsed"))
    checked = quality.validate_outputs(events, stages.incidents(spark, folder), parsed)
    return checked.select(F.array_join("errors", " ").alias("errors"))


@query()
def event_schema_description(spark: SparkSession, folder: str) -> DataFrame:
    return quality.describe_schema(stages.events_flat(spark, folder), "events_flat")


# --- analyst queries -------------------------------------------------------------------
@query(f"WITH {FEATURES} SELECT actor_key, count(*) AS event_count FROM feat GROUP BY actor_key "
       "ORDER BY event_count DESC, actor_key")
def actors_by_event_count(spark: SparkSession, folder: str) -> DataFrame:
    return analyst.actors_by_event_count(stages.events_flat(spark, folder))


@query(f"WITH {FEATURES} SELECT source_ip_address, count(*) AS failed_calls FROM feat WHERE is_error "
       "GROUP BY source_ip_address ORDER BY failed_calls DESC, source_ip_address NULLS LAST")
def ips_by_failed_calls(spark: SparkSession, folder: str) -> DataFrame:
    return analyst.ips_by_failed_calls(stages.events_flat(spark, folder))


@query(f"WITH {FEATURES} SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d') AS period, event_name, "
       "count(*) AS event_count FROM feat GROUP BY 1, 2")
def event_names_over_time(spark: SparkSession, folder: str) -> DataFrame:
    counts = analyst.event_names_over_time(stages.events_flat(spark, folder))
    return counts.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(f"WITH {CASE_INCIDENTS} SELECT {INCIDENT_TEXT} FROM inc WHERE contains_privilege_change_api")
def incidents_with_privilege_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _incident_view(analyst.incidents_with_privilege_actions(stages.incidents(spark, folder)))


@query(f"WITH {CASE_INCIDENTS} SELECT 'incident_' || lpad(CAST(CAST(island AS BIGINT) AS VARCHAR), 9, '0') AS incident_id, "
       "event_name, count(*) AS attempts FROM isl WHERE event_name IS NOT NULL GROUP BY island, event_name "
       "HAVING count(*) >= 3")
def incidents_with_repeated_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return analyst.incidents_with_repeated_attempts(stages.incident_members(spark, folder), 3)


@query(f"""WITH {FEATURES} SELECT actor_key, strftime(first_recon, '%Y-%m-%d %H:%M:%S.%f') AS first_recon,
  strftime(last_creation, '%Y-%m-%d %H:%M:%S.%f') AS last_creation FROM (
    SELECT actor_key, min(event_time) FILTER (is_recon_like_api) AS first_recon,
      max(event_time) FILTER (is_resource_creation_api OR is_privilege_change_api
        OR coalesce(event_source, '') = 'iam.amazonaws.com') AS last_creation
    FROM feat GROUP BY actor_key) WHERE first_recon < last_creation""")
def actors_from_recon_to_creation(spark: SparkSession, folder: str) -> DataFrame:
    spans = analyst.actors_from_recon_to_creation(stages.events_flat(spark, folder))
    return spans.withColumns({c: time_text(c) for c in ("first_recon", "last_creation")})


# --- metrics -----------------------------------------------------------------------------
_SCORED = """SELECT toxic AS label, n_chars // 100 / 30.0 AS score, quality AS prediction
  FROM labels JOIN documents USING (doc_id)"""


def _document_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "n_chars")
    score = F.floor(F.col("n_chars") / 100) / 30.0
    return read_table(spark, folder, "labels").join(docs, "doc_id").select(
        F.col("toxic").alias("label"), score.alias("score"), F.col("quality").alias("prediction"))


@query(f"""WITH s AS ({_SCORED}), g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY score),
c AS (SELECT pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum((n - pos) * (tp - pos) + (n - pos) * pos / 2.0) / (CAST(sum(pos) AS DOUBLE) * sum(n - pos)), 6)
    AS roc_auc,
  round(sum(pos * (CAST(tp AS DOUBLE) / seen)) / CAST(sum(pos) AS DOUBLE), 6) AS average_precision FROM c""")
def ranking_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ranking_metrics(_document_scores(spark, folder))


@query(f"""WITH s AS ({_SCORED}), cls AS (SELECT DISTINCT CAST(label AS VARCHAR) AS cls FROM s
    UNION SELECT DISTINCT CAST(prediction AS VARCHAR) FROM s),
r AS (SELECT cls, (SELECT count(*) FROM s WHERE CAST(label AS VARCHAR) = cls) AS support,
  (SELECT count(*) FROM s WHERE CAST(prediction AS VARCHAR) = cls) AS predicted,
  (SELECT count(*) FROM s WHERE CAST(label AS VARCHAR) = cls AND label = prediction) AS hit FROM cls),
m AS (SELECT cls, support, hit, CASE WHEN predicted = 0 THEN 0 ELSE CAST(hit AS DOUBLE) / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE CAST(hit AS DOUBLE) / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0 ELSE 2.0 * hit / (predicted + support) END AS f1 FROM r)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CAST(f1 AS DOUBLE), 6) AS f1, support FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.classification_report(_document_scores(spark, folder))
