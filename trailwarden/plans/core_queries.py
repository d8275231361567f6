"""Queries over events, features, incidents and labels, each with its SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, incidents, labels
from ..rules import FLAG_RULES, LABEL_RULES, RULE_COLUMNS
from ..sources.tables import audit_events
from . import stages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


# --- SQL building blocks ------------------------------------------------------
EVENTS = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (
  SELECT CASE WHEN k <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id,
    CASE WHEN k % 50 <> 49 THEN ts END AS event_time,
    CASE WHEN k % 50 <> 49 THEN CAST(epoch_us(ts) // 1000 AS BIGINT) END AS event_time_epoch_ms,
    CASE WHEN k % 10 <> 0 THEN 'arn:aws:iam::1:' || CASE WHEN user_id % 7 = 0 THEN 'root'
      WHEN user_id % 7 = 1 THEN 'assumed-role/r/' || user_id ELSE 'user/' || user_id END END AS user_arn,
    CASE WHEN k % 20 < 10 THEN 'P' || user_id END AS principal_id,
    CASE WHEN k % 3 = 0 THEN 'AK' || user_id END AS access_key_id,
    CASE WHEN k % 13 <> 0 THEN '10.0.0.' || (user_id % 4) END AS source_ip_address,
    CASE WHEN user_id % 5 = 0 THEN 'IAMUser' WHEN user_id % 11 = 0 THEN 'AWSService' END AS user_type,
    CASE WHEN k % 17 = 0 THEN 'svc.amazonaws.com' END AS invoked_by,
    CASE event_type WHEN 'signup' THEN 'ConsoleLogin' WHEN 'view' THEN 'ListBuckets'
      WHEN 'click' THEN 'DescribeInstances' WHEN 'purchase' THEN 'RunInstances'
      WHEN 'error' THEN 'AttachUserPolicy' END AS event_name,
    CASE event_type WHEN 'signup' THEN 'signin' WHEN 'view' THEN 's3' WHEN 'click' THEN 'ec2'
      WHEN 'purchase' THEN 'ec2' WHEN 'error' THEN 'iam' END || '.amazonaws.com' AS event_source,
    'r' || (k % 3) AS aws_region,
    CASE WHEN k % 5 <> 0 THEN 'ua' || (k % 2) END AS user_agent,
    CASE WHEN value < 30 THEN 'Denied' END AS error_code,
    'f' || (events_id % 3) || '.json' AS source_file_name,
    CAST(events_id // 3 AS BIGINT) AS record_index_in_file,
    CASE WHEN k % 4 = 0 THEN 'AWS::S3::Bucket|AWS::IAM::User' WHEN k % 4 = 1 THEN 'AWS::EC2::Instance' END
      AS resource_types_concat,
    NOT coalesce(value < 30, false) AS success, coalesce(value < 30, false) AS is_error
  FROM (SELECT *, event_id AS events_id FROM raw)
)""".strip()


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


FEATURES = EVENTS + f""",
keyed AS (
  SELECT *, strftime(event_time, '%Y-%m-%d') AS event_date,
    coalesce(user_arn, principal_id, access_key_id, source_ip_address, 'UNKNOWN_ACTOR') AS actor_key
  FROM ev
),
feat AS (
  SELECT *,
    coalesce(access_key_id,
      CASE WHEN user_arn IS NOT NULL OR principal_id IS NOT NULL
        THEN coalesce(user_arn, principal_id) || '|' || coalesce(source_ip_address, 'UNKNOWN_IP')
        ELSE coalesce(source_ip_address, 'UNKNOWN_IP') || '|' || coalesce(user_agent, 'UNKNOWN_UA') END
      || '|' || coalesce(event_date, 'UNKNOWN_DATE')) AS session_key,
    CASE WHEN event_time_epoch_ms IS NULL THEN '-000000000001'
      ELSE lpad(CAST(event_time_epoch_ms AS VARCHAR), 13, '0') END || '|' || source_file_name || '|'
      || lpad(CAST(record_index_in_file AS VARCHAR), 9, '0') || '|' || coalesce(event_id, 'NO_EVENT_ID')
      AS global_sort_key,
    coalesce(event_name, '') IN ({_names(FLAG_RULES['console_login_event_names'])}) AS is_console_login,
    coalesce(event_name, '') IN ({_names(FLAG_RULES['auth_related_event_names'])}) AS is_auth_related,
    coalesce(event_name, '') IN ({_names(FLAG_RULES['recon_event_names'])}) AS is_recon_like_api,
    coalesce(event_name, '') IN ({_names(FLAG_RULES['privilege_change_event_names'])}) AS is_privilege_change_api,
    coalesce(event_name, '') IN ({_names(FLAG_RULES['resource_creation_event_names'])}) AS is_resource_creation_api,
    row_number() OVER (ORDER BY event_time NULLS LAST, source_file_name NULLS LAST,
      record_index_in_file NULLS LAST, event_id NULLS LAST) - 1 AS raw_event_row_index
  FROM keyed
)"""


def incident_sql(gap_minutes: int, mode: str) -> str:
    order = ("event_time NULLS LAST, actor_key, source_ip_address NULLS LAST, global_sort_key"
             if mode == incidents.SPLIT else
             "actor_key, source_ip_address NULLS LAST, event_time NULLS LAST, global_sort_key")
    return FEATURES + f""",
ord AS (
  SELECT *, actor_key || '|' || coalesce(source_ip_address, 'NO_IP') AS pkey,
    row_number() OVER (ORDER BY {order}) AS pos FROM feat
),
flagged AS (
  SELECT *, CASE WHEN pkey = lag(pkey) OVER (ORDER BY pos)
      AND epoch_us(event_time) - epoch_us(lag(event_time) OVER (ORDER BY pos)) <= {gap_minutes * 60_000_000}
    THEN 0 ELSE 1 END AS starts FROM ord
),
isl AS (SELECT *, sum(starts) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
top_name AS (
  SELECT island, event_name AS top_event_name FROM (
    SELECT island, event_name, row_number() OVER (PARTITION BY island ORDER BY count(*) DESC, event_name) AS rn
    FROM isl WHERE event_name IS NOT NULL GROUP BY island, event_name) WHERE rn = 1
),
res AS (
  SELECT island, string_agg(part, '|' ORDER BY part) AS resource_types_seen FROM (
    SELECT DISTINCT island, unnest(string_split(resource_types_concat, '|')) AS part
    FROM isl WHERE resource_types_concat IS NOT NULL) WHERE part <> '' GROUP BY island
),
agg AS (
  SELECT island, 'incident_' || lpad(CAST(CAST(island AS BIGINT) AS VARCHAR), 9, '0') AS incident_id,
    max(actor_key) AS actor_key, max(source_ip_address) AS primary_source_ip_address,
    min(event_time) AS incident_start_time, max(event_time) AS incident_end_time,
    coalesce((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1000000.0, 0.0) AS incident_duration_seconds,
    count(*) AS event_count, count(DISTINCT event_name) AS distinct_event_names,
    count(DISTINCT event_source) AS distinct_event_sources, count(DISTINCT aws_region) AS distinct_regions,
    count(*) FILTER (is_error) AS error_event_count, count(*) FILTER (success) AS success_event_count,
    first(event_name ORDER BY pos) FILTER (event_name IS NOT NULL) AS first_event_name,
    last(event_name ORDER BY pos) FILTER (event_name IS NOT NULL) AS last_event_name,
    bool_or(is_console_login) AS contains_console_login,
    bool_or(is_recon_like_api) AS contains_recon_like_api,
    bool_or(is_privilege_change_api) AS contains_privilege_change_api,
    bool_or(is_resource_creation_api) AS contains_resource_creation_api,
    array_to_string(list_slice(list_sort(list(DISTINCT user_agent) FILTER (user_agent IS NOT NULL)), 1, 50), '|')
      AS user_agents_raw,
    array_to_string(list_slice(list(event_name ORDER BY pos) FILTER (event_name IS NOT NULL), 1, 50), '|')
      AS names_raw,
    array_to_string(list_slice(list(event_source ORDER BY pos) FILTER (event_source IS NOT NULL), 1, 50), '|')
      AS sources_raw,
    coalesce('[' || array_to_string(list_slice(list('"' || event_id || '"' ORDER BY pos)
      FILTER (event_id IS NOT NULL), 1, 50), ', ') || ']', '[]') AS event_ids_in_order,
    '[' || array_to_string(list_slice(list(raw_event_row_index ORDER BY pos), 1, 50), ', ') || ']'
      AS raw_event_row_indices,
    strftime(min(event_time), '%Y-%m-%d') AS incident_start_date
  FROM isl GROUP BY island
),
inc AS (
  SELECT agg.*, nullif(user_agents_raw, '') AS user_agents_seen, nullif(names_raw, '') AS ordered_event_name_sequence,
    nullif(sources_raw, '') AS ordered_event_source_sequence, top_event_name, resource_types_seen
  FROM agg LEFT JOIN top_name USING (island) LEFT JOIN res USING (island)
)"""


CASE_INCIDENTS = incident_sql(stages.CASE_GAP_MINUTES, incidents.INDEPENDENT)

LABELED = CASE_INCIDENTS + """,
lf AS (
  SELECT *, contains(actor_key, ':root') AS actor_is_root,
    contains(actor_key, ':assumed-role/') AS actor_is_assumed_role,
    CAST(error_event_count AS DOUBLE) / event_count AS failure_ratio,
    event_count / (greatest(incident_duration_seconds, 1.0) / 60.0) AS events_per_minute,
    error_event_count >= 3 AND CAST(error_event_count AS DOUBLE) / event_count >= 0.5 AS has_high_failure_ratio,
    error_event_count >= 3 AND success_event_count = 0 AS has_failure_burst,
    event_count >= 15 AND incident_duration_seconds <= 900 AS has_event_burst,
    distinct_event_names >= 8 AS has_broad_surface_area,
    contains_recon_like_api AND contains_privilege_change_api AS has_recon_plus_privilege,
    contains_recon_like_api AND contains_resource_creation_api AS has_recon_plus_resource_creation,
    contains_privilege_change_api AND contains_resource_creation_api AS has_privilege_plus_resource_creation,
    contains(actor_key, ':root') AND contains_privilege_change_api AS has_root_plus_privilege,
    contains(coalesce(ordered_event_source_sequence, ''), 'iam.amazonaws.com') AS has_iam_sequence,
    contains(coalesce(ordered_event_source_sequence, ''), 'sts.amazonaws.com') AS has_sts_sequence,
    contains(coalesce(ordered_event_source_sequence, ''), 'ec2.amazonaws.com') AS has_ec2_sequence
  FROM inc
),
lab0 AS (
  SELECT *, CAST(""" + " + ".join(
    f"CASE WHEN {column} THEN {LABEL_RULES['weights'][rule]} ELSE 0 END" for rule, column in RULE_COLUMNS.items()
) + """ AS DOUBLE) AS weak_label_score,
  concat_ws('|', """ + ", ".join(
    f"CASE WHEN {column} THEN '{rule}' END" for rule, column in RULE_COLUMNS.items()
) + """) AS rules_fired,
  concat_ws(',', """ + ", ".join(
    f"""CASE WHEN {column} THEN '{{"rule":"{rule}","weight":{float(LABEL_RULES['weights'][rule])}}}' END"""
    for rule, column in RULE_COLUMNS.items()
) + """) AS reasons
  FROM lf
),
lab AS (
  SELECT *, CASE WHEN weak_label_score >= 5 THEN 1 ELSE 0 END AS weak_label_suspicious,
    '[' || reasons || ']' AS weak_label_reasons_json
  FROM lab0
)"""


def time_text(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- event features ---------------------------------------------------------------
@query(f"WITH {FEATURES} SELECT raw_event_row_index, event_date, hour(event_time) AS event_hour_utc, "
       "dayname(event_time) AS event_day_of_week_utc, month(event_time) AS event_month_utc, "
       "coalesce(isodow(event_time) IN (6, 7), false) AS is_weekend_utc FROM feat")
def event_calendar_parts(spark: SparkSession, folder: str) -> DataFrame:
    return stages.events_flat(spark, folder).select(
        "raw_event_row_index", "event_date", "event_hour_utc", "event_day_of_week_utc", "event_month_utc",
        "is_weekend_utc")


@query(f"WITH {FEATURES} SELECT global_sort_key, actor_key, session_key FROM feat")
def event_keys(spark: SparkSession, folder: str) -> DataFrame:
    return features.with_event_keys(audit_events(spark, folder)).select("global_sort_key", "actor_key", "session_key")


@query(f"""WITH {FEATURES} SELECT global_sort_key,
  lower(coalesce(user_type, '')) = 'root' OR lower(coalesce(user_arn, '')) LIKE '%:root' AS is_root_user,
  lower(coalesce(user_type, '')) = 'assumedrole' OR contains(lower(coalesce(user_arn, '')), ':assumed-role/')
    AS is_assumed_role,
  lower(coalesce(user_type, '')) = 'iamuser' OR contains(lower(coalesce(user_arn, '')), ':user/') AS is_iam_user,
  invoked_by IS NOT NULL OR lower(coalesce(user_type, '')) IN ('awsservice', 'assumedrolebyservice', 'service')
    AS is_aws_service_call FROM feat""")
def event_identity_flags(spark: SparkSession, folder: str) -> DataFrame:
    events = features.with_event_keys(audit_events(spark, folder))
    return features.with_identity_flags(events).select(
        "global_sort_key", "is_root_user", "is_assumed_role", "is_iam_user", "is_aws_service_call")


@query(f"""WITH {FEATURES} SELECT global_sort_key, is_console_login, is_auth_related,
  coalesce(event_source, '') = 's3.amazonaws.com' AS is_s3_related,
  coalesce(event_source, '') = 'iam.amazonaws.com' AS is_iam_related,
  coalesce(event_source, '') = 'ec2.amazonaws.com' AS is_ec2_related,
  is_recon_like_api, is_privilege_change_api, is_resource_creation_api,
  is_error AS is_failed_api_call, success AS is_successful_api_call FROM feat""")
def event_behaviour_flags(spark: SparkSession, folder: str) -> DataFrame:
    events = features.with_event_keys(audit_events(spark, folder))
    return features.with_behaviour_flags(events).select(
        "global_sort_key", *features.NAME_FLAGS, *features.SOURCE_FLAGS, "is_failed_api_call",
        "is_successful_api_call")


@query(f"WITH {FEATURES} SELECT raw_event_row_index, global_sort_key FROM feat")
def canonical_event_order(spark: SparkSession, folder: str) -> DataFrame:
    events = features.with_event_keys(audit_events(spark, folder))
    return features.with_row_index(events).select("raw_event_row_index", "global_sort_key")


@query(f"""WITH {FEATURES} SELECT raw_event_row_index,
  row_number() OVER (PARTITION BY actor_key ORDER BY raw_event_row_index) AS actor_event_rank,
  row_number() OVER (PARTITION BY session_key ORDER BY raw_event_row_index) AS session_event_rank,
  row_number() OVER (PARTITION BY coalesce(source_ip_address, 'UNKNOWN_IP') ORDER BY raw_event_row_index)
    AS ip_event_rank FROM feat""")
def event_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return stages.events_flat(spark, folder).select(
        "raw_event_row_index", "actor_event_rank", "session_event_rank", "ip_event_rank")


@query(f"""WITH {FEATURES} SELECT raw_event_row_index,
  round_even((epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1000.0, 0) / 1000.0
    AS seconds_since_prev_session_event,
  coalesce(event_source = lag(event_source) OVER w, false) AS same_event_source_as_prev_session_event,
  coalesce(event_name = lag(event_name) OVER w, false) AS same_event_name_as_prev_session_event
  FROM feat WINDOW w AS (PARTITION BY session_key ORDER BY raw_event_row_index)""")
def session_steps(spark: SparkSession, folder: str) -> DataFrame:
    return stages.events_flat(spark, folder).select(
        "raw_event_row_index", "seconds_since_prev_session_event", "same_event_source_as_prev_session_event",
        "same_event_name_as_prev_session_event")


def _prior_sql() -> str:
    columns = []
    for name, (key, missing) in features.PRIOR_KEYS.items():
        for suffix, seconds in features.PRIOR_WINDOWS.items():
            columns.append(
                f"CASE WHEN event_time IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY event_time IS NULL, "
                f"coalesce({key}, '{missing}') ORDER BY raw_event_row_index) - 1 - count(*) OVER (PARTITION BY "
                f"event_time IS NULL, coalesce({key}, '{missing}') ORDER BY epoch_us(event_time) RANGE BETWEEN "
                f"UNBOUNDED PRECEDING AND {seconds * 1_000_000 + 1} PRECEDING) END AS {name}_prev_{suffix}")
    return f"WITH {FEATURES} SELECT raw_event_row_index, {', '.join(columns)} FROM feat"


@query(_prior_sql())
def prior_activity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stages.events_flat(spark, folder).select(
        "raw_event_row_index",
        *[f"{name}_prev_{suffix}" for name in features.PRIOR_KEYS for suffix in features.PRIOR_WINDOWS])


# --- incidents ---------------------------------------------------------------------
INCIDENT_TEXT = ", ".join(
    f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" if c in ("incident_start_time", "incident_end_time") else c
    for c in incidents.INCIDENT_COLUMNS)


def _incident_view(df: DataFrame) -> DataFrame:
    return df.select(*[
        time_text(c).alias(c) if c in ("incident_start_time", "incident_end_time") else F.col(c)
        for c in incidents.INCIDENT_COLUMNS])


@query(f"WITH {incident_sql(30, incidents.SPLIT)} SELECT {INCIDENT_TEXT} FROM inc")
def incidents_interleaved(spark: SparkSession, folder: str) -> DataFrame:
    return _incident_view(stages.incidents(spark, folder, 30, incidents.SPLIT))


@query(f"WITH {incident_sql(30, incidents.INDEPENDENT)} SELECT {INCIDENT_TEXT} FROM inc")
def incidents_per_actor(spark: SparkSession, folder: str) -> DataFrame:
    return _incident_view(stages.incidents(spark, folder, 30))


@query(f"WITH {CASE_INCIDENTS} SELECT {INCIDENT_TEXT} FROM inc")
def incidents_half_day_gap(spark: SparkSession, folder: str) -> DataFrame:
    return _incident_view(stages.incidents(spark, folder))


# --- labels --------------------------------------------------------------------------
@query(f"""WITH {LABELED} SELECT incident_id, actor_is_root, actor_is_assumed_role,
  round(failure_ratio, 6) AS failure_ratio, round(events_per_minute, 6) AS events_per_minute,
  has_high_failure_ratio, has_failure_burst, has_event_burst, has_broad_surface_area, has_recon_plus_privilege,
  has_recon_plus_resource_creation, has_privilege_plus_resource_creation, has_root_plus_privilege,
  has_iam_sequence, has_sts_sequence, has_ec2_sequence FROM lab""")
def label_features(spark: SparkSession, folder: str) -> DataFrame:
    return stages.labeled(spark, folder).select(
        "incident_id", "actor_is_root", "actor_is_assumed_role", F.round("failure_ratio", 6).alias("failure_ratio"),
        F.round("events_per_minute", 6).alias("events_per_minute"), "has_high_failure_ratio", "has_failure_burst",
        "has_event_burst", "has_broad_surface_area", "has_recon_plus_privilege", "has_recon_plus_resource_creation",
        "has_privilege_plus_resource_creation", "has_root_plus_privilege", "has_iam_sequence", "has_sts_sequence",
        "has_ec2_sequence")


@query(f"WITH {LABELED} SELECT incident_id, weak_label_score, weak_label_suspicious, weak_label_reasons_json FROM lab")
def weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return stages.labeled(spark, folder).select(
        "incident_id", "weak_label_score", "weak_label_suspicious", "weak_label_reasons_json")


@query(f"""WITH {LABELED} SELECT count(*) AS incident_count, CAST(sum(weak_label_suspicious) AS BIGINT) AS positive_count,
  round(avg(weak_label_suspicious), 6) AS positive_rate, CAST(5.0 AS DOUBLE) AS label_threshold, """
       + ", ".join(f"count(*) FILTER ({column}) AS hits_{rule}" for rule, column in RULE_COLUMNS.items())
       + """, min(weak_label_score) AS score_min, round(median(weak_label_score), 6) AS score_median,
  max(weak_label_score) AS score_max FROM lab""")
def weak_label_report(spark: SparkSession, folder: str) -> DataFrame:
    return labels.label_report(stages.labeled(spark, folder))


@query(f"""WITH {LABELED} SELECT CAST(round_even(weak_label_score, 0) AS BIGINT) AS score_bucket,
  round(avg(weak_label_suspicious), 6) AS positive_rate FROM lab GROUP BY 1""")
def label_rate_by_score(spark: SparkSession, folder: str) -> DataFrame:
    return labels.score_prior(stages.labeled(spark, folder))


@query(f"""WITH {LABELED} SELECT incident_id, actor_key, event_count, weak_label_score FROM lab
  ORDER BY weak_label_score DESC, event_count DESC, incident_id LIMIT 20""")
def top_suspicious_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: raw events to the highest scoring incidents."""
    return stages.labeled(spark, folder).orderBy(
        F.desc("weak_label_score"), F.desc("event_count"), "incident_id"
    ).limit(20).select("incident_id", "actor_key", "event_count", "weak_label_score")
