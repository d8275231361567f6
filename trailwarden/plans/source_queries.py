"""Queries for knowledge sources, network flows and the stream operators in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyst, features, network
from ..sources import knowledge
from ..sources.tables import read_table
from ..streaming import ingest
from . import stages
from .core_queries import CASE_INCIDENTS, FEATURES, time_text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


# --- knowledge sources ---------------------------------------------------------------
@query(r"""SELECT coalesce(lang, 'none') AS title, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS text_md5,
  'd' || doc_id || '.md::' || coalesce(lang, 'none') AS source FROM documents
UNION ALL SELECT 'Second ' || doc_id, md5('end'), 'd' || doc_id || '.md::Second ' || doc_id FROM documents""")
def pattern_document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown with two sections each; the whole text is a section body."""
    number = F.col("doc_id").cast("string")
    docs = read_table(spark, folder, "documents").select(
        F.concat(F.lit("d"), number, F.lit(".md")).alias("file"),
        F.concat(F.lit("# Top\nintro\n## "), F.coalesce("lang", F.lit("none")), F.lit("\n"), F.col("text"), F.lit("\n##  Second "), number,
                 F.lit(" \nend\n")).alias("body"))
    return knowledge.pattern_sections(docs).select("title", F.md5("text").alias("text_md5"), "source")


def _bundle_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as bundle objects: some tactics, many techniques with and without references."""
    key = F.col("p_partkey")
    ref = F.struct(F.when(key % 5 == 0, "other").otherwise("mitre-attack").alias("source_name"),
                   F.concat(F.lit("T"), (key % 700).cast("string")).alias("external_id"))
    phase = F.struct(F.col("p_brand").alias("phase_name"))
    return read_table(spark, folder, "part").select(
        key.alias("pos"), F.when(key % 4 == 0, "x-mitre-tactic").otherwise("attack-pattern").alias("type"),
        F.concat(F.lit("id-"), key.cast("string")).alias("id"),
        F.when(key % 4 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("description"),
        F.when(key % 7 != 0, F.array(phase)).alias("kill_chain_phases"),
        F.when(key % 3 != 0, F.array(ref)).alias("external_references"))


_OBJECTS = """obj AS (SELECT p_partkey AS pos, p_partkey % 4 = 0 AS is_tactic, p_name AS title, p_type AS description, p_brand AS brand,
    CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'T' || (p_partkey % 700) ELSE 'id-' || p_partkey END AS external_ref,
    CASE WHEN p_partkey % 7 <> 0 THEN p_brand ELSE 'unknown' END AS tactic FROM part),
dom AS (SELECT brand AS name, coalesce(max_by(description, pos), '') AS description FROM obj WHERE is_tactic GROUP BY brand)"""


@query(f"WITH {_OBJECTS} SELECT name, description FROM dom")
def tactic_domains(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge.tactic_domains(_bundle_objects(spark, folder)).select("name", "description")


@query(f"""WITH {_OBJECTS}, t AS (SELECT * FROM obj WHERE NOT is_tactic
  QUALIFY row_number() OVER (PARTITION BY external_ref ORDER BY pos DESC) = 1)
SELECT external_ref, title, coalesce(t.description, '') AS content, dom.name AS domain, 'threat' AS entry_type,
  CAST(0.95 AS DOUBLE) AS confidence FROM t LEFT JOIN dom ON dom.name = tactic""")
def technique_entries(spark: SparkSession, folder: str) -> DataFrame:
    objects = _bundle_objects(spark, folder)
    return knowledge.technique_entries(objects, knowledge.tactic_domains(objects)).select(
        "external_ref", "title", "content", "domain", "entry_type", "confidence")


# --- network flows ---------------------------------------------------------------------
def _flows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as network flows over seven files."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    label = F.when(flag == "A", "Benign").when(flag == "N", "Bot").when(line == 7, "Label").otherwise("Brute")
    return read_table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"), F.col("l_suppkey").cast("string").alias("dst_port"),
        F.col("l_linestatus").alias("protocol"), F.col("l_quantity").cast("long").cast("string").alias("flow_duration"),
        line.cast("string").alias("tot_fwd_pkts"), line.cast("string").alias("tot_bwd_pkts"), label.alias("label"),
        F.concat(F.lit("f"), line.cast("string"), F.lit(".csv")).alias("file_name"), F.lit(0).alias("block_start"),
        F.col("l_orderkey").alias("line_order"))


_FLOWS = """fl AS (SELECT *, 'f' || l_linenumber || '.csv' AS file_name, CASE WHEN l_returnflag = 'A' THEN 'Benign'
  WHEN l_returnflag = 'N' THEN 'Bot' WHEN l_linenumber = 7 THEN 'Label' ELSE 'Brute' END AS label FROM lineitem),
kept AS (SELECT * FROM fl WHERE label <> 'Label')"""


@query(f"""WITH {_FLOWS} SELECT (SELECT count(DISTINCT file_name) FROM fl) AS file_count, count(*) AS total_rows,
  (SELECT count(*) FROM fl WHERE label = 'Label') AS header_rows_removed, count(*) FILTER (label = 'Benign') AS benign_flow_count,
  count(*) FILTER (label <> 'Benign') AS suspicious_flow_count, round(count(*) FILTER (label <> 'Benign') / count(*), 4) AS suspicious_ratio
FROM kept""")
def network_flow_summary(spark: SparkSession, folder: str) -> DataFrame:
    return network.flow_summary(_flows(spark, folder))


@query(f"""WITH {_FLOWS} SELECT label, file_name, count(*) AS flow_count FROM kept GROUP BY label, file_name
UNION ALL SELECT label, NULL, count(*) FROM kept GROUP BY label""")
def network_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return network.flow_label_counts(_flows(spark, folder))


@query(f"""WITH {_FLOWS} SELECT strftime(l_shipdate, '%Y-%m-%d') AS timestamp, CAST(l_suppkey AS VARCHAR) AS dst_port, label
FROM kept WHERE label <> 'Benign' ORDER BY file_name, l_orderkey LIMIT 6""")
def network_suspicious_examples(spark: SparkSession, folder: str) -> DataFrame:
    return network.suspicious_examples(_flows(spark, folder)).select("timestamp", "dst_port", "label")


@query(f"""WITH {CASE_INCIDENTS}, {_FLOWS} SELECT incident_id, 'reviewed' AS network_status,
  (SELECT count(*) FROM kept WHERE label <> 'Benign') AS suspicious_flow_count FROM inc""")
def network_review_attachment(spark: SparkSession, folder: str) -> DataFrame:
    package = stages.stage(spark, folder, "network-package", lambda: network.evidence_package(_flows(spark, folder)))
    attached = network.review_attachment(stages.incidents(spark, folder).select("incident_id"), package, reviewed=True)
    return attached.select("incident_id", "network_status", "suspicious_flow_count")


# --- stream operators on bounded input ---------------------------------------------------
@query(f"""WITH {FEATURES}, s AS (SELECT *, CASE WHEN epoch_us(event_time) - epoch_us(lag(event_time) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS st
  FROM feat WHERE event_time IS NOT NULL WINDOW w AS (PARTITION BY actor_key, coalesce(source_ip_address, 'NO_IP') ORDER BY event_time, global_sort_key)),
n AS (SELECT *, sum(st) OVER (PARTITION BY actor_key, coalesce(source_ip_address, 'NO_IP') ORDER BY event_time, global_sort_key
  ROWS UNBOUNDED PRECEDING) AS no FROM s)
SELECT actor_key, coalesce(source_ip_address, 'NO_IP') AS source_ip, strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') AS incident_start_time,
  strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') AS incident_end_time, count(*) AS event_count,
  count(*) FILTER (is_error) AS error_event_count, first(event_name ORDER BY event_time, global_sort_key) AS first_event_name,
  bool_or(is_privilege_change_api) AS contains_privilege_change_api FROM n GROUP BY actor_key, coalesce(source_ip_address, 'NO_IP'), no""")
def session_window_incidents(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.inactivity_incidents(stages.events_flat(spark, folder), 30)
    return rows.select("actor_key", "source_ip", time_text("incident_start_time").alias("incident_start_time"),
                       time_text("incident_end_time").alias("incident_end_time"), "event_count", "error_event_count",
                       "first_event_name", "contains_privilege_change_api")


@query(f"""WITH {FEATURES}, w AS (SELECT actor_key AS activity_key, epoch_us(event_time) // 600000000 * 600000000 - i * 600000000 AS start_us
  FROM feat, (VALUES (0), (1), (2)) v(i) WHERE event_time IS NOT NULL)
SELECT activity_key, start_us AS window_start_us, count(*) AS event_count FROM w GROUP BY 1, 2""")
def sliding_activity_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = ingest.activity_counts(stages.events_flat(spark, folder), "actor_key", "30 minutes", "10 minutes")
    return counts.select("activity_key", F.unix_micros("window_start").alias("window_start_us"), "event_count")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS event_id, min(l_linenumber) AS record_index_in_file FROM lineitem GROUP BY l_orderkey")
def distinct_event_ids(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("event_id"), F.lit("f").alias("source_file_name"),
        F.col("l_linenumber").alias("record_index_in_file"))
    return ingest.drop_duplicate_events(items).select("event_id", "record_index_in_file")


# --- sanity slice ---------------------------------------------------------------------------
@query(f"""WITH {CASE_INCIDENTS} SELECT raw_event_row_index, global_sort_key, (SELECT count(*) FROM feat) AS event_rows,
  (SELECT count(*) FROM inc) AS incident_rows FROM feat ORDER BY raw_event_row_index LIMIT 5""")
def sanity_slice(spark: SparkSession, folder: str) -> DataFrame:
    return analyst.sanity_slice(
        stages.events_flat(spark, folder), stages.incidents(spark, folder), [F.col(features.INDEX)],
        ["raw_event_row_index", "global_sort_key"])
