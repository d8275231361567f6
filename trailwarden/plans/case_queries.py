"""Queries for retrieval, triage, case history and operator views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import casework, retrieval, triage, views
from ..rules import ACTIONS, PATTERN_QUERY_PHRASES, PATTERN_TITLES, RULE_COLUMNS, SIGNAL_EXPLANATIONS, TIMELINE_PHRASES
from ..sources import knowledge
from ..sources.tables import read_table
from . import stages
from .core_queries import CASE_INCIDENTS, LABELED, time_text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def piped(column) -> F.Column:
    return F.array_join(column, "|")


# --- retrieval --------------------------------------------------------------------------
_TOKENS = r"regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}')"
_TERMS = """{name}_tok AS (SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (
    SELECT id, """ + _TOKENS + """ AS toks FROM {name}_src)),
{name}_terms AS (
  SELECT id, term, count(*) AS tf FROM (
    SELECT id, tok AS term FROM {name}_tok
    UNION ALL SELECT a.id, a.tok || ' ' || b.tok FROM {name}_tok a JOIN {name}_tok b ON a.id = b.id AND b.i = a.i + 1)
  GROUP BY id, term)"""

TFIDF = """d_src AS (SELECT doc_id AS id, text AS body FROM documents),
""" + _TERMS.replace("{name}", "d") + """,
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM (
  SELECT term, sum(tf) AS total, count(*) AS df FROM d_terms GROUP BY term)),
dw AS (SELECT id, term, tf * idf AS w FROM d_terms JOIN vocab USING (term)),
idx AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM dw)"""


@query("WITH " + TFIDF + """ SELECT id AS doc_id, count(*) AS terms, round(max(weight), 6) AS top_weight,
  round(sum(weight), 4) AS total_weight FROM idx GROUP BY id""")
def tfidf_document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieval.tfidf_index(read_table(spark, folder, "documents"), "doc_id", "text")
    return retrieval.document_vectors(index).select(
        "doc_id", "terms", F.round("top_weight", 6).alias("top_weight"), F.round("total_weight", 4).alias("total_weight"))


@query("WITH " + TFIDF + r""", q_src AS (SELECT item_id AS id,
  trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g')) AS body FROM benchmark), """
       + _TERMS.replace("{name}", "q") + """,
qw AS (SELECT id, term, tf * idf AS w FROM q_terms JOIN vocab USING (term)),
qn AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS qw FROM qw),
sc AS (SELECT qn.id AS query_id, idx.id AS doc_id, round(sum(qw * weight), 6) AS score
  FROM qn JOIN idx USING (term) GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, doc_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit_rank FROM sc WHERE score > 0)
WHERE hit_rank <= 5""")
def knowledge_search(spark: SparkSession, folder: str) -> DataFrame:
    index = retrieval.tfidf_index(read_table(spark, folder, "documents"), "doc_id", "text")
    return retrieval.search(index, read_table(spark, folder, "benchmark"), "item_id", "text", k=5)


@query(f"WITH {LABELED} SELECT incident_id, concat_ws(' ', top_event_name, first_event_name, last_event_name, "
       + ", ".join(f"CASE WHEN {flag} THEN '{text}' END" for flag, text in PATTERN_QUERY_PHRASES.items())
       + ") AS pattern_query, concat_ws('|', "
       + ", ".join(f"CASE WHEN {flag} THEN '{text}' END" for flag, text in PATTERN_TITLES.items())
       + ") AS pattern_titles FROM lab")
def incident_pattern_queries(spark: SparkSession, folder: str) -> DataFrame:
    return stages.labeled(spark, folder).select(
        "incident_id", retrieval.pattern_query().alias("pattern_query"),
        piped(retrieval.pattern_titles()).alias("pattern_titles"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url || ' 10.2.3.4:8080 2024-01-02T03:04:05Z ' || html,
      '\b\d{1,3}(?:\.\d{1,3}){3}\b', '', 'g'), ':\d{2,5}\b', '', 'g'), '\d{4}-\d{2}-\d{2}T[\d:Z.]+', '', 'g') AS a,
    regexp_replace(url || ' ' || html, '[^A-Za-z0-9_\s]', '', 'g') AS b,
    regexp_replace(url || ' ' || html, '[^\p{L}\p{N}\s]', ' ', 'g') AS c FROM pages),
t AS (SELECT page_id, 'a' AS kind, unnest(string_split_regex(trim(a), '\s+')) AS tok, 3 AS least FROM p
  UNION ALL SELECT page_id, 'b', unnest(string_split_regex(trim(b), '\s+')), 2 FROM p
  UNION ALL SELECT page_id, 'c', unnest(string_split_regex(trim(c), '\s+')), 3 FROM p)
SELECT page_id, kind, count(*) AS tokens, min(tok) AS first_token, max(tok) AS last_token,
  CAST(sum(strlen(tok)) AS BIGINT) AS bytes FROM t WHERE length(tok) > least GROUP BY page_id, kind""")
def keyword_normalization(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    text = F.concat_ws(" ", "url", "html")
    alert = F.concat(F.col("url"), F.lit(" 10.2.3.4:8080 2024-01-02T03:04:05Z "), F.col("html"))
    long = pages.select("page_id", F.inline(F.array(
        F.struct(F.lit("a").alias("kind"), retrieval.alert_keywords(alert).alias("toks")),
        F.struct(F.lit("b").alias("kind"), retrieval.search_keywords(text).alias("toks")),
        F.struct(F.lit("c").alias("kind"), retrieval.context_keywords(text).alias("toks")))))
    return long.select("page_id", "kind", F.explode("toks").alias("tok")).groupBy("page_id", "kind").agg(
        F.count("*").alias("tokens"), F.min("tok").alias("first_token"), F.max("tok").alias("last_token"),
        F.sum(F.octet_length("tok")).alias("bytes"))


@query(r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
w AS (SELECT DISTINCT item_id AS query_id, term FROM (
  SELECT item_id, unnest(regexp_extract_all(lower(tok), '[\p{L}\p{N}_]{2,}')) AS term FROM (
    SELECT item_id, unnest(string_split_regex(trim(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g')), '\s+')) AS tok
    FROM benchmark) WHERE length(tok) > 3)),
n AS (SELECT query_id, count(*) AS n FROM w GROUP BY 1),
m AS (SELECT query_id, doc_id, count(*) AS found, round(sum(ln(1.0 + tf)), 6) AS score
  FROM w JOIN post USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score, hit_rank FROM (SELECT query_id, doc_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS hit_rank
  FROM m JOIN n USING (query_id) WHERE found = n) WHERE hit_rank <= 5""")
def keyword_and_search(spark: SparkSession, folder: str) -> DataFrame:
    queries = read_table(spark, folder, "benchmark").withColumn("keywords", retrieval.context_keywords(F.col("text")))
    return retrieval.and_search(read_table(spark, folder, "documents"), "doc_id", "text", queries, "item_id", "keywords")


@query("""SELECT c_custkey AS entry_id, c_name AS title, n_name AS domain FROM customer
  LEFT JOIN nation ON n_nationkey = CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END""")
def entries_with_domain(spark: SparkSession, folder: str) -> DataFrame:
    domains = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("domain_id"), F.col("n_name").alias("domain"))
    entries = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("title"),
        F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("domain_id"))
    return retrieval.with_domain(entries, domains).select("entry_id", "title", "domain")


@query("SELECT p_name AS title FROM part WHERE p_name ILIKE '%RING%' ORDER BY p_name LIMIT 1")
def technique_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.technique_by_name(read_table(spark, folder, "part").select(F.col("p_name").alias("title")), "RING")


@query("SELECT n_name AS name FROM nation ORDER BY n_name")
def tactic_list(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.tactic_list(read_table(spark, folder, "nation").select(F.col("n_name").alias("name")))


@query("""SELECT coalesce(source, '') AS title, coalesce(lang, 'none') || '::' || doc_id AS source, 'feature' AS kb_type,
  md5(lower(coalesce(source, '') || ' ' || coalesce(text, ''))) AS fulltext_md5 FROM documents
UNION ALL SELECT 'passage', 'bench::' || item_id, 'pattern', md5(lower('passage ' || coalesce(text, ''))) FROM benchmark""")
def knowledge_base_rows(spark: SparkSession, folder: str) -> DataFrame:
    features = read_table(spark, folder, "documents").select(
        F.col("source").alias("title"), "text",
        F.concat_ws("::", F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")).alias("source"),
        F.lit("feature").alias("kb_type"))
    patterns = read_table(spark, folder, "benchmark").select(
        F.lit("passage").alias("title"), "text", F.concat_ws("::", F.lit("bench"), F.col("item_id").cast("string")).alias("source"),
        F.lit("pattern").alias("kb_type"))
    return knowledge.knowledge_base(features, patterns).select(
        "title", "source", "kb_type", F.md5("fulltext").alias("fulltext_md5"))


@query("""SELECT conv_id AS query_id, role AS title, text AS source, min(turn) AS hit_rank FROM conversations
  GROUP BY conv_id, role, text""")
def deduplicated_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("role").alias("title"), F.col("text").alias("source"),
        F.col("turn").alias("hit_rank"))
    return retrieval.dedupe_hits(hits)


# --- triage ---------------------------------------------------------------------------------
def cases(spark: SparkSession, folder: str) -> DataFrame:
    risk = F.least(F.col("weak_label_score") / 20.0, F.lit(1.0))
    return stages.stage(spark, folder, "decision-inputs", lambda: triage.decision_inputs(stages.labeled(spark, folder), risk))


def triaged(spark: SparkSession, folder: str) -> DataFrame:
    return stages.stage(spark, folder, "triage-results", lambda: triage.triage(cases(spark, folder)))


def reviewed(spark: SparkSession, folder: str) -> DataFrame:
    return stages.stage(spark, folder, "coverage-reviews", lambda: triage.coverage_review(triaged(spark, folder)))


CASES = LABELED + """,
cases AS (
  SELECT *, least(weak_label_score / 20.0, 1.0) AS risk_score,
    'Incident centered on ' || coalesce(nullif(top_event_name, ''), 'unknown activity') AS title,
    'Actor ' || actor_key || ' produced ' || event_count || ' events.' AS summary,
    concat_ws('|', """ + ", ".join(f"CASE WHEN {f} THEN '{t}' END" for f, t in PATTERN_TITLES.items()) + """) AS patterns,
    coalesce(resource_types_seen, '') <> '' AS has_res, coalesce(user_agents_seen, '') <> '' AS has_ag
  FROM lab
),
cov AS (
  SELECT *, CASE WHEN risk_score >= 0.75 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_band,
    CASE WHEN has_res OR has_ag THEN 'medium' ELSE 'low' END AS completeness_level,
    concat_ws('|', 'Network telemetry was not checked.',
      CASE WHEN NOT has_res THEN 'No resource summary was available for this incident.' END,
      CASE WHEN NOT has_ag THEN 'User-agent context was missing.' END) AS incompleteness_reasons
  FROM cases
),
acts AS (
  SELECT *, CAST(round(CASE action_id
      WHEN 'continue_monitoring' THEN 1.0 - risk_score - 0.1
      WHEN 'collect_more_evidence' THEN CASE WHEN completeness_level = 'low' THEN 2.0 ELSE 0.5 END - 0.1
      WHEN 'escalate_to_expert' THEN CASE WHEN completeness_level = 'low' THEN 1.5 ELSE 0.5 END - 0.1
      WHEN 'reset_credentials' THEN CASE WHEN contains_privilege_change_api OR actor_is_root
          OR contains(lower(patterns), 'privilege') THEN 2.5 ELSE 0.0 END + risk_score
        - CASE WHEN completeness_level = 'low' THEN 1.5 ELSE 0.0 END - 0.3
      ELSE CASE WHEN risk_score >= 0.7 THEN 2.0 ELSE 0.0 END
        + CASE WHEN contains(lower(patterns), 'resource creation') OR contains(lower(patterns), 'root') THEN 1.5 ELSE 0.0 END
        - CASE WHEN completeness_level = 'low' THEN 1.5 ELSE 0.0 END - 0.3 END, 6) AS DOUBLE) AS score
  FROM cov CROSS JOIN (VALUES """ + ", ".join(f"('{a}')" for a in ACTIONS) + """) a(action_id)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, action_id) AS rn FROM acts),
alt AS (SELECT incident_id, string_agg(action_id, '|' ORDER BY rn) AS alternatives FROM ranked
  WHERE rn BETWEEN 2 AND 4 GROUP BY incident_id),
tri AS (
  SELECT r.*, alt.alternatives, CASE action_id """ + " ".join(
    f"WHEN '{a}' THEN '{m['label']}'" for a, m in ACTIONS.items()) + """ END AS label,
    CASE action_id """ + " ".join(f"WHEN '{a}' THEN '{m['reason']}'" for a, m in ACTIONS.items()) + """ END AS reason,
    action_id IN ('reset_credentials', 'temporary_access_lock') AS needs_approval,
    CASE WHEN completeness_level = 'low'
      THEN 'This recommendation may be incomplete because key checks or sources are missing.'
      ELSE 'This recommendation may be incomplete.' END AS warning
  FROM ranked r JOIN alt USING (incident_id) WHERE rn = 1
)"""


@query(f"WITH {CASES} SELECT incident_id, title, summary, round(risk_score, 6) AS risk_score, risk_band, "
       "rules_fired AS detector_labels, patterns AS retrieved_patterns, completeness_level, incompleteness_reasons FROM cov")
def decision_inputs(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select(
        "incident_id", "title", "summary", F.round("risk_score", 6).alias("risk_score"), "risk_band",
        piped("detector_labels").alias("detector_labels"), piped("retrieved_patterns").alias("retrieved_patterns"),
        "completeness_level", piped("incompleteness_reasons").alias("incompleteness_reasons"))


@query(f"WITH {CASES} SELECT incident_id, action_id, label, score, alternatives, warning, "
       "incompleteness_reasons || '|Missing source: network_logs' AS reasons FROM tri")
def recommended_actions(spark: SparkSession, folder: str) -> DataFrame:
    return triaged(spark, folder).select(
        "incident_id", "recommended_action.action_id", "recommended_action.label",
        F.round("recommended_score", 6).alias("score"),
        piped(F.transform("alternative_actions", lambda a: a["action_id"])).alias("alternatives"),
        F.col("completeness_warning").alias("warning"), piped("completeness_reasons").alias("reasons"))


@query(f"""WITH {CASES} SELECT incident_id,
  title || ' is currently assessed as ' || risk_band || ' risk. The recommended next step is ' || lower(label)
    || ' because ' || lower(reason) || ' ' || warning AS operator_summary,
  concat_ws('|', 'Review network_logs', CASE WHEN NOT has_res THEN 'Review resource_summary' END,
    CASE WHEN NOT has_ag THEN 'Review user_agent_context' END, 'Review network_logs if available') AS review_candidates
FROM tri""")
def operator_guidance(spark: SparkSession, folder: str) -> DataFrame:
    return triaged(spark, folder).select(
        "incident_id", "operator_summary", piped("review_candidates").alias("review_candidates"))


@query(f"""WITH {CASES}, s AS (SELECT *, string_split(rules_fired, '|') AS rs FROM tri)
SELECT incident_id, 'compromised_identity' AS hypothesis_id, 'medium' AS confidence,
  CASE WHEN rules_fired = '' THEN 'Elevated detector signals' ELSE array_to_string(list_slice(rs, 1, 2), '|') END AS supporting FROM s
UNION ALL SELECT incident_id, 'misconfigured_automation', CASE WHEN contains_privilege_change_api THEN 'low' ELSE 'medium' END,
  concat_ws('|', 'Repeated or bursty control-plane activity', nullif(string_split(patterns, '|')[1], '')) FROM s
UNION ALL SELECT incident_id, 'high_privilege_operator_activity', 'medium', 'Root or high-privilege activity was observed'
FROM s WHERE actor_is_root OR contains(lower(patterns), 'root')""")
def incident_hypotheses(spark: SparkSession, folder: str) -> DataFrame:
    rows = triaged(spark, folder).select("incident_id", F.explode("hypotheses").alias("h"))
    return rows.select("incident_id", "h.hypothesis_id", "h.confidence", piped("h.supporting_evidence").alias("supporting"))


@query(f"""WITH {CASES} SELECT incident_id,
  concat_ws('|', CASE WHEN has_ag THEN 'identity=checked_signal_found' ELSE 'identity=data_unavailable' END,
    'network=not_checked', CASE WHEN has_res THEN 'resource_activity=checked_signal_found'
      ELSE 'resource_activity=data_unavailable' END) AS coverage,
  warning || CASE WHEN needs_approval THEN ' ' || upper(label[1]) || lower(label[2:]) ||
    ' should be reviewed carefully because it is a disruptive action.'
    ELSE ' Review missing checks before relying on ' || lower(label) || '.' END AS risk_note,
  concat_ws('|', 'If network_logs shows additional suspicious activity, the recommended action may need to change.',
    'Completing review network_logs could confirm or weaken the current recommendation.',
    CASE WHEN NOT has_res THEN 'Completing review resource_summary could confirm or weaken the current recommendation.' END,
    CASE WHEN NOT has_ag THEN 'Completing review user_agent_context could confirm or weaken the current recommendation.' END,
    CASE WHEN has_res OR has_ag THEN 'Completing review network_logs if available could confirm or weaken the current recommendation.' END,
    CASE WHEN needs_approval THEN 'If the missing checks do not support elevated misuse, a lower-disruption alternative may be safer.' END)
    AS hints FROM tri""")
def coverage_reviews(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviewed(spark, folder)
    return rows.select(
        "incident_id",
        piped(F.transform("coverage_status_by_category", lambda r: F.concat_ws("=", r["category"], r["status"]))).alias("coverage"),
        F.col("decision_risk_note").alias("risk_note"), piped("what_could_change_the_decision").alias("hints"))


@query(f"""WITH {CASES} SELECT count(*) AS results, CAST(0 AS BIGINT) AS invalid,
  count(*) FILTER (warning IS NOT NULL) AS possibly_incomplete FROM tri""")
def triage_result_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = reviewed(spark, folder)
    return rows.agg(F.count("*").alias("results"), F.count_if(F.size("result_errors") > 0).alias("invalid"),
                    F.count_if("recommendation_may_be_incomplete").alias("possibly_incomplete"))


@query(f"""WITH {CASES}, again AS (SELECT * REPLACE (
    CASE WHEN NOT has_res THEN 'low' ELSE completeness_level END AS completeness_level,
    CASE WHEN has_res THEN 0.95 ELSE risk_score END AS risk_score) FROM cov),
acts2 AS (""" + CASES.split("acts AS (")[1].split("\n),\nranked")[0].replace("FROM cov", "FROM again") + """),
new AS (SELECT incident_id, first(action_id ORDER BY score DESC, action_id) AS second_action_id FROM acts2 GROUP BY incident_id)
SELECT incident_id, action_id AS first_action_id, second_action_id, action_id <> second_action_id AS decision_changed
FROM tri JOIN new USING (incident_id)""")
def double_checked_decisions(spark: SparkSession, folder: str) -> DataFrame:
    first = cases(spark, folder)
    has_resources = F.coalesce(F.col("resource_types_seen"), F.lit("")) != ""
    late = first.select(
        "incident_id", F.when(~has_resources, "low").alias("completeness_level"),
        F.when(has_resources, 0.95).alias("risk_score"))
    again = triage.double_check(first, late)
    return again.select("incident_id", "first_action_id",
                        F.col("recommended_action.action_id").alias("second_action_id"), "decision_changed")


# --- lookups and case tables ---------------------------------------------------------------
@query(f"WITH {CASE_INCIDENTS} SELECT incident_id, actor_key, event_count FROM inc WHERE incident_id = 'incident_000000042'")
def incident_by_id(spark: SparkSession, folder: str) -> DataFrame:
    found = casework.incident_by_id(stages.incidents(spark, folder), "incident_000000042")
    return found.select("incident_id", "actor_key", "event_count")


@query(f"WITH {CASE_INCIDENTS} SELECT incident_id, actor_key, primary_source_ip_address FROM inc "
       "WHERE primary_source_ip_address = '10.0.0.1' AND actor_key = 'arn:aws:iam::1:user/9' "
       "ORDER BY incident_start_time NULLS LAST, incident_id LIMIT 1")
def earliest_matching_incident(spark: SparkSession, folder: str) -> DataFrame:
    found = casework.earliest_matching(stages.incidents(spark, folder), "10.0.0.1", "arn:aws:iam::1:user/9")
    return found.select("incident_id", "actor_key", "primary_source_ip_address")


def _case_table(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as stored incidents."""
    orders = read_table(spark, folder, "orders")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "High").when(
        F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("incident_id"), severity.alias("severity_hint"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("timestamp")).alias("updated_at"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


_CASE_TABLE = """ct AS (SELECT CAST(o_orderkey AS VARCHAR) AS incident_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'High'
    WHEN o_orderpriority LIKE '2%' THEN 'medium' ELSE 'low' END AS severity_hint,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS updated_at, o_orderdate AS created_at FROM orders)"""


@query(f"""WITH {_CASE_TABLE}, n AS (SELECT max(created_at) AS now FROM ct)
SELECT incident_id, strftime(coalesce(updated_at, created_at), '%Y-%m-%d') AS touched FROM ct, n
WHERE severity_hint = 'High' AND coalesce(updated_at, created_at, now) >= now - INTERVAL 720 HOUR
ORDER BY coalesce(updated_at, created_at) DESC, incident_id DESC LIMIT 100""")
def recent_high_severity_cases(spark: SparkSession, folder: str) -> DataFrame:
    stored = _case_table(spark, folder)
    newest = stored.agg(F.max("created_at").alias("now")).scalar()
    found = casework.recent_high_severity(stored, newest, 720, 100)
    return found.select("incident_id", F.date_format(F.coalesce("updated_at", "created_at"), "yyyy-MM-dd").alias("touched"))


@query(f"""WITH {_CASE_TABLE} SELECT incident_id, severity_hint FROM ct
ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, incident_id DESC LIMIT 25""")
def stored_incident_list(spark: SparkSession, folder: str) -> DataFrame:
    return casework.incident_list(_case_table(spark, folder)).select("incident_id", "severity_hint")


@query(f"""WITH {LABELED} SELECT incident_id, weak_label_score AS ml_suspicion_proba FROM lab
WHERE weak_label_suspicious = 1 ORDER BY weak_label_score DESC, incident_id""")
def suspicious_incidents_first(spark: SparkSession, folder: str) -> DataFrame:
    scored = stages.labeled(spark, folder).select(
        "incident_id", F.col("weak_label_score").alias("ml_suspicion_proba"),
        F.col("weak_label_suspicious").alias("ml_suspicion_pred"))
    return casework.suspicious_first(scored).select("incident_id", "ml_suspicion_proba")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as records that belong to a customer's case."""
    return read_table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("incident_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("report_kind"),
        F.col("o_totalprice").alias("amount"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS incident_id, o_orderkey AS row_id, o_totalprice AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_record_per_incident(spark: SparkSession, folder: str) -> DataFrame:
    newest = casework.latest(_history(spark, folder), ["incident_id"], ["created_at", "row_id"])
    return newest.select("incident_id", "row_id", "amount")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS incident_id, o_orderstatus AS report_kind, o_orderkey AS row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def latest_report_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    newest = casework.latest(_history(spark, folder), ["incident_id", "report_kind"], ["created_at", "row_id"])
    return newest.select("incident_id", "report_kind", "row_id")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS incident_id, recency, o_orderkey AS row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency FROM orders)
WHERE recency <= 10""")
def latest_ten_records(spark: SparkSession, folder: str) -> DataFrame:
    recent = casework.latest_n(_history(spark, folder), ["incident_id"], ["created_at", "row_id"], 10)
    return recent.select("incident_id", F.col("recency").cast("long").alias("recency"), "row_id")


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers read as policy snapshots."""
    return read_table(spark, folder, "supplier").select(
        F.col("s_name").alias("policy_version"), F.col("s_nationkey").cast("long").alias("created_at"))


@query("""SELECT 'latest' AS which, s_name AS policy_version FROM (SELECT * FROM supplier ORDER BY s_nationkey DESC, s_name DESC LIMIT 1)
UNION ALL SELECT 'named', s_name FROM supplier WHERE s_name = 'Supplier#000000003'""")
def policy_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    stored = _policies(spark, folder)
    named = casework.policy_snapshot(stored, "Supplier#000000003")
    return casework.policy_snapshot(stored).select(F.lit("latest").alias("which"), "policy_version").unionByName(
        named.select(F.lit("named").alias("which"), "policy_version"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS incident_id, coalesce(o_totalprice, c_acctbal) AS amount FROM customer
LEFT JOIN (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn
  FROM orders) ON o_custkey = c_custkey AND rn = 1
UNION ALL SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR), max_by(o_totalprice, o_orderkey) FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey)""")
def upserted_cases(spark: SparkSession, folder: str) -> DataFrame:
    current = read_table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("incident_id"), F.col("c_acctbal").alias("amount"))
    return casework.upsert(current, _history(spark, folder), ["incident_id"], "row_id")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS dedupe_key, min(o_orderkey) AS row_id FROM orders
WHERE o_custkey NOT IN (SELECT CASE WHEN c_nationkey % 2 = 0 THEN c_custkey ELSE -c_custkey END FROM customer) GROUP BY o_custkey""")
def inserted_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    current = read_table(spark, folder, "customer").select(  # every other nation's customers have keys of their own
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).cast("string").alias("dedupe_key"))
    incoming = _history(spark, folder).select("row_id", F.col("incident_id").alias("dedupe_key"))
    return casework.insert_if_absent(current, incoming, "dedupe_key").select("dedupe_key", "row_id")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders),
inc AS (SELECT * FROM h WHERE o_orderstatus = 'F')
SELECT CAST(o_custkey AS VARCHAR) AS incident_id, o_orderkey AS row_id FROM h
WHERE o_custkey NOT IN (SELECT o_custkey FROM inc) UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderkey FROM inc""")
def replaced_by_incident(spark: SparkSession, folder: str) -> DataFrame:
    rows = _history(spark, folder)
    incoming = rows.where("report_kind = 'F'").select("incident_id", "row_id")
    return casework.replace_by_key(rows.select("incident_id", "row_id"), incoming, "incident_id")


@query("""SELECT doc_id, source, external_ref FROM (SELECT doc_id, source, CASE WHEN n_chars % 3 <> 0 THEN 'T' || n_chars END AS external_ref FROM documents)
WHERE NOT (source = 'src3' AND external_ref IS NULL) OR source IS NULL""")
def purged_knowledge_rows(spark: SparkSession, folder: str) -> DataFrame:
    entries = read_table(spark, folder, "documents").select(
        "doc_id", "source", F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("T"), F.col("n_chars").cast("string"))).alias("external_ref"))
    return knowledge.purge_unreferenced(entries, "src3")


# --- context ------------------------------------------------------------------------------------
@query(f"""WITH {CASE_INCIDENTS}, m AS (
  SELECT 'incident_' || lpad(CAST(CAST(island AS BIGINT) AS VARCHAR), 9, '0') AS incident_id,
    row_number() OVER (PARTITION BY island ORDER BY pos) - 1 AS event_index, raw_event_row_index, event_id, event_name FROM isl)
SELECT incident_id, event_index, raw_event_row_index, event_id, event_name FROM m WHERE event_index < 50""")
def incident_member_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = casework.member_events(stages.incidents(spark, folder), stages.events_flat(spark, folder))
    return rows.select("incident_id", F.col("event_index").cast("long").alias("event_index"), "raw_event_row_index",
                       "event_id", "event_name")


@query("""SELECT conv_id AS incident_id, turn AS event_index, role AS event_name FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 3""")
def ordered_members(spark: SparkSession, folder: str) -> DataFrame:
    members = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("incident_id"), F.col("turn").alias("event_index"), F.lit(None).cast("timestamp").alias("event_time"),
        F.col("text").alias("event_id"), F.col("role").alias("event_name"))
    return casework.members_in_order(members, 3).select("incident_id", "event_index", "event_name")


def _bundle(spark: SparkSession, folder: str) -> DataFrame:
    customers = read_table(spark, folder, "customer")
    incidents = customers.select(
        F.col("c_custkey").cast("string").alias("incident_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"), F.lit("").alias("summary"))
    rows = _history(spark, folder)
    evidence = rows.where("report_kind = 'P'").withColumns({
        "title": F.concat(F.lit("order "), F.col("row_id").cast("string")), "summary": F.lit(None).cast("string")})
    return casework.context_bundle(
        incidents, evidence, rows.where("report_kind = 'F'"), rows.where("report_kind = 'O'"), rows)


_LATEST = """(SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS row_id FROM orders WHERE {} GROUP BY 1)"""
_BUNDLE = f"""b AS (SELECT CAST(c_custkey AS VARCHAR) AS incident_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title,
  e.row_id AS evidence_id, d.row_id AS detector_id, v.row_id AS coverage_id, s.row_id AS decision_id FROM customer
  LEFT JOIN {_LATEST.format("o_orderstatus = 'P'")} e ON e.o_custkey = c_custkey
  LEFT JOIN {_LATEST.format("o_orderstatus = 'F'")} d ON d.o_custkey = c_custkey
  LEFT JOIN {_LATEST.format("o_orderstatus = 'O'")} v ON v.o_custkey = c_custkey
  LEFT JOIN {_LATEST.format("true")} s ON s.o_custkey = c_custkey)"""


@query(f"WITH {_BUNDLE} SELECT *, evidence_id IS NOT NULL AS has_evidence, detector_id IS NOT NULL AS has_detector FROM b")
def incident_context_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder).select(
        "incident_id", "title", F.col("evidence_package.row_id").alias("evidence_id"),
        F.col("detector_result.row_id").alias("detector_id"), F.col("coverage_assessment.row_id").alias("coverage_id"),
        F.col("decision_support_result.row_id").alias("decision_id"), F.col("has_evidence_package").alias("has_evidence"),
        F.col("has_detector_result").alias("has_detector"))


@query(f"""WITH {_BUNDLE} SELECT incident_id,
  coalesce(title, 'order ' || evidence_id, 'Incident ' || incident_id) AS title, 'Stored incident context' AS summary,
  CASE WHEN detector_id IS NULL THEN 'Detector result not found' WHEN coverage_id IS NULL THEN 'Coverage assessment not found' END
    AS missing_part FROM b""")
def assembled_decision_inputs(spark: SparkSession, folder: str) -> DataFrame:
    ready, rejected = casework.assemble_inputs(_bundle(spark, folder))
    columns = ["incident_id", "title", "summary", "missing_part"]
    return ready.select(*columns).unionByName(rejected.select(*columns))


# --- decisions, alerts, reports ---------------------------------------------------------------------
def _requests(spark: SparkSession, folder: str) -> DataFrame:
    number = F.substring("incident_id", 10, 9).cast("long")
    kinds = ["approve_recommendation", "choose_alternative", "escalate", "request_more_analysis"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (number % 4 + 1).cast("int"))
    return stages.incidents(spark, folder).select(
        "incident_id", kind.alias("decision_type"), F.lit("continue_monitoring").alias("action_id"),
        F.when(number % 3 == 0, "seen & <checked>").alias("rationale"), (number % 5 == 0).alias("used_double_check"),
        F.when(number % 7 == 0, "op-7").alias("actor"), F.timestamp_seconds(number).alias("created_at"))


_DECISIONS = CASES + """,
req AS (SELECT *, CAST(substr(incident_id, 10) AS BIGINT) AS number FROM tri),
dec AS (
  SELECT *, CASE number % 4 WHEN 0 THEN 'approve_recommendation' WHEN 1 THEN 'choose_alternative' WHEN 2 THEN 'escalate'
      ELSE 'request_more_analysis' END AS decision_type,
    CASE number % 4 WHEN 0 THEN 'recommended' WHEN 1 THEN 'alternative' WHEN 2 THEN 'manual' ELSE 'double_check' END AS selected_from,
    CASE number % 4 WHEN 0 THEN action_id WHEN 1 THEN CASE WHEN contains(alternatives, 'continue_monitoring') THEN 'continue_monitoring' END
      WHEN 2 THEN 'escalate_to_expert' ELSE 'collect_more_evidence' END AS chosen_action_id,
    CASE WHEN number % 3 = 0 THEN 'seen & <checked>' END AS rationale, number % 5 = 0 AS used_double_check,
    CASE WHEN number % 7 = 0 THEN 'op-7' END AS actor,
    warning || CASE WHEN needs_approval THEN ' ' || upper(label[1]) || lower(label[2:]) ||
      ' should be reviewed carefully because it is a disruptive action.'
      ELSE ' Review missing checks before relying on ' || lower(label) || '.' END AS risk_note
  FROM req
)"""


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return casework.apply_decisions(_requests(spark, folder), reviewed(spark, folder))


@query(f"WITH {_DECISIONS} SELECT incident_id, decision_type, selected_from, chosen_action_id, rationale, used_double_check, "
       "actor, chosen_action_id IS NULL AS rejected FROM dec")
def operator_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder).select(
        "incident_id", "decision_type", "selected_from", "chosen_action_id", "rationale", "used_double_check", "actor", "rejected")


@query(f"""WITH {_DECISIONS} SELECT incident_id, CASE WHEN number % 4 = 0 THEN 'approval_report_generated' ELSE 'double_check_requested' END
  AS event_type, CASE WHEN number % 4 = 3 THEN risk_note END AS decision_risk_note FROM dec WHERE number % 4 IN (0, 3)""")
def decision_review_events(spark: SparkSession, folder: str) -> DataFrame:
    return casework.decision_events(_decisions(spark, folder)).select("incident_id", "event_type", "decision_risk_note")


def _order_decisions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _history(spark, folder)
    decisions = rows.where("report_kind <> 'P'").select(
        "incident_id", "created_at", "row_id", F.concat(F.lit("choose_"), F.lower("report_kind")).alias("decision_type"),
        F.lit(None).cast("string").alias("chosen_action_label"),
        F.when(F.col("row_id") % 2 == 0, "act").alias("chosen_action_id"), (F.col("row_id") % 3 == 0).alias("used_double_check"),
        F.when(F.col("row_id") % 5 == 0, "because").alias("rationale"))
    events = rows.where("report_kind = 'P'").select(
        "incident_id", "created_at", "row_id", F.lit("double_check_requested").alias("event_type"),
        F.when(F.col("row_id") % 2 == 0, "noted").alias("decision_risk_note"))
    return decisions, events


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS ev, row_number() OVER (
    PARTITION BY o_custkey, o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS incident_id, count(*) FILTER (NOT ev) AS decisions, count(*) FILTER (ev) AS events,
  max(o_orderkey) FILTER (NOT ev AND n = 1) AS latest_id FROM r WHERE n <= 10 GROUP BY o_custkey""")
def operator_history(spark: SparkSession, folder: str) -> DataFrame:
    decisions, events = _order_decisions(spark, folder)
    history = casework.operator_history(decisions, events, ["created_at", "row_id"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return history.select(
        "incident_id", F.greatest(size("recent_decisions"), F.lit(0).cast("long")).alias("decisions"),
        F.greatest(size("review_events"), F.lit(0).cast("long")).alias("events"), F.col("latest_decision.row_id").alias("latest_id"))


@query("""WITH r AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS part,
    CASE WHEN o_orderstatus = 'P' THEN 'Double Check Requested' ELSE 'Choose ' || o_orderstatus END AS title,
    CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'noted' ELSE 'Additional review context recorded.' END
      ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'act' ELSE 'Decision recorded' END
        || CASE WHEN o_orderkey % 3 = 0 THEN ' after double check' ELSE '' END
        || CASE WHEN o_orderkey % 5 = 0 THEN '. Rationale: because' ELSE '' END END AS detail FROM orders)
SELECT * FROM (SELECT CAST(o_custkey AS VARCHAR) AS incident_id, row_number() OVER (PARTITION BY o_custkey
    ORDER BY part, o_orderdate DESC, o_orderkey DESC) AS position, title, detail FROM r) WHERE position <= 8""")
def audit_feed(spark: SparkSession, folder: str) -> DataFrame:
    decisions, events = _order_decisions(spark, folder)
    feed = views.audit_feed(decisions, events, ["created_at", "row_id"])
    return feed.select("incident_id", F.col("position").cast("long").alias("position"), "title", "detail")


RECIPIENTS = ["soc@example.com", "lead@example.com"]


@query(f"""WITH {CASES}, sent AS (SELECT incident_id || ':high_priority_email:soc@example.com' AS dedupe_key FROM tri
  WHERE CAST(substr(incident_id, 10) AS BIGINT) % 2 = 0)
SELECT incident_id, recipient, incident_id || ':high_priority_email:' || recipient AS dedupe_key, 'sent' AS status,
  action_id AS recommended_action_id,
  md5('Incident desk detected a high-priority incident.' || chr(10) || chr(10) || 'Incident: ' || incident_id || chr(10) ||
    'Title: ' || title || chr(10) || 'Priority: High' || chr(10) || 'Summary: ' || summary || chr(10) ||
    'Recommended action: ' || label || chr(10) || 'Why Incident desk is recommending it: ' || reason || chr(10) || chr(10) ||
    'Open Incident desk to review and approve the next step.') AS body_md5
FROM tri CROSS JOIN (VALUES ('soc@example.com'), ('lead@example.com')) r(recipient)
WHERE risk_band = 'high' AND incident_id || ':high_priority_email:' || recipient NOT IN (SELECT dedupe_key FROM sent)""")
def pending_alerts(spark: SparkSession, folder: str) -> DataFrame:
    number = F.substring("incident_id", 10, 9).cast("long")
    sent = stages.incidents(spark, folder).where(number % 2 == 0).select(
        F.concat_ws(":", "incident_id", F.lit("high_priority_email"), F.lit(RECIPIENTS[0])).alias("dedupe_key"))
    alerts = casework.pending_alerts(casework.alert_candidates(triaged(spark, folder), RECIPIENTS), sent, status="sent")
    return alerts.select("incident_id", "recipient", "dedupe_key", "status", "recommended_action_id", F.md5("body").alias("body_md5"))


def _damaged_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Decision inputs with fields missing or out of range in some of them."""
    number = F.substring("incident_id", 10, 9).cast("long")
    odd = F.transform("checks", lambda c: F.struct(
        c["name"].alias("name"), F.when(number % 13 == 0, "odd").otherwise(c["status"]).alias("status"), c["detail"].alias("detail")))
    return cases(spark, folder).withColumns({
        "title": F.when(number % 7 != 0, F.col("title")), "summary": F.when(number % 21 != 0, F.col("summary")),
        "top_signals": F.when(number % 5 != 0, F.col("top_signals")), "checks": odd,
        "completeness_level": F.when(number % 11 == 0, "none").when(number % 17 != 0, F.col("completeness_level"))})


_REJECTS = """rej AS (SELECT incident_id, concat_ws('|',
    CASE WHEN n % 21 = 0 THEN 'incident missing required fields: title, summary'
         WHEN n % 7 = 0 THEN 'incident missing required fields: title' END,
    CASE WHEN n % 5 = 0 THEN 'detector_output missing required fields: top_signals' END,
    CASE WHEN n % 17 = 0 AND n % 11 <> 0 THEN 'coverage missing required fields: completeness_level' END,
    CASE WHEN n % 11 = 0 THEN 'Invalid completeness_level.' END,
    CASE WHEN n % 13 = 0 THEN 'Invalid coverage check status.' END) AS reasons
  FROM (SELECT incident_id, CAST(substr(incident_id, 10) AS BIGINT) AS n FROM lab))"""


@query(f"WITH {LABELED}, {_REJECTS} SELECT incident_id, reasons FROM rej WHERE reasons <> ''")
def rejected_cases(spark: SparkSession, folder: str) -> DataFrame:
    _, rejected = triage.triage_or_reject(_damaged_cases(spark, folder))
    return rejected.select("incident_id", piped(F.col("input_errors")).alias("reasons"))


@query(f"WITH {CASES}, {_REJECTS} SELECT tri.incident_id, action_id FROM tri JOIN rej ON rej.incident_id = tri.incident_id WHERE rej.reasons = ''")
def triaged_valid_cases(spark: SparkSession, folder: str) -> DataFrame:
    results, _ = triage.triage_or_reject(_damaged_cases(spark, folder))
    return results.select("incident_id", F.col("recommended_action.action_id").alias("action_id"))


@query(f"""WITH {CASES} SELECT incident_id, concat_ws(' ', title, summary, replace(nullif(ordered_event_name_sequence, ''), '|', ' '),
  replace(nullif(rules_fired, ''), '|', ' '), replace(nullif(patterns, ''), '|', ' ')) AS search_text FROM cases""")
def case_context_queries(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select("incident_id", retrieval.context_query().alias("search_text"))


@query(f"""WITH {CASES} SELECT incident_id, 'notification_email_sent' AS event_type, recipient,
  '[Incident desk] High-priority incident detected: ' || incident_id AS subject, 'high_priority_incident' AS alert_type
FROM tri CROSS JOIN (VALUES ('soc@example.com'), ('lead@example.com')) r(recipient) WHERE risk_band = 'high'""")
def notification_events(spark: SparkSession, folder: str) -> DataFrame:
    return casework.notification_events(casework.alert_candidates(triaged(spark, folder), RECIPIENTS))


@query(f"WITH {CASES} SELECT count(*) AS candidates, count(*) AS processed, CAST(0 AS BIGINT) AS failed FROM tri WHERE risk_band = 'high'")
def alert_scan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return casework.alert_scan_counts(triaged(spark, folder).where("severity_hint = 'high'"))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    generated = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return casework.approval_reports(_decisions(spark, folder), triaged(spark, folder), generated)


_SIGNAL_TEXT = ", ".join(f"CASE WHEN {column} THEN '{SIGNAL_EXPLANATIONS[rule]}' END" for rule, column in RULE_COLUMNS.items())


@query(f"""WITH {_DECISIONS} SELECT incident_id, title, upper(risk_band[1]) || risk_band[2:] AS severity, label AS approved_action_label,
  coalesce(rationale, 'The operator approved this action without adding extra written rationale.') AS operator_rationale,
  coalesce(nullif(concat_ws('|', {_SIGNAL_TEXT}), ''), 'Incident desk observed risk signals that justified review.') AS why_concerned,
  concat_ws('|', CASE WHEN NOT has_ag THEN 'Identity: Some evidence could not be checked because the data was unavailable.' END,
    'Network: Some important checks were not completed yet.',
    CASE WHEN NOT has_res THEN 'Resource activity: Some evidence could not be checked because the data was unavailable.' END) AS blind_spots,
  used_double_check, coalesce(actor, 'Operator') AS approved_by FROM dec WHERE number % 4 = 0""")
def approval_reports(spark: SparkSession, folder: str) -> DataFrame:
    return _reports(spark, folder).select(
        "incident_id", "title", "severity", "approved_action_label", "operator_rationale",
        piped("why_concerned").alias("why_concerned"), piped("blind_spots").alias("blind_spots"), "used_double_check", "approved_by")


@query(f"""WITH {_DECISIONS} SELECT count(*) AS reports, count(*) FILTER (rationale IS NOT NULL) AS escaped,
  CAST(0 AS BIGINT) AS raw_markup, count(*) * 2 AS title_lines FROM dec WHERE number % 4 = 0""")
def approval_report_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = _reports(spark, folder).select(casework.report_html().alias("html"), casework.report_lines().alias("lines"))
    return pages.agg(
        F.count("*").alias("reports"), F.count_if(F.col("html").contains("seen &amp; &lt;checked&gt;")).alias("escaped"),
        F.count_if(F.col("html").contains("<checked>")).alias("raw_markup"),
        F.sum(F.size(F.filter("lines", lambda l: l.isin("What happened", "Known blind spots"))).cast("long")).alias("title_lines"))


# --- operator views --------------------------------------------------------------------------------------
@query(f"""WITH {CASES} SELECT incident_id AS id, incident_id AS label, coalesce(primary_source_ip_address, title) AS site,
  upper(risk_band[1]) || risk_band[2:] AS severity, 'Needs review' AS state,
  CASE risk_band WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'warning' ELSE 'safe' END AS tone,
  CASE WHEN incident_start_time IS NOT NULL THEN strftime(incident_start_time, '%b %-d, %-I:%M %p UTC') || ' - '
    || strftime(incident_end_time, '%b %-d, %-I:%M %p UTC') END AS incident_window FROM tri""")
def incident_queue(spark: SparkSession, folder: str) -> DataFrame:
    return views.queue_view(cases(spark, folder))


@query(f"""WITH {CASES} SELECT incident_id, greatest(55, least(CAST(floor(risk_score * 100 + 0.5) AS BIGINT),
  CASE WHEN completeness_level = 'medium' THEN 78 ELSE 68 END)) AS confidence_percent FROM tri""")
def confidence_percent(spark: SparkSession, folder: str) -> DataFrame:
    return reviewed(spark, folder).select("incident_id", views.confidence_percent(
        F.lit(None).cast("double"), F.col("risk_score")).alias("confidence_percent"))


@query(f"""WITH {CASES}, c AS (
  SELECT incident_id, 'Identity' AS category, CASE WHEN has_ag THEN 'Checked, signal found' ELSE 'Data Unavailable' END AS status,
    CASE WHEN has_ag THEN 'critical' ELSE 'warning' END AS tone, '1 checks available' AS note FROM tri
  UNION ALL SELECT incident_id, 'Network', 'Not checked', 'warning', 'Missing: network_logs' FROM tri
  UNION ALL SELECT incident_id, 'Resource Activity', CASE WHEN has_res THEN 'Checked, signal found' ELSE 'Data Unavailable' END,
    CASE WHEN has_res THEN 'critical' ELSE 'warning' END, '1 checks available' FROM tri)
SELECT * FROM c""")
def coverage_rows(spark: SparkSession, folder: str) -> DataFrame:
    return views.coverage_view(reviewed(spark, folder)).select("incident_id", "category", "status", "tone", "note")


def _timeline_sql() -> str:
    used = {"consolelogin", "listbuckets", "describeinstances", "runinstances", "attachuserpolicy"}
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TIMELINE_PHRASES.items() if k in used)
    return (f"WITH {CASES}, s AS (SELECT incident_id, actor_key, unnest(list_slice(string_split(ordered_event_name_sequence, '|'), 1, 6)) AS e, "
            "generate_subscripts(list_slice(string_split(ordered_event_name_sequence, '|'), 1, 6), 1) AS i FROM tri) "
            f"SELECT incident_id, regexp_extract(actor_key, '[:/]([^:/]+)$', 1) AS short_name, actor_key, "
            f"string_agg(CASE lower(e) {whens} END, '|' ORDER BY i) AS timeline FROM s GROUP BY incident_id, actor_key")


@query(_timeline_sql().replace("SELECT incident_id, regexp_extract(actor_key, '[:/]([^:/]+)$', 1) AS short_name, actor_key, ",
                               "SELECT incident_id, coalesce(nullif(regexp_extract(actor_key, '[:/]([^:/]+)$', 1), ''), actor_key) AS actor, "))
def incident_timelines(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select(
        "incident_id", views.actor_short_name(F.col("actor_key")).alias("actor"), piped(views.timeline()).alias("timeline"))


@query(f"""WITH {CASES}, f AS (SELECT incident_id, rules_fired, string_split(concat_ws('~',
    CASE WHEN contains_console_login THEN 'Someone signed in interactively through the AWS console' END,
    CASE WHEN contains_recon_like_api OR has_ec2_sequence THEN 'the account then looked around existing cloud resources' END,
    CASE WHEN contains_resource_creation_api THEN 'new resources or access changes followed soon after' END,
    CASE WHEN contains_privilege_change_api THEN 'permissions or access appear to have changed during the same sequence' END
  ), '~') AS s FROM tri)
SELECT incident_id, CASE WHEN len(s) >= 3 THEN upper(s[1][1]) || s[1][2:] || ', ' || s[2] || ', and ' || s[3] ||
    '. This sequence is concerning because it looks like hands-on activity after access was gained.'
  WHEN len(s) = 2 THEN upper(s[1][1]) || s[1][2:] || ', and ' || s[2] ||
    '. Together, that pattern is more concerning than any one event on its own.'
  WHEN s[1] <> '' THEN upper(s[1][1]) || s[1][2:] || '. The system flagged it because this kind of activity often appears in suspicious hands-on sessions.'
  ELSE 'none' END AS concern FROM f""")
def concern_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return cases(spark, folder).select("incident_id", views.concern_summary().alias("concern"))


@query(f"""WITH {CASES} SELECT incident_id, 'For ' || title || ', the current recommended action is ' || label ||
  '. The detector currently rates the incident as ' || risk_band || ' risk. Coverage completeness is ' || completeness_level ||
  '. Missing sources still affecting the decision: network_logs.' AS status_line FROM tri""")
def status_lines(spark: SparkSession, folder: str) -> DataFrame:
    return triaged(spark, folder).select("incident_id", views.status_line().alias("status_line"))
