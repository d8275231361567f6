"""What travels and what is evaluated more than once, read from the plans."""

import pathlib

from pyspark.sql import functions as F

from trailwarden.operators import model, triage
from trailwarden.operators.features import derive_event_features
from trailwarden.rules import BOOLEAN_FEATURES, CATEGORICAL_FEATURES, COVERAGE_KEYWORDS, NUMERIC_FEATURES
from trailwarden.session import materialize
from trailwarden.sources.tables import audit_events


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_features_do_not_travel_through_the_joins(spark, tmp_path):
    rows = [(i, 3 * i % 7, "view", 1.0, '{"k": 3}') for i in range(5)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id")).cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    features = derive_event_features(audit_events(spark, str(tmp_path)))
    assert " AS is_root_user" not in optimized(features).split("Join ", 1)[1]
    assert features.count() == 5


def test_event_stages_are_packed(spark):
    kept = materialize(spark.range(3), "packed", small=True)
    assert all(pathlib.Path(f).name.endswith(".zstd.parquet") for f in kept.inputFiles()) and kept.count() == 3


def test_checks_of_a_category_are_looked_up_once(spark):
    check = "named_struct('name', '{}', 'status', '{}', 'detail', 'd')"
    case = spark.range(1).select(
        F.expr(f"array({check.format('Console-Auth', 'not_checked')}, {check.format('Access-Key', 'checked_no_signal')})").alias("checks"),
        F.expr("array('VPC flow', 'other')").alias("missing_sources"))
    case = materialize(case, "coverage-case")
    found = case.select(triage.coverage_by_category().alias("c"))
    got = [(r["category"], r["status"], [c["name"] for c in r["checks"]], r["missing_sources"]) for r in found.first()["c"]]
    assert got == [("login", "not_checked", ["Console-Auth"], []), ("identity", "checked_no_signal", ["Access-Key"], []),
                   ("network", "data_unavailable", [], ["VPC flow"])]
    assert optimized(found).count("filter(checks") == len(COVERAGE_KEYWORDS)


def test_names_of_contributions_are_made_once(spark):
    row = {c: F.lit(2.0) for c in NUMERIC_FEATURES} | {c: F.lit(True) for c in BOOLEAN_FEATURES} | {c: F.lit("x") for c in CATEGORICAL_FEATURES}
    incidents = materialize(spark.range(1).withColumns(row), "contribution-case")
    number, flag = NUMERIC_FEATURES[0], BOOLEAN_FEATURES[0]
    fitted = model.IncidentModel(model.LOGISTIC, None, [model.Term(f"num__{number}", number, number, 0.25), model.Term(f"bool__{flag}", flag, flag, -1.0)])
    explained = model.contributions(fitted, incidents).select("contributions")
    words = [c.replace("_", " ").capitalize() for c in (flag, number)]
    assert [(c["friendly_name"], c["contribution"], c["direction"]) for c in explained.first()[0]] == [
        (words[0], -1.0, "reduces suspicion"), (words[1], 0.5, "increases suspicion")]
    assert optimized(explained).count("regexp_replace") == 1
