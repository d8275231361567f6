import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from trailwarden import sinks
from trailwarden.operators import features, incidents, triage
from trailwarden.operators.labels import apply_weak_labels
from trailwarden.plans import stages
from trailwarden.plans.pipeline import run_pipeline
from trailwarden.session import materialize, staging_root
from trailwarden.streaming import alerts, ingest

T0 = dt.datetime(2024, 5, 1)


def _record(i, minute, actor="ann", name="ConsoleLogin", **more):
    return {"eventID": f"e{i}", "eventTime": (T0 + dt.timedelta(minutes=minute)).strftime("%Y-%m-%dT%H:%M:%SZ"), "eventName": name,
            "eventSource": "iam.amazonaws.com", "sourceIPAddress": "1.1.1.1", "userAgent": "ua",
            "userIdentity": {"type": "IAMUser", "arn": f"arn:aws:iam::1:user/{actor}"}, **more}


RECORDS = [_record(0, 0), _record(1, 10, name="ListBuckets"), _record(2, 12, "bob"), _record(3, 40, name="AttachUserPolicy"),
           _record(4, 90), _record(4, 90), _record(5, 91, "bob", errorCode="Denied")]


def _write(folder, name, records):
    (folder / name).write_text(json.dumps({"Records": records}))


def _drain(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_ingest_and_incidents_equal_batch(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    _write(source, "a.json", RECORDS[:4])
    _write(source, "b.json", RECORDS[4:])
    # a last file moves the watermark past every session
    _write(source, "c.json", [_record(99, 100_000, "zed")])
    stream = ingest.stream_events(spark, str(source), files_per_trigger=1)
    assert stream.isStreaming
    got = _drain(ingest.inactivity_incidents(stream), tmp_path, "sessions").where("not actor_key like '%zed'")
    batch = features.with_row_features(ingest_batch(spark, source))
    want = ingest.inactivity_incidents(batch).where("not actor_key like '%zed'")
    key = lambda rows: sorted(map(tuple, rows.collect()))
    assert key(got) == key(want)
    built = incidents.build_incidents(features.derive_event_features(ingest_batch(spark, source)), 30, mode="independent")
    view = built.where("not actor_key like '%zed'").select("actor_key", "incident_start_time", "incident_end_time", "event_count", "error_event_count", "first_event_name")
    assert key(want.select(*view.columns)) == key(view)


def ingest_batch(spark, folder):
    from trailwarden.operators.normalize import normalize_records
    from trailwarden.sources import logs
    return normalize_records(logs.records(logs.split_records(logs.read_log_files(spark, str(folder)))))


def test_stream_drops_duplicates_and_counts(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    _write(source, "a.json", RECORDS)
    events = ingest.stream_events(spark, str(source))
    assert _drain(ingest.drop_duplicate_events(events), tmp_path, "unique_events").count() == 6
    batch = features.with_row_features(ingest_batch(spark, source))
    assert ingest.drop_duplicate_events(batch).count() == 6
    counts = ingest.activity_counts(batch)
    assert counts.agg(F.sum("event_count")).first()[0] == len(RECORDS) * 5


def _cases(spark, names):
    table = apply_weak_labels(spark.createDataFrame(
        [(n, "arn:root", "ip", 0, 3, 3, 10.0, 3, 2, 1, True, True, True, True, "iam.amazonaws.com", "A", "B", "C", "u", "R", "A|B")
         for n in names], """incident_id string, actor_key string, primary_source_ip_address string, error_event_count long, success_event_count long,
        event_count long, incident_duration_seconds double, distinct_event_names long, distinct_event_sources long, distinct_regions long,
        contains_recon_like_api boolean, contains_privilege_change_api boolean, contains_resource_creation_api boolean, contains_console_login boolean,
        ordered_event_source_sequence string, first_event_name string, last_event_name string, top_event_name string, user_agents_seen string,
        resource_types_seen string, ordered_event_name_sequence string"""))
    return triage.triage(triage.decision_inputs(table, F.lit(0.9)))


def test_alert_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "alerts")
    to = ["a@x.org"]
    for batch_id, names in ((0, ["i1", "i2"]), (1, ["i2", "i3"]), (1, ["i2", "i3"])):
        alerts.record_alerts(_cases(spark, names), batch_id, path, to)
    sent = spark.read.parquet(path)
    assert sorted(r.incident_id for r in sent.collect()) == ["i1", "i2", "i3"]
    counts = alerts.scan_once(_cases(spark, ["i4"]), 2, path, to).first()
    assert (counts.candidates, counts.processed, counts.failed) == (1, 1, 0)


def test_a_new_checkpoint_keeps_the_alert_history(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "incident_id string"
    for run, names in enumerate((["i1", "i2"], ["i2", "i3"])):
        folder = str(tmp_path / f"in{run}")
        spark.createDataFrame([(n,) for n in names], schema).coalesce(1).write.parquet(folder)
        alerts.alert_stream(
            spark.readStream.schema(schema).parquet(folder),
            lambda batch: _cases(spark, ["i1", "i2", "i3"]).join(batch, "incident_id", "left_semi"), path, str(tmp_path / f"cp{run}"),
            ["a@x.org"]).trigger(availableNow=True).start().awaitTermination(120)
    sent = spark.read.parquet(path)
    assert sorted(r.incident_id for r in sent.collect()) == ["i1", "i2", "i3"]
    assert sent.select("run_id").distinct().count() == 2
    alerts.scan_once(_cases(spark, ["i1", "i4"]), 0, path, ["a@x.org"])
    alerts.scan_once(_cases(spark, ["i5"]), 0, path, ["a@x.org"])
    assert sorted(r.incident_id for r in spark.read.parquet(path).collect()) == ["i1", "i2", "i3", "i4", "i5"]


def test_duplicate_drop_keeps_the_first_row(spark):
    from trailwarden.streaming import ingest

    rows = spark.createDataFrame([("e", "b", 1, "later"), ("e", "a", 7, "first"), (None, "a", 8, "x"), (None, "a", 9, "y")],
                                 "event_id string, source_file_name string, record_index_in_file int, payload string")
    got = ingest.drop_duplicate_events(rows.repartition(3))
    assert got.columns == rows.columns and sorted(r.payload for r in got.collect()) == ["first", "x", "y"]


def test_alert_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    _cases(spark, ["i1"]).select("incident_id").write.parquet(str(source))
    names = spark.readStream.schema("incident_id string").parquet(str(source))
    run = lambda: alerts.alert_stream(
        names, lambda batch: _cases(spark, ["i1"]).join(batch, "incident_id", "left_semi"), path, str(tmp_path / "cp"), ["a@x.org"]
    ).trigger(availableNow=True).start().awaitTermination(120)
    run()
    run()
    assert spark.read.parquet(path).count() == 1


def test_pipeline_end_to_end(spark, tmp_path):
    source, out = tmp_path / "logs", tmp_path / "out"
    source.mkdir()
    _write(source, "a.json", RECORDS)
    (source / "broken.json").write_text("{")
    errors = run_pipeline(spark, str(source), str(out), write_full_csv=True).first().errors
    assert errors == []
    assert (out / "events_flat" / "event_date=2024-05-01").is_dir()
    assert (out / "incidents" / "incident_start_date=2024-05-01").is_dir()
    assert spark.read.parquet(str(out / "events_flat")).count() == len(RECORDS)
    assert spark.read.csv(str(out / "events_flat_csv"), header=True).count() == len(RECORDS)
    assert spark.read.parquet(str(out / "ingest_errors")).first().reason == "JSONDecodeError"
    report = json.loads(next((out / "data_quality_report").glob("part-*")).read_text())
    assert (report["total_files_read"], report["total_malformed_files"], report["duplicate_event_ids"]) == (2, 1, 1)
    assert spark.read.json(str(out / "schema")).where("table_name = 'incidents'").count() >= 26
    assert any("global_sort_key" in r.value for r in spark.read.text(str(out / "feature_dictionary")).collect())


def test_csv_sample_is_the_first_rows_in_order(spark, tmp_path):
    df = spark.range(100).select((99 - F.col("id")).alias("n"), F.array(F.lit(1)).alias("a"))
    sinks.write_csv(df, str(tmp_path / "s"), [F.col("n")], 3)
    rows = spark.read.csv(str(tmp_path / "s"), header=True).collect()
    assert sorted(r.n for r in rows) == ["0", "1", "2"] and rows[0].a == "[1]"


def test_append_only_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_rows(spark.range(2), path)
    assert spark.read.parquet(path).where("created_at is not null").count() == 4


class _Named:
    """A session whose cluster names a checkpoint folder."""

    def __init__(self, folder, master="yarn"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda self: None})()


def test_staging_uses_the_configured_folder():
    assert staging_root(_Named("hdfs://shared/cp")) == "hdfs://shared/cp"
    with pytest.raises(ValueError):
        staging_root(_Named(None))


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(3).withColumn("s", F.struct(F.lit("x").alias("y")))
    back = materialize(df, "probe")
    assert back.count() == 3 and back.schema.simpleString() == df.schema.simpleString()
    assert any("/probe-" in f for f in back.inputFiles())


def test_contract(spark, sf_dir):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 20
    assert stages.incidents(spark, sf_dir).count() > 0
    doc = features.derive_event_features.__doc__
    assert doc


@pytest.mark.parametrize("name", ["event_ranks", "recommended_actions", "knowledge_search", "label_rate_by_score"])
def test_queries_run_on_small_data(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_duplicate_drop_keeps_the_timed_row(spark):
    rows = spark.createDataFrame([("e", None, "a.json", 0), ("e", "2024-01-02 00:00:00", "b.json", 1), ("e", "2024-01-01 00:00:00", "c.json", 2)],
                                 "event_id string, t string, source_file_name string, record_index_in_file long")
    rows = rows.withColumn("event_time", F.to_timestamp("t"))
    assert ingest.drop_duplicate_events(rows).first().source_file_name == "c.json"
    assert ingest.drop_duplicate_events(rows.where("t IS NULL")).first().source_file_name == "a.json"


def test_upsert_orders_by_the_type_given(spark):
    from trailwarden.operators import casework
    kept = spark.createDataFrame([("k", "old")], "key string, value string")
    new = spark.createDataFrame([("k", "first", "2024-01-01 00:00:00.2"), ("k", "second", "2024-01-01 00:00:00.7")], "key string, value string, at string")
    assert casework.upsert(kept, new, ["key"], "at").first().value == "second"
    assert casework.upsert(kept, new.withColumn("at", F.to_timestamp("at")), ["key"], "at").first().value == "second"


def test_stages_follow_the_files_of_a_folder(spark, tmp_path):
    from trailwarden.plans import stages
    read = lambda: stages.stage(spark, str(tmp_path), "count", lambda: spark.read.parquet(str(tmp_path / "t.parquet"))).count()
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert read() == 3
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert read() == 8
