import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from trailwarden.operators.normalize import normalize_records
from trailwarden.sources import logs


def _file(*records):
    return json.dumps({"Records": list(records)}).encode()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "c_plain.json").write_bytes(_file({"eventID": "evt-1"}, {"eventID": "evt-2"}))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(_file({"eventID": "evt-3"})))
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        data = gzip.compress(_file({"eventID": "evt-4"}))
        for name, content in (("sub/in.json.gz", data), ("bad.json.gz", b"junk"), ("notes.txt", b"skip")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    (tmp_path / "skip.txt").write_text("{}")
    return tmp_path


def test_folder_scan_reads_plain_gzip_and_archive(spark, folder):
    split = logs.split_records(logs.read_log_files(spark, str(folder)))
    rows = logs.records(split).select(
        "source_file_path", "source_file_name", "record_index_in_file",
        F.try_variant_get("record", "$.eventID", "string").alias("id")).orderBy("source_file_path", "record_index_in_file").collect()
    assert [r["id"] for r in rows] == ["evt-4", "evt-3", "evt-1", "evt-2"]
    assert rows[0]["source_file_path"].endswith("a.tar.gz::sub/in.json.gz")
    assert rows[0]["source_file_name"] == "in.json.gz"
    metrics = logs.ingest_metrics(split).first()
    assert (metrics.total_files_read, metrics.total_records_parsed) == (4, 4)
    assert (metrics.total_malformed_files, metrics.total_malformed_records) == (1, 0)
    assert [r["reason"] for r in logs.ingest_errors(split).collect()] == ["BadGzipFile"]


def test_single_file_is_read_whatever_its_name(spark, tmp_path):
    path = tmp_path / "audit.log"
    path.write_bytes(_file({"eventID": "x"}))
    for name in (str(path), path.as_uri(), f"file://{path}"):
        assert logs.records(logs.split_records(logs.read_log_files(spark, name))).count() == 1


def _text(spark, text):
    return spark.createDataFrame([("s", "f", text, None, True)], logs.TEXT_SCHEMA)


@pytest.mark.parametrize("text, reason", [
    ('{"notRecords": []}', "ValueError"), ("[1]", "ValueError"), ('{"Records": {}}', "ValueError"),
    ('{"Records": [', "JSONDecodeError"), ("nope", "JSONDecodeError"),
])
def test_malformed_files(spark, text, reason):
    split = logs.split_records(_text(spark, text))
    assert [(r["level"], r["reason"]) for r in logs.ingest_errors(split).collect()] == [("file", reason)]
    assert logs.ingest_metrics(split).first().total_files_read == 1


def test_non_object_entries_keep_their_index(spark):
    split = logs.split_records(_text(spark, '{"Records": ["bad-record", {"eventID": "evt-1"}, null, 3]}'))
    assert [r["record_index_in_file"] for r in logs.records(split).collect()] == [1]
    assert logs.ingest_errors(split).groupBy("reason").count().collect()[0].asDict() == {"reason": "NonObjectRecord", "count": 3}


def test_empty_record_list_counts_as_a_file(spark):
    metrics = logs.ingest_metrics(logs.split_records(_text(spark, '{"Records": []}'))).first()
    assert (metrics.total_files_read, metrics.total_records_parsed, metrics.total_malformed_files) == (1, 0, 0)


def _normalized(spark, record):
    text = json.dumps({"Records": [record]})
    return normalize_records(logs.records(logs.split_records(_text(spark, text)))).first()


def test_presence_states_and_text(spark):
    row = _normalized(spark, {
        "eventTime": "2025-01-01T00:00:00Z", "sourceIPAddress": None, "userAgent": "  console  ", "readOnly": " TRUE ",
        "userIdentity": {"accessKeyId": "", "sessionContext": {"attributes": {"mfaAuthenticated": False}}},
        "requestParameters": {}, "resources": [
            {"type": "AWS::IAM::User", "ARN": "arn:b"}, {"type": "AWS::IAM::AccessKey", "ARN": "arn:a", "accountId": "1"}]})
    assert row.event_time_epoch_ms == 1735689600000
    assert (row.access_key_id_presence_state, row.missing_access_key_id) == ("empty", True)
    assert (row.source_ip_address_presence_state, row.missing_source_ip_address) == ("null", True)
    assert (row.user_arn_presence_state, row.request_parameters_presence_state) == ("absent", "present")
    assert (row.user_agent, row.read_only, row.session_mfa_authenticated) == ("console", True, False)
    assert (row.resource_count, row.resource_types_concat) == (2, "AWS::IAM::AccessKey|AWS::IAM::User")
    assert (row.resource_arns_concat, row.resource_account_ids_concat) == ("arn:a|arn:b", "1")
    assert (row.success, row.is_error) == (True, False)


def test_bad_time_and_errors(spark):
    row = _normalized(spark, {"eventTime": "not-a-time", "errorCode": "AccessDenied", "userIdentity": "odd", "resources": {"type": "x"}})
    assert (row.event_time, row.event_time_epoch_ms) == (None, None)
    assert (row.success, row.is_error, row.user_type, row.resource_count) == (False, True, None, None)
    blank = _normalized(spark, {"errorCode": "   "})
    assert (blank.success, blank.error_code) == (False, None)
    assert _normalized(spark, {"errorCode": ""}).success is True


def test_compact_json_is_equal_after_parsing(spark):
    value = {"b": [1, {"z": None, "a": "é"}], "a": {"d": 1.5, "c": True}}
    row = _normalized(spark, {"requestParameters": value, "responseElements": None})
    assert json.loads(row.request_parameters_json) == value
    assert row.request_parameters_json.startswith('{"a":{"c":true,"d":1.5},"b"')
    assert row.response_elements_json is None
