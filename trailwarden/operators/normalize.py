"""Flat event table from raw audit records (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: flat column -> path in the record
TEXT_PATHS: dict[str, str] = {
    "event_id": "eventID",
    "event_version": "eventVersion",
    "event_time": "eventTime",
    "event_source": "eventSource",
    "event_name": "eventName",
    "event_type": "eventType",
    "api_version": "apiVersion",
    "aws_region": "awsRegion",
    "read_only": "readOnly",
    "recipient_account_id": "recipientAccountId",
    "shared_event_id": "sharedEventID",
    "vpc_endpoint_id": "vpcEndpointId",
    "user_type": "userIdentity.type",
    "principal_id": "userIdentity.principalId",
    "user_arn": "userIdentity.arn",
    "user_account_id": "userIdentity.accountId",
    "invoked_by": "userIdentity.invokedBy",
    "access_key_id": "userIdentity.accessKeyId",
    "username": "userIdentity.userName",
    "session_mfa_authenticated": "userIdentity.sessionContext.attributes.mfaAuthenticated",
    "session_creation_date": "userIdentity.sessionContext.attributes.creationDate",
    "session_issuer_type": "userIdentity.sessionContext.sessionIssuer.type",
    "session_issuer_principal_id": "userIdentity.sessionContext.sessionIssuer.principalId",
    "session_issuer_arn": "userIdentity.sessionContext.sessionIssuer.arn",
    "session_issuer_account_id": "userIdentity.sessionContext.sessionIssuer.accountId",
    "session_issuer_username": "userIdentity.sessionContext.sessionIssuer.userName",
    "source_ip_address": "sourceIPAddress",
    "user_agent": "userAgent",
    "error_code": "errorCode",
    "error_message": "errorMessage",
}
JSON_PATHS: dict[str, str] = {
    "request_parameters_json": "requestParameters",
    "response_elements_json": "responseElements",
    "additional_event_data_json": "additionalEventData",
    "service_event_details_json": "serviceEventDetails",
    "resources_json": "resources",
}
PRESENCE_PATHS: dict[str, str] = {
    "user_arn": "userIdentity.arn",
    "access_key_id": "userIdentity.accessKeyId",
    "source_ip_address": "sourceIPAddress",
    "user_agent": "userAgent",
    "request_parameters": "requestParameters",
    "resources": "resources",
}
RESOURCE_FIELDS = {
    "resource_types_concat": "type",
    "resource_arns_concat": "ARN",
    "resource_account_ids_concat": "accountId",
}
# end of fixed values

_WHITESPACE = " \t\n\r\x0b\x0c"


def _text(path: str, record: str = "record") -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def strip_to_null(column: Column) -> Column:
    trimmed = F.btrim(column, F.lit(_WHITESPACE))
    return F.when(trimmed != "", trimmed)


def tri_state(column: Column) -> Column:
    """true / false in any case, everything else null."""
    word = F.lower(F.btrim(column, F.lit(_WHITESPACE)))
    return F.when(word == "true", True).when(word == "false", False)


def compact_json(path: str) -> Column:
    """Compact JSON with sorted keys; absent and JSON null are null.

    Numbers come out in their shortest form and non-ASCII text is kept as is.
    """
    part = F.variant_get("record", f"$.{path}", "variant")
    return F.when(~F.is_variant_null(part), F.to_json(part))


def presence_state(path: str) -> Column:
    part = F.variant_get("record", f"$.{path}", "variant")
    blank = F.try_variant_get(part, "$", "string") == ""
    empty_list = F.size(F.try_variant_get(part, "$", "array<variant>")) == 0
    return (
        F.when(part.isNull(), "absent")
        .when(F.is_variant_null(part), "null")
        .when(F.coalesce(blank, F.lit(False)) | F.coalesce(empty_list, F.lit(False)), "empty")
        .otherwise("present")
    )


def _field_text(field: str):
    return lambda item: F.try_variant_get(item, f"$.{field}", "string")


def resource_summary() -> dict[str, Column]:
    """Length of the resource list and its distinct types, ARNs and accounts."""
    items = F.try_variant_get("record", "$.resources", "array<variant>")
    columns = {"resource_count": F.when(items.isNotNull(), F.size(items).cast("long"))}
    for name, field in RESOURCE_FIELDS.items():
        values = F.transform(items, _field_text(field))
        values = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        values = F.transform(values, lambda v: F.btrim(v, F.lit(_WHITESPACE)))
        columns[name] = F.nullif(F.array_join(F.array_sort(F.array_distinct(values)), "|"), F.lit(""))
    return columns


def normalize_records(records: DataFrame) -> DataFrame:
    """Fixed event schema; a record only ever loses to null what it does not have."""
    flat = records.select(
        "source_file_path", "source_file_name", "record_index_in_file", "ingest_ts_utc",
        *[_text(path).alias(name) for name, path in TEXT_PATHS.items()],
        *[compact_json(path).alias(name) for name, path in JSON_PATHS.items()],
        *[column.alias(name) for name, column in resource_summary().items()],
        *[presence_state(path).alias(f"{name}_presence_state") for name, path in PRESENCE_PATHS.items()],
    )
    # an error code of blanks is an error although the trimmed code becomes null
    success = F.col("error_code").isNull() | (F.col("error_code") == "")
    time = F.try_to_timestamp("event_time")
    typed = flat.withColumns({
        "event_time_epoch_ms": F.unix_millis(time),
        "event_time": time,
        "session_creation_date": F.try_to_timestamp("session_creation_date"),
        "read_only": tri_state(F.col("read_only")),
        "session_mfa_authenticated": tri_state(F.col("session_mfa_authenticated")),
        "success": success,
        "is_error": ~success,
    })
    texts = [f.name for f in typed.schema.fields if isinstance(f.dataType, T.StringType)]
    trimmed = typed.withColumns({name: strip_to_null(F.col(name)) for name in texts})
    return trimmed.withColumns({
        f"missing_{name}": F.col(f"{name}_presence_state").isin("absent", "null", "empty")
        for name in PRESENCE_PATHS
    })
