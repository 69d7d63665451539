"""Access audit records: one schema, appended in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Audit record layout (fixed values).
AUDIT_SCHEMA = (
    "event_id string, timestamp timestamp_ntz, user_role string, user_identifier_placeholder string, action_type string, "
    "module string, resource_type string, sensitivity_level string, decision string, export_file_reference string, "
    "source_ip_placeholder string, reason_comment string, retention_period int"
)

# Severity of each audited action (fixed values).
ACTION_SEVERITY = {
    "login_access_event": "Low",
    "dashboard_view": "Low",
    "employee_level_drilldown": "Medium",
    "payroll_view": "High",
    "er_legal_case_view": "High",
    "talent_performance_view": "High",
    "export_event": "Critical",
    "refresh_event": "Medium",
    "configuration_change": "Critical",
    "approval_signoff_action": "Medium",
    "failed_access_attempt": "Critical",
    "masking_override_attempt": "Critical",
}


def audit_records(df: DataFrame, **values: Column) -> DataFrame:
    """Rows in the audit layout; fields without a value are NULL, severity follows the action."""
    severity = F.create_map(*[F.lit(x) for pair in ACTION_SEVERITY.items() for x in pair])
    if "sensitivity_level" not in values and "action_type" in values:
        values["sensitivity_level"] = F.element_at(severity, values["action_type"])
    fields = [field.strip().split(" ") for field in AUDIT_SCHEMA.split(",")]
    return df.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def append_stream(records: DataFrame, path: str, checkpoint: str, repeats_within: str = "7 days"):
    """Append a stream of audit records to Parquet; an event that is delivered again is not repeated.

    Event ids are kept as state for the given time after they arrived, and one
    that comes again within it is dropped. The clock is that of arrival, not the
    event's own, so an event that is reported late is not lost. An event without
    an id cannot be told from others and is always kept.
    """
    arrived = records.withColumn("_arrived", F.current_timestamp()).withColumn("_id", F.coalesce("event_id", F.uuid()))
    once = arrived.withWatermark("_arrived", repeats_within).dropDuplicatesWithinWatermark(["_id"]).drop("_arrived", "_id")
    return (
        once.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
