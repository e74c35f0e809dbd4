"""Schemas of the tables that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("outcome", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("service", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("http_version", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("referer", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dest_port", T.IntegerType()),
        T.StructField("app_proto", T.StringType()),
        T.StructField(
            "alert",
            T.StructType(
                [
                    T.StructField("signature", T.StringType()),
                    T.StructField("signature_id", T.LongType()),
                    T.StructField("category", T.StringType()),
                    T.StructField("severity", T.IntegerType()),
                ]
            ),
        ),
        T.StructField("fields", T.MapType(T.StringType(), T.VariantType())),
        T.StructField("message", T.StringType()),
    ]
)

# What a line parser produces for one line.
PARSED = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("raw", RAW),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("raw", RAW),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

#: Lines of a format whose time cannot be read; ``event_date`` is the date they came in.
REJECT = T.StructType(
    [
        T.StructField("line", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("ingest_ts", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("rule_key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("event_id", T.StringType()),
        # The grouped value of a window or population finding, and the time the
        # evidence ends: together with the rule they identify the finding.
        T.StructField("group_key", T.StringType()),
        T.StructField("window_end", T.TimestampType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("rule_id", T.LongType()),
        T.StructField("rule_key", T.StringType()),
        T.StructField("group_key", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

STATUS_CHANGE = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

ENRICHMENT = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("abuse_score", T.IntegerType()),
        T.StructField("is_tor", T.BooleanType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

NEWEST = T.StructType(
    [
        # The newest time of a group key of threshold rules, as of one batch.
        T.StructField("key_field", T.StringType()),
        T.StructField("group_key", T.StringType()),
        T.StructField("newest", T.TimestampType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("mitre_technique", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("definition", T.StringType()),
    ]
)

LOG_SOURCE = T.StructType(
    [
        T.StructField("source_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
    ]
)

# Ordered severities, alert states, supported log formats.
SEVERITIES = ("info", "low", "medium", "high", "critical")
ALERT_STATUSES = ("open", "acknowledged", "resolved", "false_positive")
SOURCE_TYPES = ("auth_log", "nginx", "apache", "suricata", "custom")
