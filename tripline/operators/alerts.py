"""From findings to alerts, and alerts through triage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.attack import tactic, technique_name
from tripline.functions.scoring import escalated_severity, risk_score
from tripline.operators.joins import lookup
from tripline.schemas import ALERT, ALERT_STATUSES

_SHOWN = ("country", "city", "latitude", "longitude", "abuse_score")


def suppress_known(findings: DataFrame, alerts: DataFrame | None) -> DataFrame:
    """Drops findings that already have an alert.

    A per-event finding is known when any alert exists for its (rule, event).
    Other findings are known while an alert for (rule, group key) is open.
    ``alerts`` carry their current status.
    """
    if alerts is None:
        return findings
    known = (
        alerts.where(F.col("event_id").isNotNull() | (F.col("status") == "open"))
        .select("rule_key", subject().alias("_subject"))
        .distinct()
    )
    return findings.withColumn("_subject", subject()).join(known, ["rule_key", "_subject"], "left_anti").drop("_subject")


def score_findings(findings: DataFrame, enrichment: DataFrame | None) -> DataFrame:
    """Replaces ``severity`` and ``score`` by the escalated severity and the 0-100 risk."""
    if enrichment is None:
        known = findings.withColumn("abuse_score", F.lit(None).cast("int"))
    else:
        known = lookup(findings, enrichment.select(F.col("ip").alias("source_ip"), "abuse_score"), "source_ip")
    abuse = F.col("abuse_score")
    return known.withColumns(
        {
            "severity": escalated_severity(F.col("severity"), abuse),
            "score": risk_score(F.col("severity"), F.col("score"), abuse),
        }
    ).drop("abuse_score")


def link_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule_id``, null for rules that are not in the rule table."""
    return lookup(findings, rules.select(F.col("key").alias("rule_key"), "rule_id"), "rule_key")


def findings_to_alerts(
    findings: DataFrame,
    rules: DataFrame,
    enrichment: DataFrame | None = None,
    alerts: DataFrame | None = None,
    *,
    created_at: datetime | Column,
) -> DataFrame:
    """New alerts for findings that are not suppressed, ready to append.

    The id depends on the evidence only, so a replay makes the same alerts.
    """
    moment = created_at if isinstance(created_at, Column) else F.lit(created_at)
    fresh = score_findings(link_rules(suppress_known(findings, alerts), rules), enrichment)
    evidence = F.concat_ws("|", "rule_key", subject(), F.unix_micros("window_end").cast("string"))
    return fresh.withColumns(
        {
            "alert_id": F.sha2(evidence, 256),
            "status": F.lit("open"),
            "created_at": moment.cast("timestamp"),
            "updated_at": moment.cast("timestamp"),
        }
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ALERT.fields])


def with_current_status(alerts: DataFrame, status_log: DataFrame) -> DataFrame:
    """Alerts with the newest status of the triage log, when it has one."""
    latest = status_log.groupBy("alert_id").agg(F.max(F.struct("ts", "status")).alias("latest"))
    return alerts.join(latest, "alert_id", "left").select(
        *[c for c in alerts.columns if c not in ("status", "updated_at")],
        F.coalesce("latest.status", "status").alias("status"),
        F.coalesce("latest.ts", "updated_at").alias("updated_at"),
    ).select(*alerts.columns)


def status_change(alerts: DataFrame, alert_id: str, status: str, at: datetime) -> DataFrame:
    """A triage log row for an existing alert (empty when there is none)."""
    if status not in ALERT_STATUSES:
        raise ValueError(f"status must be one of {', '.join(ALERT_STATUSES)}, got {status!r}")
    return (
        alerts.where(F.col("alert_id") == alert_id)
        .select("alert_id", F.lit(status).alias("status"), F.lit(at).cast("timestamp").alias("ts"))
        .limit(1)
    )


def alert_view(alerts: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Alerts with technique name, tactic and, where known, an enrichment struct."""
    shown = enrichment.select(F.col("ip").alias("source_ip"), F.struct(*_SHOWN).alias("enrichment"))
    return lookup(alerts, shown, "source_ip").select(
        *alerts.columns,
        technique_name(F.col("mitre_technique")).alias("technique_name"),
        tactic(F.col("mitre_technique")).alias("tactic"),
        "enrichment",
    )


def subject() -> Column:
    """What a finding or alert is about: its event, or its group key."""
    group = F.coalesce(F.concat(F.lit("g:"), "group_key"), F.lit("g"))
    return F.coalesce(F.concat(F.lit("e:"), "event_id"), group)
