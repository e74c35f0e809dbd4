"""Detector scores, risk and severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripline.schemas import SEVERITIES

# Risk points by severity, reputation level that escalates.
SEVERITY_BASE = {"info": 10.0, "low": 30.0, "medium": 50.0, "high": 70.0, "critical": 90.0}
ESCALATE_AT = 80
MATCH_SCORE = 0.9


def round_half_even(col: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def severity_rank(severity: Column) -> Column:
    """1 for info up to 5 for critical, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def threshold_score(observed: Column, threshold: int) -> Column:
    """0.5 at the threshold, 1.0 at twice the threshold and above."""
    excess = (observed - F.lit(threshold)).cast("double") / F.lit(float(threshold))
    return round_half_even(F.least(F.lit(1.0), 0.5 + 0.5 * excess), 2)


def risk_score(severity: Column, detector_score: Column, abuse_score: Column) -> Column:
    """Severity base, up to 10 points of confidence, up to 30 of reputation."""
    base = F.coalesce(*[F.when(severity == s, F.lit(points)) for s, points in SEVERITY_BASE.items()])
    risk = base + detector_score * 10.0 + F.coalesce(abuse_score * 0.3, F.lit(0.0))
    return round_half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), risk)), 1)


def escalated_severity(severity: Column, abuse_score: Column) -> Column:
    """One step up for a known-abusive address, at most critical."""
    ladder = F.array(*[F.lit(s) for s in SEVERITIES])
    raised = F.element_at(ladder, F.least(F.lit(len(SEVERITIES)), severity_rank(severity) + 1).cast("int"))
    return F.when(abuse_score >= ESCALATE_AT, raised).otherwise(severity)


def rate_per_minute(count: Column, duration_seconds: Column) -> Column:
    count = count.cast("double")
    return F.when(duration_seconds > 0, count / (duration_seconds / 60.0)).otherwise(count)
