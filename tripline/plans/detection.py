"""Rules and population detectors over events."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.operators.features import ip_features
from tripline.operators.forest import forest_findings
from tripline.operators.match import match_findings
from tripline.operators.threshold import threshold_findings
from tripline.operators.zscore import zscore_findings
from tripline.rules.model import MatchRule, Rule, ThresholdRule
from tripline.schemas import FINDING
from tripline.session import materialize

# A detector turns per-address features of a window into findings.
Detector = Callable[[DataFrame, Column], DataFrame]

_DETECTORS: dict[str, Detector] = {"rate_anomaly": zscore_findings, "ml_outlier": forest_findings}

SCAN_SECONDS = (10, 86_400)


def register_detector(key: str, detector: Detector) -> None:
    """Adds a population detector (or replaces one) to the anomaly scan."""
    _DETECTORS[key] = detector


def detect(events: DataFrame, rules: Iterable[Rule], batch: DataFrame | None = None) -> DataFrame:
    """Findings of all enabled rules.

    Match rules look at the new events only; threshold rules count over the
    whole history, for the keys of the new events.  Without ``batch`` all
    events are new.
    """
    active = [rule for rule in rules if rule.enabled]
    matching = [rule for rule in active if isinstance(rule, MatchRule)]
    counting = [rule for rule in active if isinstance(rule, ThresholdRule)]
    parts = []
    if matching:
        parts.append(match_findings(events if batch is None else batch, matching))
    if counting:
        parts.append(threshold_findings(events, counting, batch))
    return reduce(DataFrame.unionByName, parts) if parts else _none(events)


def latest_window(events: DataFrame, window_seconds: int) -> DataFrame:
    """The events of the last ``window_seconds`` up to the newest one, with
    that time as ``window_end``."""
    end = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") >= end - F.expr(f"INTERVAL {window_seconds} SECONDS")).withColumn("window_end", end)


def anomaly_scan(events: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Findings of all detectors over the latest window of all events."""
    low, high = SCAN_SECONDS
    if not low <= window_seconds <= high:
        raise ValueError(f"window_seconds must be {low} to {high}")
    return detect_anomalies(latest_window(events, window_seconds), events.agg(F.max("ts")).scalar())


def detect_anomalies(events: DataFrame, window_end: Column) -> DataFrame:
    """All detectors over one feature table, computed once."""
    features = materialize(ip_features(events), "features")
    parts = [detector(features, window_end) for detector in _DETECTORS.values()]
    return reduce(DataFrame.unionByName, parts) if parts else _none(events)


def _none(events: DataFrame) -> DataFrame:
    return events.sparkSession.createDataFrame([], FINDING)
