"""Per-event pattern rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.scoring import MATCH_SCORE
from tripline.operators.selection import any_pattern, selection, text_of
from tripline.rules.model import MatchRule
from tripline.schemas import FINDING


def match_findings(events: DataFrame, rules: Sequence[MatchRule]) -> DataFrame:
    """One finding per (rule, event) whose selected field matches a pattern.

    All rules are evaluated in one narrow pass over the events.
    """
    hits = F.array_compact(F.array(*[_hit(events, rule) for rule in rules]))
    return (
        events.select("source_ip", "event_id", "ts", hits.alias("hits"))
        .where(F.size("hits") > 0)
        .select("source_ip", "event_id", "ts", F.inline("hits"))
        .select(
            "rule_key",
            F.concat("name", F.lit(" from "), F.coalesce("source_ip", F.lit("None"))).alias("title"),
            F.concat(F.lit("Matched "), "field", F.lit(": "), F.substring("text", 1, 200)).alias("description"),
            "severity",
            "mitre_technique",
            F.lit(MATCH_SCORE).alias("score"),
            "source_ip",
            F.col("event_id").cast("string").alias("event_id"),
            F.lit(None).cast("string").alias("group_key"),
            F.col("ts").alias("window_end"),
        )
    ).to(FINDING)


def _hit(events: DataFrame, rule: MatchRule) -> Column:
    text = text_of(events.schema, rule)
    fires = selection(events.schema, rule.selection) & text.isNotNull() & any_pattern(text, rule)
    return F.when(
        fires,
        F.struct(
            F.lit(rule.key).alias("rule_key"),
            F.lit(rule.name).alias("name"),
            F.lit(rule.field).alias("field"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.mitre_technique).cast("string").alias("mitre_technique"),
            text.alias("text"),
        ),
    )
