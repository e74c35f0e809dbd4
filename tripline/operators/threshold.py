"""Latest-window counting rules.

For each key the window ends at the key's newest stored event, whatever the
rule selects, and both ends count.  Rules that share a group key share one
aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.scoring import threshold_score
from tripline.operators.joins import BROADCAST_ROWS, at_most, join_per_key
from tripline.operators.selection import group_value, resolve, selection
from tripline.rules.model import ThresholdRule
from tripline.schemas import FINDING
from tripline.session import materialize


def threshold_findings(
    events: DataFrame,
    rules: Sequence[ThresholdRule],
    batch: DataFrame | None = None,
    *,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Findings for every key whose latest window reaches a rule's threshold.

    ``events`` is all stored history.  ``batch`` holds the new events (already
    part of the history): then only keys seen in it are evaluated.
    """
    by_key: dict[str, list[ThresholdRule]] = {}
    for rule in rules:
        by_key.setdefault(rule.group_by, []).append(rule)
    parts = [_evaluate(events, key, group, batch, broadcast_rows) for key, group in by_key.items()]
    return reduce(DataFrame.unionByName, parts)


def newest_times(events: DataFrame, fields: Sequence[str]) -> DataFrame:
    """key_field, group_key, newest: the newest time of each value of each of ``fields``."""
    parts = [
        _keyed(events, field).groupBy("group_key").agg(F.max("ts").alias("newest")).select(
            F.lit(field).alias("key_field"), "group_key", "newest"
        )
        for field in fields
    ]
    return reduce(DataFrame.unionByName, parts)


def window_dates(ends: DataFrame, span: int) -> DataFrame:
    """day: the dates that windows of ``span`` seconds touch which end at ``newest``."""
    first, last = F.to_date(F.col("newest") - _seconds(span)), F.to_date("newest")
    return ends.where("newest IS NOT NULL").select(F.explode(F.sequence(first, last)).alias("day")).distinct()


def _evaluate(
    events: DataFrame, key: str, rules: list[ThresholdRule], batch: DataFrame | None, broadcast_rows: int
) -> DataFrame:
    # Per-key tables are small beside the events and are used several times, so each is written once.
    rows = _keyed(events, key)
    keys = _keyed(events if batch is None else batch, key).groupBy("group_key").agg(
        F.max("ts").alias("window_end"), F.count(F.lit(1)).alias("events_seen")
    )
    keys = materialize(keys, "keys")
    small = at_most(keys, broadcast_rows)
    ends = keys
    if batch is not None:
        span = max(rule.window_seconds for rule in rules)
        # As a whole number it does not pass through the driver's time zone.
        floor = keys.agg(F.unix_micros(F.min("window_end") - _seconds(span))).first()[0]
        rows = rows.where(F.col("ts") >= F.timestamp_micros(F.lit(floor)))
        if not small:
            # A key may be hot in the history and rare in the batch.
            held = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("events_seen"))
            keys = materialize(keys.drop("events_seen").join(held, "group_key"), "keys")
        seen = join_per_key(rows, keys.drop("window_end"), "group_key", "events_seen", small)
        ends = seen.groupBy("group_key").agg(F.max("ts").alias("window_end"), F.count(F.lit(1)).alias("events_seen"))
        ends = materialize(ends, "window-ends")

    inside = [_inside(events, rule) for rule in rules]
    counted = (
        join_per_key(rows, ends, "group_key", "events_seen", small)
        .where(reduce(or_, inside))
        .groupBy("group_key", "window_end")
        .agg(*[_observed(events, rule, here).alias(f"n{i}") for i, (rule, here) in enumerate(zip(rules, inside))])
    )
    fired = F.array_compact(F.array(*[_finding(rule, F.col(f"n{i}")) for i, rule in enumerate(rules)]))
    return counted.select("group_key", "window_end", F.inline(fired)).to(FINDING)


def _keyed(events: DataFrame, key: str) -> DataFrame:
    column, _ = resolve(events.schema, key)
    return events.withColumn("group_key", column.cast("string")).where(F.col("group_key").isNotNull())


def _seconds(n: int) -> Column:
    return F.expr(f"INTERVAL {n} SECONDS")


def _inside(events: DataFrame, rule: ThresholdRule) -> Column:
    recent = F.col("ts") >= F.col("window_end") - _seconds(rule.window_seconds)
    return recent & selection(events.schema, rule.selection)


def _observed(events: DataFrame, rule: ThresholdRule, inside: Column) -> Column:
    if rule.distinct_field is None:
        return F.count(F.when(inside, F.lit(1)))
    return F.count_distinct(F.when(inside, group_value(*resolve(events.schema, rule.distinct_field))))


def _finding(rule: ThresholdRule, observed: Column) -> Column:
    unit = "events" if rule.distinct_field is None else f"distinct {rule.distinct_field.split('.')[-1]}"
    limits = f" {unit} in {rule.window_seconds}s (threshold {rule.threshold})"
    by_address = rule.group_by == "source_ip"
    return F.when(
        observed >= rule.threshold,
        F.struct(
            F.lit(rule.key).alias("rule_key"),
            F.concat(F.lit(f"{rule.name} from "), F.col("group_key")).alias("title"),
            F.concat(observed.cast("string"), F.lit(limits)).alias("description"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.mitre_technique).cast("string").alias("mitre_technique"),
            threshold_score(observed, rule.threshold).alias("score"),
            (F.col("group_key") if by_address else F.lit(None).cast("string")).alias("source_ip"),
            F.lit(None).cast("string").alias("event_id"),
        ),
    )
