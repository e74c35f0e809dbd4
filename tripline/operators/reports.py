"""Listings and dashboard aggregates over alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.attack import tactic, technique_name
from tripline.functions.scoring import severity_rank
from tripline.operators.joins import lookup
from tripline.schemas import SEVERITIES

PAGE_MAX = 500
NEWEST_FIRST = ("created_at", "alert_id")


def filter_alerts(
    alerts: DataFrame, status: str | None = None, severity: str | None = None, source_ip: str | None = None
) -> DataFrame:
    for name, wanted in (("status", status), ("severity", severity), ("source_ip", source_ip)):
        if wanted is not None:
            alerts = alerts.where(F.col(name) == wanted)
    return alerts


def alert_page(alerts: DataFrame, limit: int = 100, offset: int = 0, **filters: str | None) -> DataFrame:
    """Newest alerts first; a top-k plan, not a full sort."""
    if not 1 <= limit <= PAGE_MAX or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MAX} and offset not negative")
    return _newest(filter_alerts(alerts, **filters)).offset(offset).limit(limit)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def live_feed(arrivals: DataFrame, cap: int = 15) -> DataFrame:
    """The newest ``cap`` alerts, the last version of each alert id only.

    The newest ids are found from two narrow columns; whole rows are read of those few only.
    """
    times = arrivals.groupBy("alert_id").agg(F.max("created_at").alias("created_at"))
    wanted = _newest(times).limit(cap).select("alert_id")  # never more than ``cap`` rows, so it is broadcast
    few = arrivals.join(F.broadcast(wanted), "alert_id", "left_semi")
    version = F.struct("created_at", "updated_at", *[c for c in arrivals.columns if c not in ("created_at", "updated_at")])
    last = few.groupBy("alert_id").agg(F.max_by(F.struct(*arrivals.columns), version).alias("last"))
    return _newest(last.select("last.*")).limit(cap)


def kpi_cards(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("high_critical"),
        F.count_distinct(F.when(F.col("source_ip") != "", F.col("source_ip"))).alias("source_ips"),
    )


def severity_histogram(alerts: DataFrame) -> DataFrame:
    """All five severities from critical to info, zero where none occurred."""
    order = list(reversed(SEVERITIES))
    counts = alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in order])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(s).alias("severity"), F.col(s).alias("alerts")) for i, s in enumerate(order)]
    return counts.select(F.inline(F.array(*rows)))


def hourly_timeline(alerts: DataFrame) -> DataFrame:
    """Alerts per UTC hour, ascending; hours without alerts are absent."""
    hour = F.date_trunc("hour", "created_at").alias("hour")
    return alerts.groupBy(hour).agg(F.count(F.lit(1)).alias("alerts")).orderBy("hour")


def geo_points(alerts: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Alerts per coordinates with the worst severity seen there."""
    places = enrichment.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("ip").alias("source_ip"), "latitude", "longitude"
    )
    return (
        lookup(alerts.select("source_ip", "severity"), places, "source_ip")
        .where(F.col("latitude").isNotNull())
        .groupBy("latitude", "longitude")
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        )
    )


def rules_per_technique(rules: DataFrame) -> DataFrame:
    active = rules.where(F.col("enabled") & F.col("mitre_technique").isNotNull())
    return active.groupBy("mitre_technique").agg(F.count(F.lit(1)).alias("rule_count"))


def alerts_per_technique(alerts: DataFrame) -> DataFrame:
    tagged = alerts.where(F.col("mitre_technique").isNotNull())
    return tagged.groupBy("mitre_technique").agg(F.count(F.lit(1)).alias("alert_count"))


def coverage(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Techniques the enabled rules cover, with rule and alert counts; ordered
    by tactic (unknown last), then technique."""
    return (
        rules_per_technique(rules)
        .join(alerts_per_technique(alerts), "mitre_technique", "left")
        .select(
            F.col("mitre_technique").alias("technique"),
            technique_name(F.col("mitre_technique")).alias("name"),
            tactic(F.col("mitre_technique")).alias("tactic"),
            "rule_count",
            F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
        )
        .orderBy(F.coalesce("tactic", F.lit("~")), "technique")
    )


def coverage_by_tactic(covered: DataFrame) -> DataFrame:
    """Covered techniques listed per tactic; one row per technique goes in, so
    a list is as long as the rule set is varied."""
    entry = F.struct("technique", "name", "rule_count", "alert_count")
    return covered.groupBy(F.coalesce("tactic", F.lit("Other")).alias("tactic")).agg(
        F.sort_array(F.collect_list(entry)).alias("techniques")
    )


def row_counts(**tables: DataFrame) -> DataFrame:
    """``table, rows`` for each table given."""
    counts = [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, t in tables.items()]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


# Labels of the submission profile.
FLOOD, REPEAT, SCAN, QUIET = (
    "Denial of Service (DoS) Attack",
    "Brute Force Attack",
    "Port Scanning",
    "No significant threat detected",
)


def submission_profile(lines: DataFrame, key: str, text: str = "line", *, trim: bool = True, scans: bool = True) -> DataFrame:
    """Labels per submission from how many of its lines there are and repeat.

    ``trim=False, scans=False`` gives the older variant, which compares lines
    as they are, counts blank ones and knows no port scan.
    """
    if trim:
        lines = lines.withColumn(text, F.trim(text)).where(F.col(text) != "")
    counted = lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(text).alias("distinct_lines"))
    repeats = F.col("distinct_lines") < F.col("lines")
    labels = F.array_compact(
        F.array(
            F.when(F.col("lines") > 5, FLOOD),
            F.when(repeats, REPEAT),
            F.when(F.lit(scans) & repeats & (F.col("lines") > 3), SCAN),
        )
    )
    return counted.withColumn("attack_types", F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(QUIET))))


def attack_tally(profiles: DataFrame) -> DataFrame:
    """Submissions per label."""
    return (
        profiles.select(F.explode("attack_types").alias("attack_type"))
        .groupBy("attack_type")
        .agg(F.count(F.lit(1)).alias("submissions"))
    )


def _newest(alerts: DataFrame) -> DataFrame:
    order: list[Column] = [F.col(name).desc() for name in NEWEST_FIRST]
    return alerts.orderBy(*order)
