"""Per-address behaviour features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.scoring import rate_per_minute

# Outcomes that count as a failed login.
FAILED_OUTCOMES = ("failed", "invalid_user")

VECTOR = (
    "event_count",
    "distinct_dest_ports",
    "distinct_paths",
    "distinct_user_agents",
    "failed_count",
    "error_count",
    "rate_per_min",
)


def ip_features(events: DataFrame) -> DataFrame:
    """One row of features per source address; events without one are left out."""
    micros = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return (
        events.where(F.col("source_ip") != "")
        .groupBy("source_ip")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("raw.dest_port").alias("distinct_dest_ports"),
            F.count_distinct("raw.path").alias("distinct_paths"),
            F.count_distinct("raw.user_agent").alias("distinct_user_agents"),
            F.count_if(F.col("raw.outcome").isin(*FAILED_OUTCOMES)).alias("failed_count"),
            F.count_if(F.col("raw.status") >= 400).alias("error_count"),
            (micros / 1000000.0).alias("duration_seconds"),
        )
        .withColumn("rate_per_min", rate_per_minute(F.col("event_count"), F.col("duration_seconds")))
    )


def feature_vector() -> Column:
    """The seven features as an array of doubles, in fixed order."""
    return F.array(*[F.col(name).cast("double") for name in VECTOR])
