"""Leave-one-out volume outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.functions.scoring import round_half_even
from tripline.schemas import FINDING

RATE_ANOMALY = "rate_anomaly"


def leave_one_out(features: DataFrame) -> DataFrame:
    """Adds the mean, spread and z-score of each count against all the others.

    Three totals are enough: no address needs to see its peers.  The variance
    numerator stays a whole number, so a uniform population gives exactly 0.
    """
    count = F.col("event_count").cast("decimal(19,0)")
    totals = features.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.sum(count).alias("total"),
            F.sum((count * count).cast("decimal(38,0)")).alias("squares"),
        )
    ).scalar()
    whole = "decimal(38,0)"
    peers = F.col("pop.n") - 1
    rest = (F.col("pop.total") - count).cast("decimal(19,0)")
    rest_squares = (F.col("pop.squares") - count * count).cast("decimal(27,0)")
    variance_top = (
        (rest_squares * peers.cast("decimal(11,0)")).cast(whole) - (rest * rest).cast(whole)
    ).cast("double")
    return (
        features.withColumn("pop", totals)
        .withColumn("population", F.col("pop.n"))
        .withColumn("peer_mean", rest.cast("double") / peers)
        .withColumn("peer_spread", F.sqrt(variance_top) / peers)
        .withColumn("z", F.try_divide(F.col("event_count") - F.col("peer_mean"), F.nullif("peer_spread", F.lit(0.0))))
        .drop("pop")
    )


def zscore_findings(
    features: DataFrame, window_end: Column, *, z_threshold: float = 3.0, min_count: int = 20
) -> DataFrame:
    """Addresses whose event count is far above the rest of the population."""
    uniform = F.col("peer_spread") == 0
    clear_excess = uniform & (F.col("event_count") > F.col("peer_mean") * 1.5)
    outlier = ~uniform & (F.col("z") >= z_threshold)
    shown_z = F.when(uniform, F.lit(z_threshold)).otherwise(F.col("z"))
    score = F.when(uniform, F.lit(0.8)).otherwise(F.least(F.lit(1.0), F.col("z") / 6.0))
    # With fewer than three addresses there is no population to compare with.
    return (
        leave_one_out(features)
        .where((F.col("population") >= 3) & (F.col("event_count") >= min_count) & (clear_excess | outlier))
        .select(
            F.lit(RATE_ANOMALY).alias("rule_key"),
            F.concat(F.lit("Anomalous Request Rate from "), "source_ip").alias("title"),
            F.format_string(
                "%d events vs peer mean %.1f (z-score %.1f) — statistical outlier", "event_count", "peer_mean", shown_z
            ).alias("description"),
            F.lit("medium").alias("severity"),
            F.lit("T1498").alias("mitre_technique"),
            round_half_even(score, 2).alias("score"),
            "source_ip",
            F.lit(None).cast("string").alias("event_id"),
            F.col("source_ip").alias("group_key"),
            window_end.alias("window_end"),
        )
    ).to(FINDING)
