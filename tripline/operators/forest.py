"""Isolation forest over per-address features (Liu, Ting and Zhou, 2008).

Spark draws each tree's sample, grows one tree per task and scores addresses
in Arrow batches; a tree sees at most ``SAMPLE`` rows and the forest has at
most ``TREES * (2 * SAMPLE - 1)`` nodes, whatever the number of addresses.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tripline.functions.scoring import round_half_even
from tripline.operators.features import feature_vector
from tripline.operators.quantiles import exact_percentile
from tripline.schemas import FINDING
from tripline.session import materialize

ML_OUTLIER = "ml_outlier"

TREES = 100
SAMPLE = 256
SEED = 42
EULER = 0.5772156649015329

_NODE = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1.0, 1.0)) + EULER
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (n - 1.0) / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def draw_samples(vectors: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """``min(sample, n)`` addresses per tree, without replacement.

    Draws depend on the address and the tree only, not on partitioning.  Each
    address carries the trees that may draw it, four times as many as will on
    average, and each tree ranks its candidates.
    """
    share = min(1.0, 4.0 * sample / n)
    drawn_by = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: _unit_hash(F.col("source_ip"), F.lit(SEED), tree) < share
    )
    candidates = vectors.withColumn("tree", F.explode(drawn_by)).withColumn(
        "draw", _unit_hash(F.col("source_ip"), F.lit(SEED), F.col("tree"))
    )
    order = Window.partitionBy("tree").orderBy("draw", "source_ip")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)


def grow(samples: DataFrame) -> DataFrame:
    """Nodes of all trees, one task-local group of at most SAMPLE rows each."""
    return samples.select("tree", "place", "vector").groupBy("tree").applyInPandas(_grow_tree, _NODE)


def forest_scores(vectors: DataFrame, nodes: pd.DataFrame, sample: int) -> DataFrame:
    """Adds ``anomaly`` in (0, 1]: the shorter the average path, the higher."""
    arrays = {t: g.sort_values("node") for t, g in nodes.groupby("tree")}
    packed = [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth")) for g in arrays.values()]
    shared = vectors.sparkSession.sparkContext.broadcast(packed)
    norm = float(average_path(sample))

    @F.pandas_udf("double")
    def score(vector: pd.Series) -> pd.Series:
        points = np.stack(vector.to_numpy()) if len(vector) else np.empty((0, 1))
        total = np.zeros(len(points))
        for feature, cut, left, right, depth in shared.value:
            at = np.zeros(len(points), dtype=int)
            while (inner := left[at] >= 0).any():
                row = np.flatnonzero(inner)
                node = at[row]
                goes_left = points[row, feature[node]] <= cut[node]
                at[row] = np.where(goes_left, left[node], right[node])
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(shared.value) / norm))

    return vectors.withColumn("anomaly", score("vector"))


def forest_findings(
    features: DataFrame, window_end: Column, *, min_samples: int = 8, contamination: float = 0.1
) -> DataFrame:
    """Addresses in the most isolated ``contamination`` share of the population."""
    spark = features.sparkSession
    vectors = materialize(features.select("source_ip", feature_vector().alias("vector")), "vectors")
    n = vectors.count()
    if n < min_samples:
        return spark.createDataFrame([], FINDING)
    nodes = grow(draw_samples(vectors, n)).toPandas()  # bounded by TREES and SAMPLE
    scored = materialize(forest_scores(vectors, nodes, min(SAMPLE, n)).select("source_ip", "anomaly"), "forest")
    # score_samples is the negated anomaly: its low tail holds the outliers.
    lowest = scored.select("source_ip", (-F.col("anomaly")).alias("sample_score"))
    cutoff = exact_percentile(lowest, "sample_score", contamination)
    magnitude = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("sample_score")))
    return (
        lowest.where(F.col("sample_score") < cutoff)
        .select(
            F.lit(ML_OUTLIER).alias("rule_key"),
            F.concat(F.lit("ML Behavioral Outlier: "), "source_ip").alias("title"),
            F.format_string("Isolation Forest isolated this IP as an outlier (anomaly score %.2f)", magnitude).alias(
                "description"
            ),
            F.lit("medium").alias("severity"),
            F.lit(None).cast("string").alias("mitre_technique"),
            round_half_even(magnitude, 2).alias("score"),
            "source_ip",
            F.lit(None).cast("string").alias("event_id"),
            F.col("source_ip").alias("group_key"),
            window_end.alias("window_end"),
        )
    ).to(FINDING)


def _unit_hash(*columns: Column) -> Column:
    """A hash of the columns, spread evenly over [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _grow_tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    points = np.stack(rows["vector"].to_numpy())
    random = np.random.default_rng([SEED, int(key[0])])
    limit = math.ceil(math.log2(max(len(points), 2)))
    out: list[list] = []

    def split(members: np.ndarray, level: int) -> int:
        node = len(out)
        out.append([int(key[0]), node, -1, 0.0, -1, -1, level + float(average_path(len(members)))])
        spread = np.ptp(points[members], axis=0)
        if level >= limit or len(members) < 2 or not spread.any():
            return node
        feature = int(random.choice(np.flatnonzero(spread)))
        low = points[members, feature].min()
        cut = random.uniform(low, low + spread[feature])
        side = points[members, feature] <= cut
        out[node][2:4] = [feature, float(cut)]
        out[node][4] = split(members[side], level + 1)
        out[node][5] = split(members[~side], level + 1)
        return node

    split(np.arange(len(points)), 0)
    return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])
