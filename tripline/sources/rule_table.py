"""The rule table: one row per rule, so that alerts can point at theirs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.rules.model import Rule, definition
from tripline.schemas import RULE

# The two population detectors, listed as rules of their own.
DETECTOR_RULES = (
    {
        "key": "rate_anomaly",
        "name": "Anomalous Request Rate",
        "description": "Event volume of an address far above that of its peers.",
        "severity": "medium",
        "mitre_technique": "T1498",
    },
    {
        "key": "ml_outlier",
        "name": "ML Behavioral Outlier",
        "description": "An address whose behaviour features an isolation forest separates early.",
        "severity": "medium",
        "mitre_technique": None,
    },
)

_BODY = T.StructType([f for f in RULE.fields if f.name != "rule_id"])


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules and detectors as table rows; the id is a hash of the key."""
    rows = [
        (r.key, r.name, r.description, r.severity, r.mitre_technique, r.enabled, json.dumps(definition(r), default=str))
        for r in rules
    ]
    anomaly = json.dumps({"type": "anomaly"})
    rows += [
        (d["key"], d["name"], d["description"], d["severity"], d["mitre_technique"], True, anomaly) for d in DETECTOR_RULES
    ]
    return spark.createDataFrame(rows, _BODY).withColumn("rule_id", F.xxhash64("key")).select(*RULE.fieldNames())


def upsert_rules(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The new rule table, with ``change`` telling created, updated and kept rows."""
    old, new = existing.alias("old"), incoming.alias("new")
    in_old, in_new = F.col("old.key").isNotNull(), F.col("new.key").isNotNull()
    pick = lambda c: F.when(in_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return old.join(new, F.col("old.key") == F.col("new.key"), "full_outer").select(
        F.coalesce("old.rule_id", "new.rule_id").alias("rule_id"),
        *[pick(c) for c in RULE.fieldNames() if c != "rule_id"],
        F.when(~in_old, "created").when(in_new, "updated").otherwise("kept").alias("change"),
    )


def change_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(
        F.count_if(F.col("change") == "created").alias("created"),
        F.count_if(F.col("change") == "updated").alias("updated"),
    )
