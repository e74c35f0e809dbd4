"""Named log sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripline.schemas import LOG_SOURCE


def source_id(name: Column) -> Column:
    """The id of a source: a hash of its unique name, null without a name."""
    return F.when(name.isNotNull(), F.xxhash64(name))


def new_sources(named: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows to append for names of ``named`` (``name, type``) not registered yet.

    A registered name keeps its type; of several types for a new name, one is
    taken.
    """
    fresh = named.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("type").alias("type"))
    return (
        fresh.join(registry.select("name"), "name", "left_anti")
        .withColumn("source_id", source_id(F.col("name")))
        .select(*LOG_SOURCE.fieldNames())
    )
