"""Joining fact rows with per-key tables, safely under skew.

Attack traffic is skewed: one address may send a third of all rows.  A plain
shuffle join would put that address in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A per-key table is broadcast only after counting at most this many rows.
BROADCAST_ROWS = 1_000_000

# A key is hot when it holds over 1/HOT_SHARE of the rows, so there are fewer
# than HOT_SHARE hot keys whatever the data: that bounds their broadcast.
HOT_SHARE = 1_000

# The rows of a hot key are dealt over so many parts.
SALTS = 64


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows (counts no further)."""
    return df.limit(rows + 1).count() <= rows


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str, small: bool) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row per ``key``.

    ``small`` says that ``per_key`` was counted to be within BROADCAST_ROWS:
    it then goes to every executor and ``rows`` are not shuffled.  Otherwise
    rows of hot keys, told by their number of rows in ``weight``, are dealt
    over SALTS parts each, and all meet in one shuffle.  ``rows`` are read
    once; ``per_key`` is read a few times and should be written before.
    """
    if small:
        return rows.join(F.broadcast(per_key.drop(weight)), key)
    total = per_key.agg(F.sum(weight)).scalar()
    hot = F.broadcast(per_key.where(F.col(weight) * F.lit(HOT_SHARE) > total).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    met = per_key.drop(weight).join(hot, key, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return dealt.join(met, [key, "_salt"]).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row per ``key``.

    A table counted small is broadcast.  Otherwise the keys that dominate
    ``rows`` are looked up first and broadcast with what was found, rows
    without a key skip the join, and the rest meet in a shuffle.
    """
    if at_most(table.select(key), broadcast_rows):
        return rows.join(F.broadcast(table), key, "left")
    keyed = rows.where(F.col(key).isNotNull())
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    hot_keys = counts.where(F.col("_rows") * F.lit(HOT_SHARE) > total).select(key)
    hot = F.broadcast(hot_keys).join(table, key, "left")
    near = keyed.join(F.broadcast(hot), key)
    far = keyed.join(F.broadcast(hot_keys), key, "left_anti").join(table, key, "left")
    unkeyed = rows.where(F.col(key).isNull())
    return near.unionByName(far).unionByName(unkeyed, allowMissingColumns=True)
