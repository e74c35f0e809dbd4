"""Searching vectors in shards: every block of queries meets every shard, and the best are merged.

A vector takes part if it has an id, is not null, holds at least one component, and every
component is present and finite.  Of several vectors with one id the least (component by
component) counts.  Only vectors of equal length are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.session import materialize

QUERIES_IN_BLOCK = 512


def usable(df: DataFrame, id_column: str, vector: str, made: Callable[[Column], Column]) -> DataFrame:
    """vec_id, vector (``made`` of each component as double): one row an id."""
    parts = F.col(vector).cast("array<double>")
    ok = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & ok)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(parts, made).alias("vector"))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def grouped(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``vectors`` with dim and place (about ``size`` rows a place), and the number of places."""
    places = max(1, math.ceil(vectors.count() / size))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(places)).cast("int")
    return vectors.select("vec_id", "vector", F.size("vector").alias("dim"), place.alias("place")), places


def matrix(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a group, in order of id."""
    table = table.combine_chunks().sort_by("vec_id")
    ids = table["vec_id"].to_numpy()
    values = table["vector"].combine_chunks()
    return ids, values.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(ids), -1)


def query_blocks(queries: DataFrame, dtype: str) -> tuple[DataFrame, int]:
    """block, dim, ids and vectors (bytes) of the queries, and the number of blocks."""
    rows, blocks = grouped(queries, QUERIES_IN_BLOCK)

    def pack(table: pa.Table) -> pa.Table:
        ids, values = matrix(table, dtype)
        return pa.table(
            {
                "block": table["place"][:1].cast(pa.int32()),
                "dim": table["dim"][:1].cast(pa.int32()),
                "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "query_vectors": pa.array([np.ascontiguousarray(values).tobytes()], pa.binary()),
            }
        )

    packed = rows.groupBy("place", "dim").applyInArrow(
        pack, "block int, dim int, query_ids binary, query_vectors binary"
    )
    return materialize(packed, "queries"), blocks


def search(
    shards: DataFrame, shard_count: int, queries: DataFrame, block_count: int, run: Callable, k: int, score_type: str
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all shards; ties go to the smaller id.

    ``shards`` has one row a (shard, dim); ``run(shard_row, ids, bytes)`` gives the found
    (query index, vec_id, score) arrays.  Each group is one shard and one block of queries.
    """
    result = f"query_id long, vec_id long, score {score_type}"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block = right.to_pylist()[0]
            ids = np.frombuffer(block["query_ids"], "<i8")
            at, vec_ids, scores = run(left.to_pylist()[0], ids, block["query_vectors"])
            found = [ids[at], vec_ids, scores]
        kinds = {"long": pa.int64(), "double": pa.float64()}
        types = [pa.int64(), pa.int64(), kinds[score_type]]
        found = found or [[], [], []]
        return pa.table([pa.array(f, t) for f, t in zip(found, types, strict=True)], ["query_id", "vec_id", "score"])

    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(block_count - 1))))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))))
    key = ["shard", "block", "dim"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
