"""Exact top-k by inner product of whole-number vectors, with block-at-a-time pruning.

Components are the weights of terms.  A shard's vectors lie in order of id and are cut
into blocks; a block keeps the largest and least weight of each term.  The sum over the
terms of the larger of query weight times maximum and query weight times minimum bounds
every score in the block.  A query takes blocks by descending bound, scores each through
its forward index (the block's rows), and stops at the first bound below its k-th score;
an equal bound may still win by a smaller id.

See ``vectors`` for what takes part.  Scores beyond 64 bits are cut to the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm import vectors
from tripline.session import materialize

SHARD = 4_096
BLOCK = 64
K = 5


def _pack(table: pa.Table) -> pa.Table:
    ids, values = vectors.matrix(table, np.float64)
    starts = np.arange(0, len(ids), BLOCK)
    return pa.table(
        {
            "shard": table["place"][:1].cast(pa.int32()),
            "dim": table["dim"][:1].cast(pa.int32()),
            "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "rows": pa.array([np.ascontiguousarray(values).tobytes()], pa.binary()),
            "highest": pa.array([np.maximum.reduceat(values, starts).tobytes()], pa.binary()),
            "lowest": pa.array([np.minimum.reduceat(values, starts).tobytes()], pa.binary()),
        }
    )


def search_shard(shard: dict, query_ids: np.ndarray, query_bytes: bytes, k: int):
    """(query index, vec_id, score) of each query's k best in the shard, its own id left out."""
    dim = shard["dim"]
    ids = np.frombuffer(shard["ids"], "<i8")
    rows, highest, lowest = (np.frombuffer(shard[c], "<f8").reshape(-1, dim) for c in ("rows", "highest", "lowest"))
    queries = np.frombuffer(query_bytes, "<f8").reshape(-1, dim)
    # Sums below 2^53 are exact in doubles, in any order; larger ones are counted in Python's whole numbers.
    if dim * np.abs(rows).max() * np.abs(queries).max() >= 2.0**53:
        rows, highest, lowest, queries = (
            np.array([[int(x) for x in row] for row in part], object) for part in (rows, highest, lowest, queries)
        )
    bounds = np.maximum(queries, 0) @ highest.T + np.minimum(queries, 0) @ lowest.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    size = len(queries)
    top_scores = [np.zeros(0, rows.dtype)] * size
    top_ids = [np.zeros(0, np.int64)] * size
    active = np.arange(size)
    for step in range(len(highest)):
        block = order[active, step]
        open_ = np.array(
            [len(top_ids[q]) < k or bounds[q, b] >= top_scores[q][-1] for q, b in zip(active, block, strict=True)], bool
        )
        active, block = active[open_], block[open_]
        if not len(active):
            break
        for b in np.unique(block):
            asked = active[block == b]
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            scores = queries[asked] @ rows[part].T
            for q, own in zip(asked.tolist(), scores, strict=True):
                other = ids[part] != query_ids[q]
                all_scores = np.concatenate([top_scores[q], own[other]])
                all_ids = np.concatenate([top_ids[q], ids[part][other]])
                best = np.lexsort((all_ids, -all_scores))[:k]
                top_scores[q], top_ids[q] = all_scores[best], all_ids[best]
    at = np.repeat(np.arange(size), [len(t) for t in top_ids])
    scores = np.concatenate(top_scores) if size else np.zeros(0)
    whole = [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores.tolist()]
    return at, np.concatenate(top_ids) if size else at, np.array(whole, np.int64)


def top_k(df: DataFrame, queries, id_column: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors where ``queries`` (a condition on vec_id) holds."""
    rows = materialize(
        vectors.usable(df, id_column, vector, lambda x: F.floor(x * 256).cast("double")), "whole-vectors"
    )
    placed, count = vectors.grouped(rows, SHARD)
    shards = placed.groupBy("place", "dim").applyInArrow(
        _pack, "shard int, dim int, ids binary, rows binary, highest binary, lowest binary"
    )
    asked, blocks = vectors.query_blocks(rows.where(queries), "<f8")

    def run(shard, ids, data):
        return search_shard(shard, ids, data, k)

    return vectors.search(materialize(shards, "blocks"), count, asked, blocks, run, k, "long")


SQL = """
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
