"""Approximate nearest neighbours by cosine: one navigable small-world graph a shard.

Vectors are dealt over shards of about ``SHARD`` by a hash of their id.  A shard's graph
is kept as flat arrays: each node's level, and its neighbours layer by layer in slots of
fixed number.  Equal vectors of a shard are one node with its smallest ids, which is all
a result can need.  Every query searches every shard; what is found is scored anew in
double precision on the original vectors, and the shards' results are merged.

See ``vectors`` for what takes part; vectors of length zero (all components 0) don't.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm import vectors
from tripline.session import materialize

SHARD = 2_048
LINKS = 12
BUILD_WIDTH = 48
SEARCH_WIDTH = 64
K = 5
_FREE = -1


class Graph:
    """A graph over unit vectors.  ``links[offsets[i]:]`` holds node i's 2 * LINKS slots of layer 0, then LINKS a layer."""

    def __init__(self, units: np.ndarray, levels: np.ndarray, links: np.ndarray, entry: int):
        self.units, self.levels, self.links, self.entry = units, levels, links, entry
        slots = LINKS * (2 + levels.astype(np.int64))
        self.offsets = np.cumsum(slots) - slots

    def slots(self, node: int, layer: int) -> np.ndarray:
        start = self.offsets[node] + (LINKS * (layer + 1) if layer else 0)
        return self.links[start : start + (LINKS if layer else 2 * LINKS)]

    def walk(self, query: np.ndarray, entries: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` most similar nodes reached in a layer, as (similarity, node), best first."""
        seen = np.zeros(len(self.units), bool)
        seen[[n for _, n in entries]] = True
        open_ = [(-s, n) for s, n in entries]
        heapq.heapify(open_)
        best = list(entries)
        heapq.heapify(best)
        while open_:
            near, node = heapq.heappop(open_)
            if len(best) >= width and -near < best[0][0]:
                break
            others = self.slots(node, layer)
            others = others[others != _FREE]
            others = others[~seen[others]]
            if not len(others):
                continue
            seen[others] = True
            for s, n in zip((self.units[others] @ query).tolist(), others.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, n))
                    heapq.heappush(open_, (-s, n))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, n))
                    heapq.heappush(open_, (-s, n))
        return sorted(best, reverse=True)

    def search(self, query: np.ndarray, width: int) -> list[int]:
        at = [(float(self.units[self.entry] @ query), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = self.walk(query, at, 1, layer)
        return [n for _, n in self.walk(query, at, width, 0)]

    def spread(self, nodes: np.ndarray, similarity: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the nodes (best first), each nearer to the centre than to those taken; then the best of the rest."""
        between = self.units[nodes] @ self.units[nodes].T
        taken: list[int] = []
        closest = np.full(len(nodes), -np.inf, np.float32)
        for k in range(len(nodes)):
            if closest[k] < similarity[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                np.maximum(closest, between[k], out=closest)
        if len(taken) < most:
            rest = [k for k in range(len(nodes)) if k not in set(taken)]
            taken += rest[: most - len(taken)]
        return nodes[taken]

    def insert(self, node: int) -> None:
        query, level = self.units[node], int(self.levels[node])
        at = [(float(self.units[self.entry] @ query), self.entry)]
        top = int(self.levels[self.entry])
        for layer in range(top, level, -1):
            at = self.walk(query, at, 1, layer)
        for layer in range(min(top, level), -1, -1):
            at = self.walk(query, at, BUILD_WIDTH, layer)
            chosen = self.spread(
                np.array([n for _, n in at], np.int32), np.array([s for s, _ in at], np.float32), LINKS
            )
            self.slots(node, layer)[: len(chosen)] = chosen
            for other in chosen.tolist():
                self.link(other, node, layer)
        if level > top:
            self.entry = node

    def link(self, node: int, new: int, layer: int) -> None:
        slots = self.slots(node, layer)
        free = np.flatnonzero(slots == _FREE)
        if len(free):
            slots[free[0]] = new
            return
        others = np.append(slots, np.int32(new))
        similarity = self.units[others] @ self.units[node]
        order = np.argsort(-similarity, kind="stable")
        kept = self.spread(others[order], similarity[order], len(slots))
        slots[:] = _FREE
        slots[: len(kept)] = kept


def build(units: np.ndarray, seed: int = 11) -> Graph:
    """A graph over unit vectors (float32), of which there is at least one."""
    n = len(units)
    levels = np.minimum(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(LINKS), 12).astype(np.int8)
    graph = Graph(units, levels, np.full(int((LINKS * (2 + levels.astype(np.int64))).sum()), _FREE, np.int32), 0)
    for node in range(1, n):
        graph.insert(node)
    return graph


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large and very small ones survive."""
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _pack(table: pa.Table, k: int) -> pa.Table:
    ids, values = vectors.matrix(table, np.float64)
    distinct, group = np.unique(values, axis=0, return_inverse=True)
    group = group.ravel()
    order = np.lexsort((ids, group))
    first = np.searchsorted(group[order], group[order], side="left")
    kept = order[np.arange(len(order)) - first <= k]  # the k + 1 smallest ids of each distinct vector
    graph = build(unit(distinct).astype(np.float32))
    return pa.table(
        {
            "shard": table["place"][:1].cast(pa.int32()),
            "dim": table["dim"][:1].cast(pa.int32()),
            "entry": pa.array([graph.entry], pa.int32()),
            "levels": pa.array([graph.levels.tobytes()], pa.binary()),
            "links": pa.array([graph.links.astype("<i4").tobytes()], pa.binary()),
            "rows": pa.array([distinct.astype("<f8").tobytes()], pa.binary()),
            "ids": pa.array([ids[kept].astype("<i8").tobytes()], pa.binary()),
            "nodes": pa.array([group[kept].astype("<i4").tobytes()], pa.binary()),
        }
    )


_SHARDS = (
    "shard int, dim int, entry int, levels binary, links binary, rows binary, ids binary, nodes binary"
)


def search_shard(shard: dict, query_ids: np.ndarray, query_bytes: bytes, k: int, width: int):
    """(query index, vec_id, cosine) of each query's k best found in the shard, its own id left out."""
    rows = np.frombuffer(shard["rows"], "<f8").reshape(-1, shard["dim"])
    exact = unit(rows)
    graph = Graph(
        exact.astype(np.float32),
        np.frombuffer(shard["levels"], np.int8),
        np.frombuffer(shard["links"], "<i4"),
        shard["entry"],
    )
    ids, nodes = np.frombuffer(shard["ids"], "<i8"), np.frombuffer(shard["nodes"], "<i4")
    bounds = np.searchsorted(nodes, np.arange(len(rows) + 1))
    queries = unit(np.frombuffer(query_bytes, "<f8").reshape(-1, shard["dim"]))
    out: tuple[list, list, list] = ([], [], [])
    for q, query in enumerate(queries):
        found = np.array(graph.search(query.astype(np.float32), width))
        cosine = exact[found] @ query
        counts = bounds[found + 1] - bounds[found]
        at = np.repeat(bounds[found] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        score = np.repeat(cosine, counts)
        own = ids[at] != query_ids[q]
        at, score = at[own], score[own]
        best = np.lexsort((ids[at], -score))[:k]
        out[0].append(np.full(len(best), q))
        out[1].append(ids[at][best])
        out[2].append(score[best])
    return tuple(np.concatenate(part) for part in out)


def nearest(
    df: DataFrame, queries, id_column: str = "vec_id", vector: str = "embedding", k: int = K, width: int = SEARCH_WIDTH
) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for the vectors where ``queries`` (a condition on vec_id) holds."""
    rows = vectors.usable(df, id_column, vector, lambda x: x).where(F.exists("vector", lambda x: x != 0))
    rows = materialize(rows, "vectors")
    placed, count = vectors.grouped(rows, SHARD)
    graphs = materialize(placed.groupBy("place", "dim").applyInArrow(lambda t: _pack(t, k), _SHARDS), "graphs")
    asked, blocks = vectors.query_blocks(rows.where(queries), "<f8")

    def run(shard, ids, data):
        return search_shard(shard, ids, data, k, width)

    return vectors.search(graphs, count, asked, blocks, run, k, "double")
