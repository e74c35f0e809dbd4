"""Hard negatives by exact inner products of whole-number vectors, several candidates a multiplication.

A shard packs its candidates: their components, made non-negative by one bias, lie in
separated fields of one wide integer for each component.  An anchor's component (biased,
too) is multiplied once with that integer, the products are added up, and the fields of
the sum, less what the biases added, are the exact scores of all packed candidates.  Where
two fields or more fit into the 53 bits of a double's whole numbers, the integers are
doubles and the products are one matrix product; else they are Python's, of any width.

Anchors are sent to the shards in blocks, twice: once for the positives (the best of the
anchor's label), then for the negatives whose score lies within ``band`` percent of a
positive's.  Shards stay in one task and read blocks one after the other; a shard passes on
the best ``positives`` or ``negatives`` of each anchor or pair only.

A row takes part if id, label and vector are not null and the vector holds at least one
component, all of them present and finite.  Rows equal in id, label and components are one.
Other rows of one id are rows of their own: each is a candidate, and an anchor with results
of its own, but never a candidate of its own id.  Only vectors of equal length are
compared.  Scores beyond 64 bits are cut to the nearest long before they are compared.
An empty table gives an empty table.  More columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripline.session import materialize

#: Bytes of a shard's vectors, and its least rows if that leaves fewer shards than the cluster has slots.
SHARD_BYTES = 64 << 20
LEAST_ROWS = 4_096
ANCHORS_IN_BLOCK = 256
#: Candidates in one of Python's integers.
WIDE = 64
#: Scores of a block that are held at once.
CHUNK = 1 << 22

_FOUND = "anchor_no long, slot int, vec_id long, score long"


class Packed:
    """Candidates (rows of whole numbers, all between ``low`` and ``high``) in fields of wide integers."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.size, self.dim = rows.shape
        self.low = low
        self.width = max(1, (self.dim * (high - low) ** 2).bit_length())
        self.fields = 53 // self.width
        self.doubles = self.fields > 1 and self.dim * max(abs(low), abs(high)) ** 2 < 1 << 53
        if self.doubles:
            biased = np.zeros((-(-self.size // self.fields) * self.fields, self.dim))
            biased[: self.size] = rows - low
            places = 2.0 ** (self.width * np.arange(self.fields))
            self.words = np.tensordot(places, biased.reshape(-1, self.fields, self.dim), (0, 1))
            self.sums = rows.sum(1).astype(np.int64)
        else:
            self.fields = WIDE
            whole = [[int(x) for x in row] for row in rows]
            self.words = [
                [sum((row[j] - low) << (self.width * i) for i, row in enumerate(part)) for j in range(self.dim)]
                for part in (whole[k : k + WIDE] for k in range(0, self.size, WIDE))
            ]
            self.sums = np.array([sum(row) for row in whole], object)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """The inner product of each anchor with each candidate; whole numbers of 64 bits, or Python's."""
        mask = (1 << self.width) - 1
        if self.doubles:
            products = ((anchors - self.low) @ self.words.T).astype(np.int64)
            parts = [(products >> (self.width * i)) & mask for i in range(self.fields)]
            fields = np.stack(parts, 2).reshape(len(anchors), -1)[:, : self.size]
            own = anchors.sum(1).astype(np.int64)
        else:
            whole = [[int(x) for x in row] for row in anchors]
            fields = np.empty((len(whole), self.size), object)
            for at, row in enumerate(whole):
                sums = [sum((x - self.low) * w for x, w in zip(row, words, strict=True)) for words in self.words]
                fields[at] = [(sums[k // WIDE] >> (self.width * (k % WIDE))) & mask for k in range(self.size)]
            own = np.array([sum(row) for row in whole], object)
        out = fields + self.low * own[:, None] + self.low * self.sums[None, :] - self.dim * self.low**2
        return out if self.doubles else np.clip(out, -(2**63), 2**63 - 1)


def usable(df: DataFrame, id_column: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part, each once."""
    parts = F.col(vector).cast("array<double>")
    ok = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_column).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & ok)
    whole = F.transform(parts, lambda x: F.floor(x * 256).cast("double"))
    return rows.select(
        F.col(id_column).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector")
    ).distinct()


def _matrix(table: pa.Table) -> np.ndarray:
    values = table["vector"].combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _bytes(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).astype(kind, copy=False).tobytes()], pa.binary())


_PACK = "place int, dim int, nos binary, ids binary, labels binary, vectors binary, wanted binary, slots int"


def _pack(table: pa.Table) -> pa.Table:
    """The rows of one place as one row, in order of id; ``wanted`` has each anchor's positive scores and their number."""
    table = table.combine_chunks().sort_by("vec_id")
    empty = pa.array([b""], pa.binary())
    nos = _bytes(table["anchor_no"].to_numpy(), "<i8") if "anchor_no" in table.column_names else empty
    wanted, slots = empty, 0
    if "wanted" in table.column_names:
        lists = table["wanted"].to_pylist()
        slots = max(map(len, lists))
        padded = [[len(scores), *scores, *[0] * (slots - len(scores))] for scores in lists]
        wanted = _bytes(np.array(padded, np.int64), "<i8")
    return pa.table(
        {
            "place": table["place"][:1].cast(pa.int32()),
            "dim": table["dim"][:1].cast(pa.int32()),
            "nos": nos,
            "ids": _bytes(table["vec_id"].to_numpy(), "<i8"),
            "labels": _bytes(table["label"].to_numpy(), "<i8"),
            "vectors": _bytes(_matrix(table), "<f8"),
            "wanted": wanted,
            "slots": pa.array([slots], pa.int32()),
        }
    )


def _placed(rows: DataFrame, places: int, *salt: str) -> DataFrame:
    place = F.pmod(F.xxhash64("vec_id", *salt), F.lit(places)).cast("int")
    packed = rows.withColumn("dim", F.size("vector")).withColumn("place", place).groupBy("place", "dim")
    return packed.applyInArrow(_pack, _PACK)


def _best(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of ``places`` (ascending) with the highest scores, ties to the earlier."""
    if len(places) > k and scores.dtype != object:
        least = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= least]
    order = sorted(range(len(places)), key=lambda i: (-scores[places[i]], i))[:k]
    return places[order]


def _meet(low: int, high: int, k: int, band: tuple[int, int] | None):
    """Rows (place, kind, ...) sorted by place, dim and kind to what each shard found for each block of anchors.

    Without ``band`` the best of the anchor's label, else for each positive the best of other labels within it.
    """

    def search(shard, block) -> pa.RecordBatch:
        ids, labels, packed = shard
        dim = packed.dim
        nos, own, kinds = (np.frombuffer(block[c], "<i8") for c in ("nos", "ids", "labels"))
        vectors = np.frombuffer(block["vectors"], "<f8").reshape(-1, dim)
        wanted = np.frombuffer(block["wanted"], "<i8").reshape(len(own), -1) if band else None
        out: list[list] = [[], [], [], []]

        def add(at: int, slot: int, scores: np.ndarray, places: np.ndarray) -> None:
            chosen = _best(scores, places, k)
            for column, values in zip(
                out, ([int(nos[at])] * len(chosen), [slot] * len(chosen), ids[chosen], scores[chosen]), strict=True
            ):
                column.extend(values)

        step = max(1, CHUNK // max(len(ids), 1))
        for start in range(0, len(own), step):
            for at, scores in enumerate(packed.scores(vectors[start : start + step]), start):
                other = ids != own[at]
                if not band:
                    add(at, 0, scores, np.flatnonzero((labels == kinds[at]) & other))
                    continue
                goals = wanted[at, 1 : 1 + wanted[at, 0]].tolist()
                apart = np.flatnonzero((labels != kinds[at]) & other)
                hundred = scores[apart] * 100
                for slot, goal in enumerate(goals):
                    inside = (hundred >= band[0] * goal) & (hundred <= band[1] * goal)
                    add(at, slot, scores, apart[inside.astype(bool)])
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array([int(x) for x in c], t) for c, t in zip(out, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["anchor_no", "slot", "vec_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    name = (row["place"], row["dim"])
                    rows = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                    shard = (
                        np.frombuffer(row["ids"], "<i8"),
                        np.frombuffer(row["labels"], "<i8"),
                        Packed(rows, low, high),
                    )
                elif name == (row["place"], row["dim"]):
                    yield search(shard, row)

    return run


def _search(shards: DataFrame, places: int, anchors: DataFrame, low: int, high: int, k: int, band) -> DataFrame:
    """anchor_no, slot, rank, vec_id, score of the ``k`` best of all shards."""
    blocks = max(1, math.ceil(anchors.count() / ANCHORS_IN_BLOCK))
    asked = materialize(_placed(anchors, blocks, "anchor_no"), "anchor-blocks")
    asked = asked.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1)))).withColumn("kind", F.lit(1))
    both = shards.withColumn("kind", F.lit(0)).unionByName(asked).repartition(places, "place")
    found = both.sortWithinPartitions("place", "dim", "kind").mapInArrow(_meet(low, high, k, band), _FOUND)
    best = Window.partitionBy("anchor_no", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    anchors: Column,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where ``anchors`` (a condition on vec_id and label) holds.  A negative
    of a positive p has another label than the anchor, and band[0] % of p's score <= its score
    <= band[1] % of it.  An anchor without positives, or a positive without negatives, has no row.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = materialize(usable(df, id_column, vector, label), "whole-vectors")
    size, dim, low, high = rows.agg(
        F.count("*"), F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))
    ).first()
    low, high, dim = int(low or 0), int(high or 0), dim or 1
    by_memory = math.ceil(size * dim * 8 / SHARD_BYTES)
    places = max(1, by_memory, min(math.ceil(size / LEAST_ROWS), 4 * spark.sparkContext.defaultParallelism))
    shards = materialize(_placed(rows, places), "shards")
    asked = rows.where(anchors).withColumn("anchor_no", F.monotonically_increasing_id())
    asked = materialize(asked, "anchors")

    first = _search(shards, places, asked, low, high, positives, None)
    first = materialize(
        first.select("anchor_no", (F.col("rank") - 1).alias("slot"), "vec_id", "score"), "positives"
    )
    goals = first.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("goals"))
    goals = goals.select("anchor_no", F.col("goals.score").alias("wanted"))
    found = _search(shards, places, asked.join(goals, "anchor_no"), low, high, negatives, band)
    return (
        found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(first.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), ["anchor_no", "slot"])
        .join(asked.select("anchor_no", F.col("vec_id").alias("anchor_id")), "anchor_no")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


SQL = """
WITH usable AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT *, row_number() OVER () AS anchor_no FROM usable WHERE vec_id % 100 = 0),
scored AS (SELECT a.anchor_no, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.v, c.v)::BIGINT AS score
  FROM anchors a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
placed AS (SELECT *, row_number() OVER (PARTITION BY anchor_no ORDER BY score DESC, vec_id) AS slot FROM scored
  WHERE same),
ranked AS (SELECT n.anchor_id, p.vec_id AS positive_id,
    (row_number() OVER (PARTITION BY n.anchor_no, p.slot ORDER BY n.score DESC, n.vec_id))::INT AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM placed p JOIN scored n ON p.anchor_no = n.anchor_no
  WHERE p.slot <= 5 AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT * FROM ranked WHERE rank <= 10
"""
