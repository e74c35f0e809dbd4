"""Learning from labelled documents on the driver and scoring every document in tasks.

A sample of labelled rows, bounded by the caller, goes to the driver; the model that
comes of it is small and goes to every task.  Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripline.llm.arrow import slices, small_batches, text_bytes, with_columns

#: Longer texts are not used for learning (they are scored like all others).
SAMPLE_CHARS = 100_000
SLICE_BYTES = 1 << 20
#: Learning on the driver works on so many bytes of text, or rows of a matrix, at a time.
LEARN_BYTES = 1 << 17
LEARN_ROWS = 2_048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def sample_by_class(rows: DataFrame, label: str, per_class: int, id_column: str = "doc_id") -> DataFrame:
    """About ``per_class`` rows of each label at most, chosen by a hash of the id."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    picked = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column)), F.lit(1 << 40)) < (
        F.lit(float(1 << 40)) * per_class / F.col("_n")
    )
    return rows.join(F.broadcast(counts.limit(10_000)), label).where(picked).drop("_n")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[pa.Table, dict[int, int]]:
    """(text, label) of a bounded sample, and how many labelled rows each label has.

    ``docs`` holds the documents that may be learned from.  A document with several
    labels takes the one given most often, the higher if tied; null labels don't count.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    )
    # The ids of the sample are few, so texts are filtered where they are read.
    ids = docs.select("doc_id").distinct().join(known, "doc_id")
    counts = {row["label"]: row["n"] for row in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = sample_by_class(ids, "label", per_class)
    texts = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
    # Copies of an id may differ in text; one of them is enough to learn from.
    table = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return table.orderBy("doc_id").toArrow(), counts


def score_texts(
    df: DataFrame,
    outputs: str,
    score: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``df`` with the columns ``score`` makes of (bytes, offsets) of its texts; null is empty text.

    A column of ``df`` with the name of an output is replaced.
    """
    made = T.StructType.fromDDL(outputs).fields
    df = df.drop(*[f.name for f in made])
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                columns = {k: pa.array(v) for k, v in score(*text_bytes(part.column(text))).items()}
                yield with_columns(part if keep_text else part.drop_columns([text]), **columns)

    return small_batches(df).mapInArrow(run, schema)


def by_slices(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``fn`` of all texts, some ``LEARN_BYTES`` at a time."""
    out, low, n = [], 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + LEARN_BYTES, side="right")) - 1)
        out.append(fn(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]))
        low = high
    return np.concatenate(out)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each start up to its end; ``values`` reaches beyond the last end."""
    return _reduced(np.add, values, starts, ends, 0)


def maxima(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, empty: float) -> np.ndarray:
    return _reduced(np.maximum, values, starts, ends, empty)


def _reduced(how: np.ufunc, values, starts, ends, empty):
    if not len(starts):
        return np.zeros((0, *values.shape[1:]), values.dtype)
    pairs = np.stack([starts, np.maximum(ends, starts)], 1).ravel()
    out = how.reduceat(values, pairs, axis=0)[::2]
    out[ends <= starts] = empty
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression by Newton steps; x carries its own column of ones.

    x may hold small integers; a step turns ``LEARN_ROWS`` rows into floats at a time.
    """
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        slope, bend = ridge * beta, (ridge + 1e-9) * np.eye(x.shape[1])
        for low in range(0, len(x), LEARN_ROWS):
            rows = slice(low, low + LEARN_ROWS)
            part = x[rows].astype(float)
            p = sigmoid(part @ beta)
            slope += part.T @ (weight[rows] * (p - y[rows]))
            bend += (part * (weight[rows] * p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(bend, slope)
        beta -= step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return beta
