"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 3 and 5 bytes (ASCII letters lowered), each hashed to a bucket with
a vector.  A text is the mean of its vectors; a softmax over a linear map of it gives the
languages.  Vectors and map are learned by stochastic gradient descent in numpy.  A
temperature makes the scores probabilities on rows kept aside, and a threshold there
rejects predictions so that those accepted err in at most ``MAX_ERROR`` of cases.

Learned from about ``PER_CLASS`` rows of each language at most, of at most
``textscore.SAMPLE_CHARS`` characters each, for the ``MAX_CLASSES`` most frequent
languages; every text is scored whole.  Null text, and text without a letter, is ``und``
with score 0; without rows to learn from every text is.  Repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.arrow import text_bytes
from tripline.llm.textscore import SAMPLE_CHARS, by_slices, lower, sample_by_class, score_texts, sums

ORDERS = (3, 5)
BITS = 15
WIDTH = 16
PER_CLASS = 1_200
MAX_CLASSES = 200
GRAMS = 192
EPOCHS = 6
BATCH = 64
RATE = 2.0
MAX_ERROR = 0.005
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # for each bucket, what it adds to each language's logit
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.languages)), np.float64)
        count = np.zeros(len(offsets) - 1)
        for which, order in enumerate(ORDERS):
            starts, ends = offsets[:-1], offsets[1:] - order + 1
            rows = self.table[buckets(data, order) + (which << BITS)]
            total += sums(rows, starts, ends)
            count += np.maximum(ends - starts, 0)
        return total / np.maximum(count, 1)[:, None] + self.bias


def buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the run that begins at each byte; runs beyond the end are padded."""
    data = np.concatenate([lower(data), np.zeros(order, np.uint8)]).astype(np.uint32)
    size = len(data) - order + 1
    code = np.zeros(size, np.uint32)
    for i in range(order):
        code *= np.uint32(0x01000193)
        code ^= data[i : i + size]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - BITS)).astype(np.int32)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5) -> Model:
    """A model from texts (bytes and offsets) and their languages' numbers."""
    rng = np.random.default_rng(seed)
    kinds = len(languages)
    longest = max(ORDERS)
    usable = np.flatnonzero(np.diff(offsets) >= longest)
    aside = usable[::5] if len(usable) >= 50 * kinds else usable
    rest = np.setdiff1d(usable, aside) if len(usable) >= 50 * kinds else usable
    runs = [buckets(data, order) + (which << BITS) for which, order in enumerate(ORDERS)]
    vectors = rng.normal(0, 0.3, (len(ORDERS) << BITS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.3, (WIDTH, kinds)).astype(np.float32)
    bias = np.zeros(kinds, np.float32)
    by_class = [rest[labels[rest] == k] for k in range(kinds)]
    largest = max(map(len, by_class), default=0)
    steps = EPOCHS * (-(-largest * kinds // BATCH))
    for step in range(steps):
        rate = RATE * (1 - step / steps)
        chosen = [by_class[k] for k in rng.integers(0, kinds, BATCH)]
        rows = np.array([c[rng.integers(len(c))] for c in chosen if len(c)])
        span = offsets[rows + 1] - offsets[rows]
        at = [
            runs[w][offsets[rows][:, None] + (rng.random((len(rows), GRAMS)) * (span - order + 1)[:, None]).astype(np.int64)]
            for w, order in enumerate(ORDERS)
        ]
        at = np.concatenate(at, 1)
        mean = vectors[at].mean(1)
        slope = softmax(mean @ weights + bias)
        slope[np.arange(len(rows)), labels[rows]] -= 1
        slope /= len(rows)
        back = (slope @ weights.T) / at.shape[1]
        weights -= rate * mean.T @ slope
        bias -= rate * slope.sum(0)
        # Rows of equal bucket add up.
        flat, inverse = np.unique(at, return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), at.shape[1])
        grown = np.zeros((len(flat), WIDTH), np.float32)
        for d in range(WIDTH):
            grown[:, d] = np.bincount(inverse.ravel(), back[owner, d], len(flat))
        vectors[flat] -= rate * len(rows) * grown
    model = Model(languages, (vectors @ weights).astype(np.float32), bias.astype(np.float64))
    return calibrated(model, data, offsets, labels, aside)


def calibrated(model: Model, data, offsets, labels, aside: np.ndarray) -> Model:
    """Sets temperature and acceptance by the rows kept aside."""
    if not len(aside):
        return model
    logits = by_slices(model.logits, data, offsets)[aside]
    truth = labels[aside]

    def loss(temperature: float) -> float:
        return -np.log(softmax(logits / temperature)[np.arange(len(aside)), truth] + 1e-12).mean()

    model.temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
    chance = softmax(logits / model.temperature)
    score, right = chance.max(1), chance.argmax(1) == truth
    order = np.argsort(-score)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= MAX_ERROR)
    model.accept = float(score[order][fine[-1]]) if len(fine) else 1.0
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from rows with text and language; None where there are none."""
    known = docs.where(F.col(lang).isNotNull() & F.length(text).between(1, SAMPLE_CHARS))
    known = known.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang"))
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_CLASSES).select("lang")
    sample = sample_by_class(known.join(F.broadcast(frequent), "lang"), "lang", PER_CLASS).orderBy("doc_id").toArrow()
    if not sample.num_rows:
        return None
    sample = sample.combine_chunks()
    languages = sorted(set(sample["lang"].to_pylist()))
    labels = np.array([languages.index(x) for x in sample["lang"].to_pylist()])
    return learn(*text_bytes(sample["text"].combine_chunks()), labels, languages)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with lang_pred, score (0 to 1) and accepted (the score is high enough to be relied on)."""
    df = df.withColumn("_lettered", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    if model is None:
        out = df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "accepted": F.lit(False)})
        return out.drop("_lettered", *([] if keep_text else [text]))
    languages = np.array(model.languages, object)

    def score(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        chance = softmax(model.logits(data, offsets) / model.temperature)
        best = chance.max(1) if len(chance) else np.zeros(0)
        return {
            "lang_pred": languages[chance.argmax(1)],
            "score": np.minimum(best, 1.0),
            "accepted": best >= model.accept,
        }

    out = score_texts(df, "lang_pred string, score double, accepted boolean", score, text, keep_text)
    seen = F.col("_lettered")
    return out.withColumns(
        {
            "lang_pred": F.when(seen, F.col("lang_pred")).otherwise(UNKNOWN),
            "score": F.when(seen, F.col("score")).otherwise(0.0),
            "accepted": seen & F.col("accepted"),
        }
    ).drop("_lettered")
