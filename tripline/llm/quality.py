"""Quality scores by Bradley-Terry ranking of document pairs.

A document is a few measures of its bytes, words and lines.  Each measure enters as one
of ``BINS`` quantile bins, so that too much and too little may both be bad.  A pair (one
document labelled 1, one labelled 0) is a won comparison; the strength of a document is
linear in its bins, and the weights come from logistic loss on differences of bins.  The
pass mark is the quantile of strengths that parts the labels best; the score is a
logistic curve that is ``PASS`` (0.7) there.

Learned from about ``PER_CLASS`` documents of each label at most; every text is scored
whole.  Empty and null texts are documents of no words.  Repeated rows stay.  Without
rows of both labels every score is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tripline.llm.arrow import release, text_bytes
from tripline.llm.textscore import by_slices, labelled_texts, logistic, score_texts, sigmoid, sums

PER_CLASS = 1_500
PAIRS = 20_000
BINS = 10
PASS = 0.7
LENIENCE = 0.004
COMMON_WORDS = 300

_KINDS = ("upper", "lower", "beyond", "digit", "space", "stop", "mark")
_KIND = np.full(256, 6, np.int64)
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[128:] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"?!-()"]] = 5
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def _runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes; runs end with their text."""
    border = np.zeros(len(member) + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], member[:-1]])
    starts = np.flatnonzero(member & (~before | border[:-1]))
    after = np.concatenate([member[1:], [False]])
    ends = np.flatnonzero(member & (~after | border[1:])) + 1
    return starts, ends


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    code = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    return sums(np.append(code, np.uint64(0)), starts, ends)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of every word (lower-cased letters and their neighbours as they are), its start and its text's number."""
    starts, ends = _runs(_KIND[data] != 4, offsets)
    return _hashes(data, starts, ends), starts, np.searchsorted(offsets, starts, side="right") - 1


def _distinct(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes of each owner."""
    mixed = code * np.uint64(0xD1342543DE82EF95) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed)
    mixed, owner = mixed[order], owner[order]
    first = np.append([True], mixed[1:] != mixed[:-1]) if len(mixed) else np.zeros(0, bool)
    return np.bincount(owner[first], minlength=n)


def measures(data: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """One row a text.  ``common``: hash buckets of frequent words (true)."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kind = _KIND[data]
    count = np.bincount(owner * 8 + kind, minlength=n * 8).reshape(n, 8)[:, :7].astype(float)
    length = np.maximum(np.diff(offsets), 1).astype(float)
    codes, starts, whose = word_hashes(data, offsets)
    words = np.bincount(whose, minlength=n).astype(float)
    some = np.maximum(words, 1)
    same = np.append([False], (codes[1:] == codes[:-1]) & (whose[1:] == whose[:-1])) if len(codes) else np.zeros(0, bool)
    known = np.bincount(whose, common[bucket(codes)], n) / some
    line_starts, line_ends = _runs(data != 10, offsets)
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_kinds = _distinct(line_owner, _hashes(data, line_starts, line_ends), n)
    letters = np.maximum(count[:, 0] + count[:, 1] + count[:, 2], 1)
    return np.stack(
        [
            np.log1p(length),
            letters / length,
            count[:, 0] / letters,
            count[:, 2] / letters,
            count[:, 3] / length,
            count[:, 5] / some,
            count[:, 6] / some,
            letters / some,
            np.bincount(whose, same, n) / some,
            _distinct(whose, codes, n) / np.sqrt(some),
            known,
            words / np.maximum(lines, 1),
            line_kinds / np.maximum(lines, 1),
        ],
        1,
    )


def bucket(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    common: np.ndarray
    edges: np.ndarray  # for each measure, the borders of its bins
    weights: np.ndarray
    mark: float
    scale: float

    def strength(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return binned(measures(data, offsets, self.common), self.edges) @ self.weights

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid((self.strength(data, offsets) - self.mark) / self.scale + np.log(PASS / (1 - PASS)))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of each measure."""
    out = np.zeros((len(x), x.shape[1], BINS))
    for k in range(x.shape[1]):
        out[np.arange(len(x)), k, np.searchsorted(edges[k], x[:, k], side="right")] = 1
    return out.reshape(len(x), -1)


def learn(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int = 3) -> Model:
    """A model from texts (bytes and offsets) and labels of which both kinds occur."""
    rng = np.random.default_rng(seed)
    frequent = by_slices(
        lambda d, o: np.bincount(bucket(word_hashes(d, o)[0]), minlength=1 << 16)[None], *_chosen(data, offsets, labels == 1)
    ).sum(0)
    common = np.zeros(1 << 16)
    common[np.argsort(-frequent, kind="stable")[:COMMON_WORDS]] = 1
    x = by_slices(lambda d, o: measures(d, o, common), data, offsets)
    # Borders are quantiles of a half-and-half mixture of both labels.
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    even = np.concatenate([rng.choice(good, 2_000), rng.choice(bad, 2_000)])
    edges = np.quantile(x[even], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    z = binned(x, edges)
    # Differences of bins are -1, 0 or 1, and the driver holds all pairs.
    signs = z.astype(np.int8)
    difference = signs[rng.choice(good, PAIRS)] - signs[rng.choice(bad, PAIRS)]
    # The winner is always first: each pair enters once in either order.
    both = np.concatenate([difference, -difference])
    won = np.concatenate([np.ones(PAIRS), np.zeros(PAIRS)])
    weights = logistic(both, won, np.ones(len(both)) / len(both), ridge=2e-4)
    strength = z @ weights
    mark = pass_mark(strength, labels)
    return Model(common, edges, weights, mark, max(float(np.std(strength)) / 2, 1e-6))


def _chosen(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)
    return data[np.repeat(which, size)], np.concatenate([[0], np.cumsum(size[which])])


def pass_mark(strength: np.ndarray, labels: np.ndarray) -> float:
    """The lowest quantile of strengths at which both labels' mean hit rate is within ``LENIENCE`` of the best."""
    marks = np.quantile(strength, np.linspace(0, 1, 401))
    marks = (marks[1:] + marks[:-1]) / 2
    good, bad = np.sort(strength[labels == 1]), np.sort(strength[labels == 0])
    hit = (1 - np.searchsorted(good, marks) / len(good)) + np.searchsorted(bad, marks) / len(bad)
    return float(marks[np.flatnonzero(hit >= hit.max() - LENIENCE)[0]])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """A model from the documents in ``docs`` that ``labels`` marks; None without both labels."""
    table, _ = labelled_texts(docs, labels, label, PER_CLASS)
    if not table.num_rows:
        return None
    table = table.combine_chunks()
    given = table["label"].to_numpy()
    if given.min() == given.max():
        return None
    model = learn(*text_bytes(table["text"].combine_chunks()), given)
    del table
    release()
    return model


def score(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if the score is at least ``PASS``)."""

    def made(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        value = model.score(data, offsets) if model else np.ones(len(offsets) - 1)
        return {"score": value, "predicted": (value >= PASS).astype(np.int32)}

    return score_texts(df, "score double, predicted int", made, text, keep_text)
