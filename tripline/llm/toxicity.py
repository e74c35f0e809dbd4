"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel counts common subsequences of four symbols with at most one other symbol
between neighbours; each such gap costs a factor ``DECAY``.  Case is folded, and white
space, other marks and letters beyond ASCII are one symbol each, so an insult with an
inserted, changed or lost character still shares most of its subsequences.

Landmarks are words, and pairs of words, with spaces around them: those that mark toxic
documents most, and common ones for contrast.  A stretch of ``WINDOW`` symbols is mapped
to its kernel values with the landmarks, made orthonormal (Nyström).  A linear SVM with
squared hinge loss is trained on the sentences' stretches: of a toxic document the worst
one and those nearly as bad, of another the worst few, chosen again by each round's machine (multiple-instance
learning).  A document's score is a logistic curve of its worst stretch and of how many
lie beyond the margin.

As kernel and machine are linear in the landmarks' explicit subsequences, the trained
machine is one table from subsequence to weight, so each text is scored in one pass.

Learned from about ``PER_CLASS`` documents of each label at most; every text is scored
whole.  Null and empty text has no stretch and scores as low as any.  Repeated rows stay.
Without rows of both labels every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripline.llm.arrow import text_bytes
from tripline.llm.textscore import by_slices, labelled_texts, logistic, maxima, score_texts, sigmoid

PER_CLASS = 1_500
ORDER = 4
DECAY = 0.5
WINDOW = 14
MARKED = 96
CONTRAST = 96
ROUNDS = 3
COST = 1.0

#: How far each later symbol lies from the first, for each choice of gaps; and its weight.
PATTERNS = [
    (np.cumsum([0, *(1 + g for g in gaps)]).tolist(), DECAY ** sum(gaps)) for gaps in product((0, 1), repeat=ORDER - 1)
]
SPAN = 2 * ORDER - 1

_SYMBOL = np.full(256, 27, np.uint32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 28
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0


def codes(data: np.ndarray):
    """For each pattern, the subsequence that begins at each byte (padded at the end), and its weight."""
    n = len(data)
    symbols = np.concatenate([_SYMBOL[data], np.zeros(SPAN, np.uint32)])
    first = symbols[:n] << np.uint32(5 * (ORDER - 1))
    for places, weight in PATTERNS:
        code = first.copy()
        for k, place in enumerate(places[1:], 1):
            code |= symbols[place : place + n] << np.uint32(5 * (ORDER - 1 - k))
        yield code, weight


def stretch_sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the sum of ``table`` over the subsequences that begin in the next ``WINDOW`` bytes of its text."""
    n = len(data)
    each = np.zeros(n, np.float32)
    for code, weight in codes(data):
        each += np.float32(weight) * table[code]
    # Nothing may begin where it would reach into the next text.
    for back in range(1, ORDER):
        at = offsets[1:] - back
        each[at[at >= offsets[:-1]]] = 0
    running = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    until = np.minimum(np.arange(n) + WINDOW, np.repeat(offsets[1:], np.diff(offsets)))
    return running[until] - running[:-1]


def subsequences(data: np.ndarray) -> dict[int, float]:
    """Weighted counts of a string's subsequences: the kernel's explicit map."""
    out: Counter = Counter()
    if len(data) < ORDER:
        return out
    for (code, weight), (places, _) in zip(codes(data), PATTERNS, strict=True):
        for c in code[: max(0, len(data) - places[-1])].tolist():
            out[c] += weight
    return out


@dataclass
class Machine:
    """A linear machine over windows, as a table over subsequences."""

    table: np.ndarray
    bias: float
    curve: np.ndarray | None = None

    def traits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: one, its worst stretch, and the logarithm of how many bytes begin a stretch beyond the border."""
        value = stretch_sums(self.table, data, offsets) + self.bias
        padded = np.append(value, -np.inf)
        worst = maxima(padded, offsets[:-1], offsets[1:], -2.0)
        beyond = np.add.reduceat(np.append(value > 0, False).astype(np.int64), offsets[:-1]) if len(worst) else worst
        beyond = np.where(np.diff(offsets) > 0, beyond, 0)
        return np.stack([np.ones(len(worst)), np.clip(worst, -2, 6), np.log1p(beyond)], 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.traits(data, offsets) @ self.curve)


def landmarks(texts: list[str], labels: np.ndarray) -> list[tuple[str, float]]:
    """Strings and how much each marks toxic documents (0 for contrast)."""
    seen = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels.tolist(), strict=True):
        found = "".join(c if c.isalpha() and c.isascii() else " " if c.isspace() else "" for c in text.lower()).split()
        seen[label].update({w for w in found if len(w) >= 3} | {f"{a} {b}" for a, b in zip(found, found[1:])})
    size = {k: max(int((labels == k).sum()), 1) for k in (0, 1)}
    odds = {
        w: np.log((n + 0.5) / size[1]) - np.log((seen[0][w] + 0.5) / size[0]) for w, n in seen[1].items() if n >= 3
    }
    gain = {w: o * seen[1][w] / size[1] for w, o in odds.items() if o > 0}
    top = sorted(gain, key=lambda w: (-gain[w], w))[:MARKED]
    common = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if w not in top and len(w) >= ORDER]
    return [(f" {w} ", odds[w]) for w in top] + [(f" {w} ", 0.0) for w in common[:CONTRAST]]


def altered(text: str, words: set[str], rng: np.random.Generator) -> str:
    """``text`` with a mark put into, or in place of a letter of, each of ``words``."""

    def change(match: re.Match) -> str:
        word = match.group()
        if word.lower() not in words:
            return word
        at, mark = int(rng.integers(1, len(word) - 1)), "*.-_ "[int(rng.integers(5))]
        return word[:at] + mark + word[at + int(rng.integers(2)) :]

    return re.sub("[A-Za-z]{4,}", change, text)


def learn(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, share: float, seed: int = 1) -> Machine | None:
    """A machine from texts and labels of which both kinds occur; ``share``: of toxic documents among all labelled."""
    texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    held = np.zeros(len(labels), bool)  # for the curve, not for the machine
    for side in (0, 1):
        held[np.flatnonzero(labels == side)[3::4]] = min((labels == 0).sum(), (labels == 1).sum()) >= 40
    marks = landmarks([t for t, h in zip(texts, held, strict=True) if not h], labels[~held])
    # Toxic texts once more with their marked words altered, so that the machine expects it.
    words = {w.strip() for w, odd in marks if odd > 0}
    rng = np.random.default_rng(seed)
    again = np.flatnonzero(labels == 1)
    data, offsets = text_bytes(pa.array([*texts, *(altered(texts[i], words, rng) for i in again.tolist())], pa.string()))
    labels, held = np.concatenate([labels, labels[again]]), np.concatenate([held, held[again]])
    maps = [subsequences(np.frombuffer(s.encode(), np.uint8)) for s, _ in marks]
    place = {c: i for i, c in enumerate(sorted({c for m in maps for c in m}))}
    if not place or not any(odd > 0 for _, odd in marks):
        return None
    explicit = np.zeros((len(marks), len(place)), np.float32)
    for row, m in enumerate(maps):
        for c, v in m.items():
            explicit[row, place[c]] = v
    explicit /= np.linalg.norm(explicit, axis=1, keepdims=True) + 1e-12
    values, vectors = np.linalg.eigh(explicit @ explicit.T)
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])  # Nyström: K^(-1/2)
    slot = np.zeros(1 << (5 * ORDER), np.int64) - 1
    slot[list(place)] = list(place.values())

    def machine(direction: np.ndarray, bias: float) -> Machine:
        table = np.zeros(1 << (5 * ORDER), np.float32)
        table[list(place)] = direction @ explicit
        return Machine(table, bias)

    symbols = np.concatenate([_SYMBOL[data], np.zeros(SPAN + WINDOW, np.uint32)])

    def nystroem(starts: np.ndarray) -> np.ndarray:
        """The stretches' kernel values with the landmarks, whitened."""
        dense = np.zeros((len(starts), len(place) + 1), np.float32)
        rows = np.repeat(np.arange(len(starts)), WINDOW)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        at = starts[:, None] + np.arange(WINDOW)
        inside = (at < (offsets[owner + 1] - ORDER + 1)[:, None]).ravel()
        at, rows = at.ravel()[inside], rows[inside]
        for places, weight in PATTERNS:
            code = np.zeros(len(at), np.uint32)
            for k, far in enumerate(places):
                code |= symbols[at + far] << np.uint32(5 * (ORDER - 1 - k))
            np.add.at(dense, (rows, slot[code]), np.float32(weight))
        return (dense[:, :-1] @ explicit.T) @ whiten

    odds = np.array([o for _, o in marks])
    current = machine(odds / (odds.max() + 1e-9), 0.0)
    train_rows = np.flatnonzero(~held & (np.diff(offsets) > 0))
    for _ in range(ROUNDS):
        value = by_slices(lambda d, o: stretch_sums(current.table, d, o), data, offsets)
        starts, sides = [], []
        for row in train_rows.tolist():
            part = value[offsets[row] : offsets[row + 1]].copy()
            least = max(part.max() * 0.4, -current.bias) if labels[row] else -np.inf
            for k in range(4):  # its worst stretches, apart from each other
                best = int(part.argmax())
                if k and part[best] <= least:
                    break
                starts.append(offsets[row] + best)
                sides.append(1.0 if labels[row] else -1.0)
                part[max(0, best - WINDOW) : best + WINDOW] = -np.inf
            if not labels[row]:
                starts.append(offsets[row] + int(rng.integers(len(part))))
                sides.append(-1.0)
        places, y = np.array(starts), np.array(sides)
        x = np.concatenate([nystroem(places[i : i + 500]) for i in range(0, len(places), 500)])
        beta = squared_hinge(np.column_stack([x, np.ones(len(x))]), y)
        current = machine(whiten @ beta[:-1], float(beta[-1]))
    rows = np.flatnonzero(held) if held.any() else np.arange(len(labels))
    traits, truth = by_slices(current.traits, data, offsets)[rows], labels[rows].astype(float)
    part = max(truth.mean(), 1e-3)
    weight = np.where(truth == 1, share / part, (1 - share) / max(1 - part, 1e-3)) / len(rows)
    current.curve = logistic(traits, truth, weight, ridge=1e-4)
    return current


def squared_hinge(x: np.ndarray, y: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A linear SVM with squared hinge loss, both sides weighing the same, by Newton steps; the last column is ones."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * COST * len(y)
    beta = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ beta) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), xa.T @ (wa * y[active]))
        if np.abs(new - beta).max() < 1e-6:
            break
        beta = new
    return beta


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine | None:
    """A machine from the documents in ``docs`` that ``labels`` marks; None without both labels."""
    table, counts = labelled_texts(docs, labels, label, PER_CLASS)
    if not table.num_rows:
        return None
    table = table.combine_chunks()
    given = table["label"].to_numpy()
    if given.min() == given.max():
        return None
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    return learn(*text_bytes(table["text"].combine_chunks()), given, share)


def score(df: DataFrame, machine: Machine | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if the score is at least 0.5)."""

    def made(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        value = machine.score(data, offsets) if machine else np.zeros(len(offsets) - 1)
        return {"score": value, "predicted": (value >= 0.5).astype(np.int32)}

    return score_texts(df, "score double, predicted int", made, text, keep_text)
