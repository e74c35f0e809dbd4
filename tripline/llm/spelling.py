"""Words grouped with their spelling variants: all pairs one edit apart in a sorted vocabulary.

An edit is one inserted, deleted or replaced code point.

* Lists: two words one edit apart share their first or their last half (of the shorter's
  length), so words are dealt by both halves; a list of more than ``LIMIT`` words is dealt
  again by the halves of what is left between the parts shared already, and so on.  What is
  left ends at one code point, where a list is bounded by the alphabet.  A pair belongs to
  exactly one list: that of the first halves if it shares them, else that of the last.
* Scan: a list is sorted.  The edit matrix of a word against the list has one row for each
  prefix of the list's words; only the three cells next to the diagonal can be within one
  edit.  Adjacent words reuse the rows of the prefix that they share (their LCP), and a range
  of the list is skipped from the first row on that has no cell within one edit.  All words
  of a list are scanned together, one depth of the rows after the other, in blocks.
* Forms: a word's form is its near word of largest count, if that is at least twice its
  own.  Counts at least double along a chain of forms, so a few rounds of pointer jumping
  reach every root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.llm.arrow import slices, small_batches
from tripline.llm.neardup import by_key
from tripline.operators.joins import lookup
from tripline.session import materialize

#: Above the most words that differ in one place alone, if letters are those of ``vocabulary``.
LIMIT = 20_000
#: Words scanned against their lists at once.
BLOCK = 4_096
#: Distinct words that a task holds before it passes them on.
HELD = 200_000

_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Runs in UTF-8: letters, and U+00C0 to U+00FF.
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+").findall
_NONE = np.uint32(0xFFFFFFFF)


def altered(word: bytes, doc_id: int | None, divisor: int, seed: int) -> bytes:
    """``word`` without one code point if ``divisor`` divides the crc32 of ``<doc_id>:<word>``."""
    if doc_id is None or not divisor:
        return word
    h = zlib.crc32(word, seed)
    if h % divisor:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, divisor: int = 0) -> DataFrame:
    """word, n (occurrences) of the runs of letters in all whole texts of ``docs`` (doc_id, text).

    Letters are A-Z (lowered), a-z and U+00C0 to U+00FF.  With ``divisor``, runs are altered as
    ``altered`` says; in rows without doc_id none is.  Repeated rows count again; null and empty
    texts have no runs.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()), strict=True):
                    data = (text.as_py() or b"").lower()
                    words = Counter(data.translate(_LETTERS).split() if data.isascii() else _RUNS(data))
                    seed = zlib.crc32(b"%d:" % doc_id) if doc_id is not None else 0
                    for word, n in words.items():
                        if len(word) < least_length:
                            continue
                        word = altered(word, doc_id, divisor, seed)
                        if len(word) >= least_length and (word.isascii() or len(word.decode()) >= least_length):
                            held[word] += n
                    if len(held) > HELD:
                        yield out()
        if held:
            yield out()

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, and each text's start and length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.append(codes, _NONE), np.cumsum(lengths) - lengths, lengths


def _shared(codes, starts, lengths, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each pair of texts."""
    out = np.minimum(lengths[one], lengths[other])
    open_ = np.arange(len(one))
    depth = 0
    while len(open_):
        open_ = open_[out[open_] > depth]
        same = codes[starts[one[open_]] + depth] == codes[starts[other[open_]] + depth]
        out[open_[~same]] = depth
        open_ = open_[same]
        depth += 1
    return out


def near_pairs(group: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs (of row numbers) of one ``group`` whose texts are exactly one edit apart.

    Rows are sorted by group and text, in code-point order; the texts of a group are distinct.
    """
    codes, starts, lengths = _codes(texts)
    size = len(texts)
    rows = np.arange(size)
    lcp = np.full(size, -1)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[inner] = _shared(codes, starts, lengths, inner - 1, inner)
    # The ranges of words with a common prefix of each depth: their first rows, and where their parts begin.
    ranges = [np.flatnonzero(lcp < 0)]
    for depth in range(1, int(lengths.max(initial=0)) + 2):
        ranges.append(np.flatnonzero(lcp < depth))
    parts = [np.append(np.searchsorted(after, now), len(after)) for now, after in zip(ranges, ranges[1:], strict=False)]
    own = np.searchsorted(ranges[0], rows, side="right") - 1
    lefts, rights = [], []

    def letter(query: np.ndarray, place: int) -> np.ndarray:
        inside = (place < lengths[query]) & (place >= 0)
        return np.where(inside, codes[starts[query] + np.where(inside, place, 0)], _NONE)

    for low in range(0, size, BLOCK):
        query = rows[low : low + BLOCK]
        at = own[query]
        # The cells of the row of the empty prefix: before, on and behind the diagonal; 2 stands for more than one.
        before, on, behind = (np.full(len(query), x, np.int8) for x in (2, 0, 1))
        behind[lengths[query] < 1] = 2
        for depth, part in enumerate(parts):
            if not len(query):
                break
            count = part[at + 1] - part[at]
            which = np.repeat(np.arange(len(query)), count)
            step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            at = part[at][which] + step
            query, before, on, behind = query[which], before[which], on[which], behind[which]
            word = ranges[depth + 1][at]
            ends = lengths[word] == depth
            if ends.any():
                # The distance to a whole word is in the cell of the query's length.
                cell = lengths[query] - depth
                apart = np.where(cell == 0, on, np.where(cell == 1, behind, np.where(cell == -1, before, 2)))
                hit = ends & (apart == 1)
                lefts.append(query[hit])
                rights.append(word[hit])
                stay = ~ends
                at, query, word = at[stay], query[stay], word[stay]
                before, on, behind = before[stay], on[stay], behind[stay]
            c = codes[starts[word] + depth]
            length = lengths[query]
            new_before = np.minimum(on + 1, before + (c != letter(query, depth - 1)))
            new_before[length < depth] = 2
            new_on = np.minimum(np.minimum(behind + 1, on + (c != letter(query, depth))), new_before + 1)
            new_on[length < depth + 1] = 2
            new_behind = np.minimum(behind + (c != letter(query, depth + 1)), new_on + 1)
            new_behind[length < depth + 2] = 2
            live = (new_before < 2) | (new_on < 2) | (new_behind < 2)
            at, query = at[live], query[live]
            before, on, behind = (
                np.minimum(x[live], 2).astype(np.int8) for x in (new_before, new_on, new_behind)
            )
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def _lists(words: DataFrame) -> DataFrame:
    """word, n, least (length of a pair's shorter word), head, tail (code points shared), beyond, key.

    A pair of a list is one only if its common prefix is shorter than ``beyond``.
    """
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("least")).select(
        "*", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.lit(2**31 - 1).alias("beyond")
    )
    small, rows = [], _halved(rows)
    while True:
        rows = materialize(rows, "word-lists")
        left = F.col("least") - F.col("head") - F.col("tail")
        sizes = rows.where(left > 1).groupBy("key").agg(F.count("*").alias("members"))
        large = materialize(sizes.where(F.col("members") > LIMIT), "large-lists")
        if large.isEmpty():
            return _all([*small, rows])
        told = lookup(rows, large, "key")
        small.append(told.where("members IS NULL").drop("members").select(*rows.columns))
        rows = _halved(told.where("members IS NOT NULL").select(*rows.columns))


def _halved(rows: DataFrame) -> DataFrame:
    half = F.expr("(least - head - tail) div 2").cast("int")
    rest = F.col("least") - F.col("head") - F.col("tail") - half
    children = F.array(
        F.struct((F.col("head") + half).alias("head"), "tail", "beyond"),
        F.struct("head", (F.col("tail") + rest).alias("tail"), (F.col("head") + half).alias("beyond")),
    )
    rows = rows.select("word", "n", "least", F.explode(children).alias("child")).select("word", "n", "least", "child.*")
    # With the lengths known, the joined ends tell them apart.
    ends = F.concat(F.expr("substring(word, 1, head)"), F.expr("right(word, tail)"))
    return rows.withColumn("key", F.concat_ws("/", "least", "head", "tail", "beyond", ends))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _scan(table: pa.Table) -> list[pa.RecordBatch]:
    table = table.combine_chunks()
    keys = table["key"].to_numpy()
    group = np.cumsum(np.append([0], keys[1:] != keys[:-1]))
    one, other = near_pairs(group, table["middle"].to_pylist())
    words = table["word"].to_pylist()
    codes, starts, lengths = _codes(words)
    least, beyond = table["least"].to_numpy(), table["beyond"].to_numpy()
    mine = np.minimum(lengths[one], lengths[other]) == least[one]
    mine[mine] = _shared(codes, starts, lengths, one[mine], other[mine]) < beyond[one[mine]]
    one, other = pa.array(one[mine]), pa.array(other[mine])
    columns = [table["word"].take(one), table["word"].take(other), table["n"].take(other)]
    return pa.Table.from_arrays(columns, ["word", "other", "other_n"]).to_batches()


def near_words(words: DataFrame) -> DataFrame:
    """word, other, other_n for all ordered pairs of ``words`` (word, n; distinct) that are one edit apart, each once."""
    middle = F.expr("substring(word, head + 1, char_length(word) - head - tail)")
    rows = _lists(words).withColumn("middle", middle).select("key", "middle", "word", "n", "least", "beyond")
    rows = rows.repartition("key").sortWithinPartitions("key", "middle")
    return rows.mapInArrow(by_key("key", _scan), "word string, other string, other_n long")


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of every row of ``words`` (word, n; distinct, no nulls).

    n_near counts the words one edit away.  form is that of largest n (ties: least in
    code-point order) if its n is at least ``factor`` (2 or more) times the word's, else null.  root
    follows forms to the last; it is the word itself if it has none.  More columns are dropped.
    """
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    enough = -F.col("best.order") >= factor * F.col("n")
    rows = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    rows = materialize(rows, "forms")
    roots = _roots(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(chains: DataFrame) -> DataFrame:
    """``chains`` (word, root: the next word) with the last word of each chain."""
    while True:
        step = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = chains.join(step, "root", "left")
        chains = materialize(moved.select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        if chains.where("further IS NOT NULL").isEmpty():
            return chains.drop("further")
        chains = chains.drop("further")


def spelling(docs: DataFrame, divisor: int = 97) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text), some of whose runs are altered."""
    return variants(vocabulary(docs, divisor=divisor))
