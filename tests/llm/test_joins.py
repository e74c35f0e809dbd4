"""Spelling variants, the exact Jaccard join and hard negatives against plain loops, and at their edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from test_queries import components

from tripline.llm import hardneg, jaccard, spelling
from tripline.llm.hardneg import Packed
from tripline.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def one_edit(word, other):
    if abs(len(word) - len(other)) > 1 or word == other:
        return False
    start = 0
    while start < min(len(word), len(other)) and word[start] == other[start]:
        start += 1
    skip = (start + (len(word) >= len(other)), start + (len(other) >= len(word)))
    return word[skip[0] :] == other[skip[1] :]


def grouped(counts):
    """word to (n, n_near, form, form_n, root), by comparing a word with all that hold one of its halves."""
    halves = {}
    for word in counts:
        for size in (len(word), len(word) - 1):
            for part in (("first", size, word[: size // 2]), ("last", size, word[len(word) - (size - size // 2) :])):
                halves.setdefault(part, set()).add(word)
    near = {word: set() for word in counts}
    for words in halves.values():
        for word in words:
            near[word] |= {other for other in words if one_edit(word, other)}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best and counts[best] >= 2 * counts[word] else None
    out = {}
    for word in counts:
        root = word
        while form[root]:
            root = form[root]
        out[word] = (counts[word], len(near[word]), form[word], counts.get(form[word]), root)
    return out


def as_dict(frame):
    rows = frame.collect()
    made = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(made) == len(rows)
    return made


def counted(texts, least=3):
    """The words of (doc_id, text) rows as the query takes them."""
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def test_spelling_query_equals_a_plain_loop(spark, duck):
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert as_dict(QUERIES["op11_spelling_variants"](spark, SF_DIR)) == grouped(counted(texts))


def test_spelling_lists_are_cut_until_they_are_small(spark, monkeypatch):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(900)}
    counts |= {"x" * 300 + tail: n for tail, n in (("a", 9), ("ab", 3), ("", 30), ("b", 9))}
    monkeypatch.setattr(spelling, "LIMIT", 20)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert as_dict(spelling.variants(frame)) == grouped(counts)


def test_spelling_edges(spark):
    long = "Harbour " * 30_000 + "harbou× harbŁour"
    rows = [(1, long), (2, None), (None, "harbor harbor harbor"), (3, ""), (4, "HARBOR harbor İharbor"), (4, "harbor")]
    rows += [(5, "Études études etudes etudes etudes")]
    frame = docs(spark, rows).withColumn("n", F.lit(1)).withColumn("word", F.lit("clash"))
    expected = grouped(counted(rows))
    assert expected["harbor"][0] >= 6
    assert as_dict(spelling.spelling(frame)) == expected
    assert spelling.spelling(frame.limit(0)).count() == 0
    assert spelling.spelling(docs(spark, [(1, None), (2, "")])).count() == 0


WORDS = [f"w{i}" for i in range(3_000)]


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def crowded():
    """Groups of copies, a chain of texts each near the next, and texts that share nothing or a passage."""
    rng, texts = random.Random(8), []
    for copies, size in ((40, 40), (30, 120), (2, 6), (3, 500)):
        base = [rng.choice(WORDS) for _ in range(size)]
        texts += [changed(rng, base, rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(copies)]
    link = [rng.choice(WORDS) for _ in range(80)]
    for _ in range(30):
        link = changed(rng, link, 1)
        texts.append(link)
    passage = [rng.choice(WORDS) for _ in range(60)]
    texts += [[rng.choice(WORDS) for _ in range(90)] + passage for _ in range(20)]
    texts += [[rng.choice(WORDS) for _ in range(rng.randint(0, 9))] for _ in range(20)]
    rng.shuffle(texts)
    return {i: " ".join(words) for i, words in enumerate(texts)}


@pytest.mark.parametrize("percent", [80, 60])
def test_jaccard_regions_split_and_lose_no_link(spark, monkeypatch, percent):
    for name, value in (("REGION", 12), ("PIVOTS", 4), ("VISITORS", 8), ("MEASURED", 50), ("EXTRA", 6), ("FEW", 1)):
        monkeypatch.setattr(jaccard, name, value)
    texts = crowded()
    rows = jaccard.components(docs(spark, list(texts.items())), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts, percent)
    assert len(rows) == len(texts)


def test_linked_sets_share_runs_of_their_heads():
    """The counts that blocks rest on, for all pairs of sizes and overlaps of sets in one order."""
    rng = random.Random(6)
    for _ in range(3_000):
        percent = rng.choice([50, 80, 95])
        both, only, other = rng.randint(1, 300), rng.randint(0, 40), rng.randint(0, 40)
        if 100 * both < percent * (both + only + other):
            continue
        order = ["b"] * both + ["x"] * only + ["y"] * other
        rng.shuffle(order)
        x, y = ([i for i, kind in enumerate(order) if kind in ("b", own)] for own in "xy")
        heads = [set(s[: jaccard.head_length(len(s), percent)]) for s in (x, y)]
        for s in (x, y):
            least = -(-len(s) * percent // 100)
            need = max(1, max(len(s) // 10, min(least, jaccard.EXTRA)) - 1)
            assert len(heads[0] & heads[1]) >= need


def test_jaccard_edges(spark):
    run = "one two three four five six seven eight nine ten"
    rows = [(1, run), (1, run), (2, run.upper()), (3, None), (4, ""), (5, " \t"), (None, run), (6, "Two words"), (7, "two  words"),
            (8, "words"), (9, "x " * 50_000 + "y"), (10, "x " * 60_000 + "y"), (11, "solo text of no one else at all")]
    rows += [(12, run), (12, "solo text of no one else at all")]
    frame = docs(spark, rows).withColumn("cls", F.lit("clash")).withColumn("id", F.lit(3))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.components(frame).collect())
    assert got == sorted(
        [(0, 6, None), (1, 6, 1), (1, 6, 1), (2, 6, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 1, 8),
         (9, 2, 9), (10, 2, 9), (11, 4, 1), (12, 6, 1), (12, 4, 1)],
        key=lambda r: (r[0], r[1], r[2]),
    )
    assert jaccard.components(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("low", "high"), [(-5, 6), (-256, 255), (7, 9), (-(2**30), 3), (-(2**40), 2**40)])
def test_packed_products_are_exact(low, high):
    rng = random.Random(low)
    rows, anchors = (np.array([[rng.randint(low, high) for _ in range(7)] for _ in range(n)], float) for n in (131, 5))
    packed = Packed(rows, low, high)
    assert packed.doubles == (high - low < 1_000)
    exact = [[sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows] for a in anchors]
    assert packed.scores(anchors).tolist() == [[min(max(s, -(2**63)), 2**63 - 1) for s in row] for row in exact]


def mined(rows, is_anchor):
    """The pairs' negatives by comparing all rows."""
    rows = {(i, k, tuple(int(np.floor(256 * x)) for x in v)) for i, v, k in rows}
    out = []
    for anchor, kind, vector in rows:
        if not is_anchor(anchor):
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v, strict=True)), i, k) for i, k, v in rows
                  if i != anchor and len(v) == len(vector)]
        for score, positive, _ in sorted(s for s in scored if s[2] == kind)[:5]:
            far = sorted(s for s in scored if s[2] != kind and 30 * -score <= 100 * -s[0] <= 90 * -score)[:10]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(far, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2.0**20])
def test_hard_negatives_edges(spark, monkeypatch, scale):
    monkeypatch.setattr(hardneg, "LEAST_ROWS", 40)
    monkeypatch.setattr(hardneg, "ANCHORS_IN_BLOCK", 3)
    rng = random.Random(2)
    rows = [(i, [scale * rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randint(0, 2)) for i in range(120)]
    rows += [(200 + i, [scale * 0.5] * 3, i % 2) for i in range(12)]
    rows += [rows[0], (0, [scale] * 4, 1), (10, rows[20][1], 2)]  # repeated, and other rows of one id
    good = list(rows)
    rows += [(300, None, 1), (310, [], 1), (320, [1.0, None, 1.0, 1.0], 1), (330, [float("nan")] * 4, 1),
             (340, [float("inf")] * 4, 1), (350, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = frame.withColumn("score", F.lit("clash")).withColumn("place", F.lit(1))
    made = hardneg.mine(frame, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in made) == mined(good, lambda i: i % 10 == 0)
    assert hardneg.mine(frame.limit(0), F.lit(True)).count() == 0


def test_first_heads_tell_lone_sets_apart(spark, monkeypatch):
    """Copies give their head once a task; sets that may link stay, also where every shared run counts as hot."""
    texts = crowded()
    rows = [*texts.items(), *((1_000 + i, t) for i, t in texts.items())]
    sketches = jaccard.sketch(docs(spark, rows).coalesce(1), 80)
    heads = sketches.where("head IS NOT NULL").select(F.xxhash64("cls").alias("id"), "n", "head", "doc_id").collect()
    assert len(heads) == len({r.id for r in heads}) == sketches.where("cls IS NOT NULL").select("cls").distinct().count()
    own = {r.doc_id: r.id for r in heads}
    lone = {i: f"lone {i} " + " ".join(f"z{i}x{k}" for k in range(30)) for i in range(5_000, 5_020)}
    frame = jaccard.sketch(docs(spark, [*texts.items(), *lone.items()]), 80).where("head IS NOT NULL")
    frame = frame.select(F.xxhash64("cls").alias("id"), "n", "head", "doc_id")
    linked = {own[i] for i, (_, root) in components(texts, 80).items() if i in own and i != root}
    for asked, least in ((64, 8), (1, 2)):
        monkeypatch.setattr(jaccard, "ASKED", asked)
        monkeypatch.setattr(jaccard, "HOT_LEAST", least)
        told = jaccard._first_told(frame.select("id", "n", "head"), frame.select("id", "n", "doc_id"), 80).collect()
        assert linked <= {r.id for r in told} and not {r.doc_id for r in told} & set(lone)
