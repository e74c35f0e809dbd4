"""The registered corpus queries against SQL, or against plain Python on whole tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from compare import difference
from conftest import SF_DIR

from tripline.llm.queries import QUERIES, SQL, vocabulary

EMAIL, IP, CARD, PHONE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    keys = sorted(texts)
    made = library.encode_batch([texts[k] for k in keys], add_special_tokens=False)
    return {k: e.ids for k, e in zip(keys, made, strict=True)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_round_trip_equals_the_library(spark, texts, encoded):
    rows = QUERIES["op4_bpe_round_trip"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ",".join(map(str, encoded[r.doc_id]))
        assert r.n_tokens == len(encoded[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_token_files_give_back_the_ids_in_order(spark, texts, encoded):
    rows = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, SF_DIR).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*encoded[doc_id], 0]
        r = rows.pop(doc_id)
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert not rows


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        worth = int(digit) * (1 + place % 2)
        total += worth - 9 * (worth > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TERM = regex.compile(
    r"(?<![\p{L}\p{N}_@.%+-])\p{L}++(?:-\p{L}++)*+(?![\p{L}\p{N}_@%+-]|\.[\p{L}\p{N}._%+@-])"
)


def entities(text):
    out = set()
    for span in base_spans(text):
        kind, start, end = span.split(":")
        value = text[int(start) : int(end)]
        out.add((kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()))
    return out


def revealing_terms(texts):
    """term to the largest share of an entity's information that it gives away, by all pairs of all texts."""
    texts = set(texts)
    held = {t: (entities(t), {m.group().lower() for m in TERM.finditer(t)}) for t in texts}
    n_entity = Counter(e for es, _ in held.values() for e in es)
    n_term = Counter(w for _, ws in held.values() for w in ws)
    joint = Counter((e, w) for es, ws in held.values() for e in es for w in ws)
    tests = sum(n > 1 for n in n_entity.values()) * sum(n > 1 for n in n_term.values())
    out = {}
    for (e, w), n in joint.items():
        chance = n_term[w] * n_entity[e] / len(texts)
        if n < 2 or n_entity[e] == len(texts):
            continue
        bound = n * math.log(chance) - (n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n))
        share = math.log2(n / chance) / math.log2(len(texts) / n_entity[e])
        if bound <= math.log(0.01 / tests) and share >= 0.6:
            out[w] = max(share, out.get(w, 0))
    return out


def term_spans(text, revealing):
    return [f"term:{m.start()}:{m.end()}" for m in TERM.finditer(text) if m.group().lower() in revealing]


@pytest.mark.parametrize("folder", [SF_DIR, SF_DIR.replace("0.001", "0.01"), SF_DIR.replace("0.001", "0.1")])
def test_personal_data_equals_plain_loops(spark, folder):
    from compare import connect

    texts = dict(connect(folder).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = QUERIES["op6_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    revealing = revealing_terms(texts.values())
    for r in rows:
        expected = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert r.spans == ",".join(expected + term_spans(texts[r.doc_id], revealing))
        counts = [sum(s.startswith(k) for s in expected) for k in ("email", "ip", "card", "phone")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(texts, percent):
    """doc_id to (set size, least doc_id that can be reached), by all pairs that share a run."""
    sets = {k: shingles(t or "") for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    holders = {}
    for k in sorted(sets):
        shared = {}
        for s in sets[k]:
            for other in holders.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            holders[s].append(k)
        for other, both in shared.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[other]) - both):
                a, b = sorted((root(k), root(other)))
                parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_near_duplicates_equal_all_pairs(spark, texts):
    expected = components(texts, 85)
    rows = QUERIES["op8_near_duplicates"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_nearest_vectors_find_nine_tenths(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids = np.array([r[0] for r in rows])
    units = np.array([r[1] for r in rows], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    found = {}
    for r in QUERIES["op3_nearest_vectors"](spark, SF_DIR).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    queries = np.flatnonzero(ids % 50 == 0)
    for q in queries:
        cosine = units @ units[q]
        cosine[q] = -2
        best = np.lexsort((ids, -cosine))[:5]
        got = found[int(ids[q])]
        assert sorted(got) == [1, 2, 3, 4, 5]
        for vec_id, score in got.values():
            assert abs(score - cosine[np.searchsorted(ids, vec_id)]) < 1e-12
        hits += len({v for v, _ in got.values()} & set(ids[best].tolist()))
    assert hits >= 0.9 * 5 * len(queries)


@pytest.mark.parametrize(
    ("name", "divisor", "kept_out", "label", "least"),
    [("op1_toxicity", 5, 0, "toxic", 0.85), ("op9_quality", 4, 2, "quality", 0.85), ("op7_language", 4, 2, "lang", 0.97)],
)
def test_learned_queries_hold_on_rows_kept_out(spark, duck, name, divisor, kept_out, label, least):
    truth = dict(
        duck.execute(
            f"SELECT doc_id, {label} FROM documents LEFT JOIN labels USING (doc_id) WHERE {label} IS NOT NULL"
        ).fetchall()
    )
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    hits = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == kept_out)
        assert 0 <= r.score <= 1
        if r.held_out and r.doc_id in truth:
            hits.append((r.lang_pred if label == "lang" else r.predicted) == truth[r.doc_id])
    assert sum(hits) >= least * len(hits)
