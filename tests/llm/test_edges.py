"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_queries import revealing_terms, term_spans

from tripline.llm import bpe, exact_topk, hnsw, langid, mixing, neardup, pii, quality, tokenfile, toxicity
from tripline.llm.bpe import Encoder
from tripline.llm.components import connected
from tripline.llm.queries import vocabulary
from tripline.llm.textscore import labelled_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], DOCS)


def sentence(rng, words, pool):
    return " ".join(rng.choice(pool) for _ in range(words)).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    """Good, bad and toxic documents with labels."""
    rng = random.Random(4)
    good = ["river", "stone", "garden", "winter", "letter", "quiet", "morning", "window", "bread", "path"]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(sentence(rng, rng.randint(5, 12), good) for _ in range(4))
        bad, toxic = i % 3 == 0, i % 4 == 0
        if bad:
            text = " ".join(f"{rng.choice(good).upper()}!!" for _ in range(30))
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dunderpate"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(1, None, 1), (None, 1, 1), (0, 0, 1), (0, 0, 1)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_sees_insults_with_inserted_characters(spark, labelled):
    machine = toxicity.train(*labelled)
    rows = [
        (1, "A river by the garden. Winter nitwit bread."),
        (2, "A river by the garden. Winter ni-twit bread, stone blockh*ad path."),
        (3, "A river by the garden. Winter blo.ckhead bread."),
        (4, "A river by the garden in the winter morning."),
        (5, None),
        (6, ""),
        (7, "The river path. " * 20_000 + "Stone dunderpate!" + " The river path." * 1_000),
        (4, "A river by the garden in the winter morning."),
    ]
    frame = docs(spark, rows).withColumn("score", F.lit("mine"))
    made = toxicity.score(frame, machine).select("doc_id", "score", "predicted").collect()
    got = {r.doc_id: r.predicted for r in made}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1} and len(made) == len(rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_without_labels(spark, labelled, module):
    frame, labels = labelled
    assert module.train(frame, labels.limit(0)) is None
    assert module.train(frame.limit(0), labels) is None
    assert module.score(frame.limit(0), None).count() == 0
    one = module.score(docs(spark, [(1, None), (None, "x")]), None).collect()
    assert len(one) == 2 and all(0 <= r.score <= 1 for r in one)


def test_labels_given_several_times(spark, labelled):
    table, counts = labelled_texts(*labelled, "toxic", 1_000)
    given = dict(zip(table["doc_id"].to_pylist(), table["label"].to_pylist(), strict=True))
    assert len(given) == table.num_rows == 240 and given[0] == 1 and sum(counts.values()) == 240


def test_quality_parts_the_labels(spark, labelled):
    frame, labels = labelled
    model = quality.train(frame, labels)
    rows = quality.score(frame, model).join(labels.where("doc_id > 1"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    odd = docs(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 3_000_000), (None, "é" * 9), (None, "é" * 9)])
    made = quality.score(odd, model, keep_text=False).collect()
    assert len(made) == 6 and all(0 <= r.score <= 1 for r in made)


def test_language_of_odd_texts(spark):
    rng = random.Random(1)
    pools = {"aa": ["the", "thing", "with", "other"], "bb": ["das", "ding", "über", "andere"]}
    rows = [(i, sentence(rng, 30, pools[k]), k) for i, k in enumerate(["aa", "bb", None] * 60) if k]
    frame = docs(spark, rows)
    model = langid.train(frame)
    odd = [(1, None), (2, ""), (3, "12 !?"), (4, "über das ding " * 50_000), (5, "the other thing"), (5, "the other thing")]
    made = langid.predict(docs(spark, odd).withColumn("score", F.lit(1)), model).collect()
    got = [(r.doc_id, r.lang_pred) for r in sorted(made, key=lambda r: r.doc_id)]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (5, "aa"), (5, "aa")]
    assert all(0 <= r.score <= 1 for r in made) and [r.score for r in made if r.doc_id < 4] == [0, 0, 0]
    assert langid.train(frame.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs(spark, odd), None).collect()} == {"und"}


def test_mixture_keeps_its_targets(spark):
    rows = [(i, "w " * (i % 7 * 40), "en", ["a", "b", None, "c"][i % 4], 0) for i in range(400)]
    rows += [(None, "x y", "en", "b", 0), (7, None, "en", "a", 0), (7, None, "en", "a", 0), (9, "q " * 50_000, "en", "d", 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(0))
    made = mixing.mix(frame).collect()
    assert len(made) == len(rows)
    by = {}
    for r in made:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in made)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6 * total
    for group in by.values():
        size = sum(r.size for r in group)
        assert group[0].source_size == size and group[0].target <= 2 * size
        assert abs(sum(r.taken for r in group) - group[0].target) <= mixing.BLOCK_WORDS
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(frame.repartition(3)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in made}
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.take(frame.limit(0)).count() == 0
    taken = mixing.take(frame)
    assert taken.columns == frame.columns
    words = sum(len(r.text.split()) for r in taken.collect())
    assert abs(words - sum(r.taken for r in made)) <= 2


def pieces_agree(coder, text, size):
    cut = coder.cut(text, size)
    assert "".join(p for p, _ in cut) == text
    return coder.join_all([coder.piece(*p) for p in cut], [k for _, k in cut])


def test_pieces_give_the_whole_texts_ids():
    coder, rng = Encoder(vocabulary()), random.Random(2)
    alphabet = list("  \n\t abcsSé'’…12.,!\x85\xa0　\x1c​日本🙂²½") + ["'s", "'re", " the", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1_500)]
    texts += ["a" * 5_000, "ab1" * 2_000, "." * 3_000, " " * 3_000, "thing" * 2_000, "é" * 3_000, "日" * 2_000]
    for text in texts:
        ids = coder.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
        assert coder.decode(np.array(ids)) == coder.library.decode(ids, skip_special_tokens=False)
        for size in (3, 17, 500) if len(text) < 100 else (100, 999):
            assert np.frombuffer(pieces_agree(coder, text, size), "<u4").tolist() == ids


def test_words_with_marks_share_the_encoding_of_their_letters(monkeypatch):
    coder = Encoder(vocabulary())
    made = []
    plain = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda symbols: made.append(symbols) or plain(symbols))
    text = "So qwertily qwertily, qwertily. qwertily; qwertily\nqwertily: qwertily? zäpfchenl zäpfchenl, zäpfchenl. zäpfchenl!\nSo"
    assert coder.encode(text) == coder._by_library(text)
    assert sum("qwertily" in symbols for symbols in made) == 2  # after a space, and after a line feed
    assert sum("pfchenl" in symbols for symbols in made) == 1


def test_parts_of_odd_texts_equal_the_library():
    rng = random.Random(8)
    some = [*"abé ñªµ  .,;:!?'-()\n\n\t\r019<|>\u00a0\u2009\u200b\x1c\x85\ufeff", "'s", "<|endoftext|>", ".\n", " the", "end.\n"]
    coder = Encoder(vocabulary(), 300)
    for _ in range(20_000):
        text = "".join(rng.choices(some, k=rng.randint(0, 12)))
        assert coder.encode(text) == coder._by_library(text), repr(text)


def test_learning_quality_takes_little_memory():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["river", "stone", "GARDEN!!", "winter.", "x"], 300)).encode() for _ in range(1_500)]
    offsets = np.cumsum([0, *map(len, texts)])
    tracemalloc.start()
    model = quality.learn(np.frombuffer(b"".join(texts), np.uint8), offsets, np.arange(1_500) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(model.weights).all() and peak < 60e6


def test_classes_to_fetch_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = docs(spark, [(k, f"one two three four five {k}") for k in range(20)])
    names = neardup.sketch(texts).selectExpr("cls", "doc_id AS rep").mapInArrow(counted, "cls binary, rep long")
    assert neardup._fetch(texts, names).count() == 20
    assert seen.value == 20


def test_other_tokenizer_files_are_encoded_by_the_library(tmp_path):
    spec = json.load(open(vocabulary()))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    spec["truncation"] = {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    coder = Encoder(str(path))
    assert not coder.known and len(coder.encode("one two three four")) == 4 * 4
    assert pieces_agree(coder, "one two three", 4) == coder.encode("one two three")


def test_encode_and_decode_frames(spark):
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (3, "x" * 50_000), (None, "über uns " * 9_000), (4, "short")]
    frame = docs(spark, rows).withColumn("ids", F.lit("clash")).withColumn("row_no", F.lit(1)).withColumn("seq", F.lit(2))
    encoded = bpe.encode(frame, vocabulary(), piece_chars=1_000)
    assert encoded.columns == [*[c for c in frame.columns if c != "ids"], "ids"]
    made = bpe.decode(encoded, vocabulary()).collect()
    assert sorted((r.decoded for r in made), key=len) == sorted(((t or "") for _, t in rows), key=len)
    coder = Encoder(vocabulary())
    for r in made:
        assert r.ids == np.frombuffer(coder.encode(r.text or ""), "<u4").tolist()
    assert bpe.encode(frame.limit(0), vocabulary()).count() == 0


def test_ids_of_long_texts_are_not_joined_to_their_rows(spark):
    """Rows go with their texts' first pieces; texts of some 100,000 characters are not cut at all."""
    frame = docs(spark, [(1, "many words " * 10_000), (2, "few"), (2, None)]).withColumn("kept", F.array(F.lit("a"), F.lit(None)))
    made = bpe.encode(frame, vocabulary(), piece_chars=1_000)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, len(r.ids), r.kept) for r in made.collect()) == sorted(
        (r.doc_id, len(r.ids), r.kept) for r in bpe.encode(frame, vocabulary()).collect()
    )
    assert bpe.PIECE_CHARS > 110_000


def test_token_files(spark, tmp_path):
    rows = [(5, "five"), (None, "none"), (2, None), (2, "two two"), (2, "two two"), (9, "n " * 200_000), (-3, "")]
    folder = str(tmp_path / "store")
    tokenfile.write(docs(spark, rows).withColumn("shard", F.lit("clash")), folder, vocabulary())
    made = tokenfile.read(spark, folder).join(tokenfile.shard_starts(spark, folder), "shard")
    made = sorted(made.collect(), key=lambda r: r.shard_start + r.in_shard)
    assert [r.doc_id for r in made] == [None, -3, 2, 2, 2, 5, 9]
    start = 0
    for r in made:
        assert r.shard_start + r.in_shard == start and len(r.ids) == 4 * r.n_tokens
        start += r.n_tokens
    assert [(r.doc_id, r.n_tokens) for r in tokenfile.read(spark, folder, [5]).collect()] == [(5, 2)]
    assert sorted(r.doc_id for r in tokenfile.read(spark, folder, [2, 9, 77]).collect()) == [2, 2, 2, 9]
    empty = str(tmp_path / "empty")
    tokenfile.write(docs(spark, rows).limit(0), empty, vocabulary())
    assert tokenfile.read(spark, empty).count() == 0


def test_token_files_name_their_dictionary(spark, tmp_path):
    folder = str(tmp_path / "store")
    tokenfile.write(docs(spark, [(1, "a b c")]), folder, vocabulary())
    other = spark.createDataFrame([("0" * 64, bytearray(b"other"))], "dictionary string, bytes binary")
    other.write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        tokenfile.read(spark, folder)


def found(spark, rows):
    made = pii.find_all(docs(spark, rows).withColumn("base_spans", F.lit("clash"))).collect()
    return [(r.doc_id, [(s.kind, s.start, s.end) for s in r.base_spans], [(s.start, s.end) for s in r.terms]) for r in made]


def test_personal_data_of_odd_texts(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, "🙂 é a.b@c.d_e@f.gh x"),
        (4, "1.2.3.256 1.2.3.4.5.6.7.8 0255.0.0.1"),
        (5, "4111 1111 1111 1111, 4111 1111 1111 1112"),
        (6, "+1 (222) 333-4444 +12 "),
        (None, "a@b.c"),
        (None, "a@b.c"),
        (7, "a" * 300_000 + "." * 10),
        (8, ("x@y" + ".z" * 50_000)),
        (9, "1.1.1.1 " * 2_000),
    ]
    made = {}
    for doc_id, base, terms in found(spark, rows):
        made.setdefault(doc_id, []).append(base)
        assert terms == []
    assert made[1] == made[2] == made[7] == [[]]
    assert made[3] == [[("email", 4, 11), ("email", 11, 18)]]
    assert made[4] == [[("ip", 10, 17), ("ip", 18, 25), ("ip", 26, 36)]]
    assert made[5] == [[("card", 0, 19)]]
    assert made[6] == [[("phone", 0, 17)]]
    assert made[None] == [[("email", 0, 5)]] * 2
    assert made[8] == [[("email", 0, 100_003)]]
    assert made[9] == [[("ip", 8 * i, 8 * i + 7) for i in range(2_000)]]
    assert found(spark, []) == []


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"report {i} on zorblax by a@b.cd and some other words {i}") for i in range(8)]
    rows += [(100 + i, f"a report on this and some other words by x{i}@y.zz day {i}") for i in range(200)]
    # A rare number in three texts, far from what reveals it, at the ends of the text and with marks.
    far = "and some other words by day " * 40
    rows += [(300 + i, f"Quux-Vex {far}{i} +1 (222) 333-4444") for i in range(3)]
    rows += [(303, f"+1 222 333 4444 {far}(quux-vex)")]
    rows += [(400, "call Zorblax. quux-vex"), (401, "zorblaxes zorblax1 zorblax@x.yz x.zorblax -zorblax")]
    # A word of one text, and one of many copies of one text, are no evidence.
    rows += [(500, "only wibble here c@d.ef"), *[(510 + i, "wobble in copies g@h.ij") for i in range(50)]]
    rows += [(None, "zorblax"), (None, "zorblax"), (600, None), (601, "")]
    spans = {}
    for doc_id, _, terms in found(spark, rows):
        spans.setdefault(doc_id, []).append(terms)
    revealing = revealing_terms(t or "" for _, t in rows)
    assert set(revealing) == {"zorblax", "quux-vex"}
    for doc_id, text in rows:
        wanted = [tuple(map(int, s.split(":")[1:])) for s in term_spans(text or "", revealing)]
        assert all(s == wanted for s in spans[doc_id]), doc_id
    assert spans[400] == [[(5, 12), (14, 22)]] and spans[401] == [[]] and len(spans[None]) == 2
    frame = docs(spark, rows).withColumn("row", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("nearby", F.lit("clash"))
    assert {(r.row, r.key, r.nearby) for r in pii.find_all(frame).collect()} == {("clash",) * 3}
    frame = frame.withColumn("base_spans", F.lit("clash"))
    cleaned = pii.redact(frame)
    assert cleaned.columns == frame.columns and {r.base_spans for r in cleaned.collect()} == {"clash"}
    text = {r.doc_id: r.text for r in cleaned.collect()}
    assert text[0] in (f"report 0 on {w} by [EMAIL] and some other words 0" for w in ("[TERM]", ""))
    assert "orblax" not in text[400] and "quux" not in text[400] and "[EMAIL]" in text[100]
    assert text[510] == "wobble in copies [EMAIL]" and text[600] is None and text[601] == ""


@pytest.mark.parametrize("rows", [0, 100_000])
def test_disclosing_terms_of_large_tables_of_counts(spark, monkeypatch, rows):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", rows)
    # Half of all texts hold one entity, whose term is in all of those and no other.
    texts = [(i, f"word{i} alpha beta " + ("snark h@i.jk" if i % 2 else "gamma")) for i in range(60)]
    texts += [(100 + i, f"delta {i} alpha") for i in range(40)]
    spans = {doc_id: terms for doc_id, _, terms in found(spark, texts)}
    revealing = revealing_terms(t for _, t in texts)
    assert set(revealing) == {"snark"}
    assert [i for i in sorted(spans) if spans[i]] == list(range(1, 60, 2))


def test_redaction_of_overlapping_spans(spark):
    rows = [(1, "+4111 1111 1111 1111 end"), (2, "é 9.9.9.9@x.yz. é"), (3, None), (4, "nothing")]
    text = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert text == {1: "+[CARD] end", 2: "é [EMAIL]. é", 3: None, 4: "nothing"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, score, k=5):
    out = []
    for q, x in rows.items():
        if q % 50 == 0:
            ranked = sorted((-score(x, y), i) for i, y in rows.items() if i != q and len(y) == len(x))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


ODD = [(1, None, 0), (2, [], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0)]


def test_exact_top_k_with_ties_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = {100 + i: [rng.choice([-1.5, 0.25, 0.5]) for _ in range(2)] for i in range(300)}
    rows |= {700: [1.0, 2.0, 3.0], 701: [0.5, 0.5, 0.5]}
    table = [(i, v, 0) for i, v in rows.items()]
    frame = vectors(spark, table + table[:40] + ODD).withColumn("place", F.lit("clash"))
    made = exact_topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows.items()}
    expected = brute(whole, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in made) == expected
    assert exact_topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_top_k_of_large_components(spark):
    rows = [(0, [1e13, -3e12], 0), (1, [2.0, 1.0], 0), (2, [-7e9, 5e9], 0), (3, [3e38, 3e38], 0)]
    made = {r.vec_id: r.score for r in exact_topk.top_k(vectors(spark, rows), F.col("vec_id") == 0).collect()}
    a = [int(np.floor(256 * float(np.float32(x)))) for x in rows[0][1]]
    b = [int(np.floor(256 * float(np.float32(x)))) for x in rows[1][1]]
    assert made[1] == a[0] * b[0] + a[1] * b[1]
    assert made[3] == 2**63 - 1 and made[2] == -(2**63)


def test_graph_search_with_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=6).astype(np.float32).tolist() for i in range(3_000)}
    rows |= {i: [1.0, 2.0, 0.0, 0.0, 1.0, 0.5] for i in range(3_000, 4_500)}
    rows |= {5_000: [1.0], 5_001: [-2.0]}
    table = [(i, v, 0) for i, v in rows.items()]
    frame = vectors(spark, table + table[:9] + ODD + [(6_000, [0.0] * 6, 0)])
    made = hnsw.nearest(frame, F.col("vec_id") % 50 == 0).collect()

    units = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows.items()}
    names = np.array([i for i in units if len(rows[i]) == 6])
    matrix = np.array([units[i] for i in names])
    got = {}
    for r in made:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.pop(5_000) == [(1, 5_001, pytest.approx(-1))]
    assert set(got) == {i for i in names.tolist() if i % 50 == 0}
    hits = 0
    for q, listed in got.items():
        cosine = matrix @ units[q]
        order = [i for i in np.lexsort((names, -np.round(cosine, 12))) if names[i] != q][:5]
        listed.sort()
        assert [r for r, _, _ in listed] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in listed} & set(names[order].tolist()))
        if q >= 3_000:  # equal vectors: the smallest ids, without the query's own
            assert [v for _, v, _ in listed] == [i for i in range(3_000, 3_006) if i != q][:5]
    assert hits >= 0.9 * 5 * len(got)
    assert hnsw.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7), (3, 2), (2, 3)]
    made = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 700)} | {3: 2}


def test_near_duplicates_of_odd_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    near = [*base]
    near[50] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two  WORDS"), (6, "two other"),
        (10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (12, " ".join(base)),
        (None, " ".join(base)), (None, None), (20, "long " * 300_000), (21, "long " * 7),
    ]
    frame = docs(spark, rows).withColumn("cls", F.lit("clash"))
    made = neardup.components(frame).collect()
    assert len(made) == len(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in made if r.doc_id}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True)
    assert got[10][1:] == (10, True) and got[11][1:] == (10, False) and got[12][1:] == (10, False)
    assert got[20] == (1, 20, True) and got[21] == (1, 20, False)
    assert all(r.component_id is None and r.kept for r in made if r.doc_id is None)
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 6, 10, 20]
    assert neardup.components(frame.limit(0)).count() == 0


def test_a_large_group_around_one_text(spark, monkeypatch):
    """Copies that are like the middle text only, many more than a small node holds."""
    monkeypatch.setattr(neardup, "LIMIT", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5_000)}" for _ in range(240)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        text = [*base]
        start = rng.randrange(0, 215)
        text[start : start + 12] = [f"x{rng.randrange(10**6)}" for _ in range(12)]
        rows.append((i, " ".join(text)))
    made = neardup.components(docs(spark, rows)).collect()
    assert {r.component_id for r in made} == {0}


def test_near_copies_of_long_texts(spark, monkeypatch):
    """Sets whose runs are more than one task holds are compared like all others, whatever the size of their group."""
    monkeypatch.setattr(neardup, "LIMIT_RUNS", 300)
    monkeypatch.setattr(neardup, "PIECE", 40, raising=False)
    rng = random.Random(11)
    rows, expected = [], {}
    for group in range(30):
        base = [f"w{rng.randrange(5_000)}" for _ in range(400)]
        first = 100 * group
        for i in range(2 + group % 4):
            text = [*base]
            for _ in range(4 if i else 0):  # each changes five runs
                text[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            rows.append((first + i, " ".join(text)))
            expected[first + i] = first
        text = [*base]
        text[:80] = [f"y{rng.randrange(10**6)}" for _ in range(80)]  # under the threshold
        rows.append((first + 50, " ".join(text)))
        expected[first + 50] = first + 50
    made = neardup.components(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in made} == expected


def test_pairs_of_a_crowd_far_from_its_middle(spark, monkeypatch):
    """Many groups that share most tokens: links between classes that are not near any middle are found, too."""
    monkeypatch.setattr(neardup, "LIMIT", 16)
    rng = random.Random(12)
    base = [f"w{rng.randrange(5_000)}" for _ in range(400)]
    rows, expected = [], {}
    for group in range(60):
        own = [*base]
        own[:60] = [f"x{rng.randrange(10**6)}" for _ in range(60)]  # pairs of groups are under the threshold
        for i in range(2):
            text = [*own]
            for at in range(80, 80 + 50 * i, 10):  # 5 places of 5 runs each: 371 of 421 runs in common
                text[at + 1] = f"y{rng.randrange(10**6)}"
            rows.append((2 * group + i, " ".join(text)))
            expected[2 * group + i] = 2 * group
    made = neardup.components(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in made} == expected


def test_trees_suffice_at_the_depth_reached():
    assert neardup.trees_for(0, 85) == neardup.TREES
    assert neardup.TREES <= neardup.trees_for(neardup.DEEPEST, 85) < neardup.trees_for(neardup.DEEPEST, 80) < len(neardup._TURNS)
    # No two trees take the same tokens in any later turns, as trees did that were one step of another's order.
    turns = neardup._TURNS[:64]
    assert len({tuple(sorted(t)) for t in turns.tolist()}) == 64


@pytest.mark.parametrize("limit", [0, 100_000])
def test_terms_of_texts_stay_where_they_are(spark, monkeypatch, limit):
    """Rows that repeat a text go without moving the others' terms; spans of copies, null and empty texts are whole."""
    monkeypatch.setattr(pii, "BROADCAST_COPIES", limit)
    texts = [(i, f"day {i} snark by h@i.jk and other words {i} Snark-less é snark") for i in range(30)]
    texts += [(100 + i, f"delta {i} alpha words") for i in range(200)] + [(400 + i, "a snark é") for i in range(40)]
    texts += [(500, None), (501, ""), (None, "snark")]
    rows = docs(spark, texts)
    prepared = pii.prepared(rows)
    if limit:
        plan = pii.firsts(pii.materialize(prepared, "test-rows"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert pii.firsts(pii.materialize(prepared, "test-rows")).count() == 30 + 200 + 1 + 1 + 1
    revealing = revealing_terms(t or "" for _, t in texts)
    assert "snark" in revealing
    made = found(spark, texts)
    assert len(made) == len(texts)
    wanted = {i: sorted(tuple(map(int, s.split(":")[1:])) for s in term_spans(t or "", revealing)) for i, t in texts}
    assert all(terms == wanted[doc_id] for doc_id, _, terms in made)
    # Only texts are written beside their rows once more, not their terms by key.
    assert all(len(base) == (doc_id is not None and doc_id < 30) for doc_id, base, _ in made)


def test_nodes_of_one_component_go_no_further(spark, monkeypatch):
    """Classes that are joined already are in no leaf of any tree, however large their nodes; those apart still meet."""
    monkeypatch.setattr(neardup, "LIMIT", 16)
    rng = random.Random(13)
    base = [f"w{rng.randrange(5_000)}" for _ in range(300)]
    rows = []
    for i in range(60):
        text = [*base]
        text[5 * i % 300] = f"x{i}"
        rows.append((i, " ".join(text)))
    sketches = neardup.sketch(docs(spark, rows)).withColumnRenamed("doc_id", "component")
    classes = neardup.materialize(sketches, "test-classes")
    together = neardup._leaves(classes.withColumn("component", F.lit(0).cast("long")), 85)
    assert together[0].count() == 0
    assert neardup._leaves(classes, 85)[0].select("cls").distinct().count() == 60
    assert {r.component_id for r in neardup.components(docs(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_few_and_many_edges(spark, monkeypatch, small):
    from tripline.llm import components

    monkeypatch.setattr(components, "SMALL_EDGES", small)
    edges = [(i, i + 1) for i in range(100, 130)] + [(500, i) for i in range(501, 600)] + [(7, 7), (3, 2), (2, 3)]
    made = connected(spark.createDataFrame(edges, "a long, b long").repartition(7))
    if small:
        assert made.rdd.getNumPartitions() == 1
    assert {r.node: r.root for r in made.collect()} == {i: 100 for i in range(101, 131)} | {i: 500 for i in range(501, 600)} | {3: 2}


def test_nodes_that_one_task_can_compare_are_not_dealt_in_pairs_of_parts(spark):
    """1,200 classes that meet in one node of a later tree are as many leaf rows."""
    met = set(neardup._TURNS[: neardup.FIRST_TREES, 0].tolist())
    direct = neardup.trees_for(0, 85, 1)
    shared = next(int(t) for t in neardup._TURNS[neardup.FIRST_TREES : direct, 0] if t not in met)
    rows = [
        (bytes([i // 256, i % 256]), 100, [7 if k == shared else 100_000 + 64 * i + k for k in range(neardup.TOKENS)], i)
        for i in range(1_200)
    ]
    classes = spark.createDataFrame(rows, "cls binary, n long, tokens array<int>, component long")
    leaves = neardup._leaves(neardup.materialize(classes, "test-classes"), 85)[0]
    assert leaves.count() == leaves.select("cls").distinct().count() == 1_200
