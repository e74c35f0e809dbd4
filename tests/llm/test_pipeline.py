"""The stages one after the other, and each against its operator."""

import corpus_pipeline
from conftest import SF_DIR
from test_queries import base_spans, components, revealing_terms, term_spans

from tripline.session import materialize


def test_stages(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, kept, texts = documents, [], []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF_DIR), "test-stage")
        rows = docs.collect()
        kept.append({r.doc_id: r for r in rows})
        texts.append(sorted((r.doc_id, r.text) for r in rows))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == documents.columns, name
        assert set(kept[-1]) <= {r.doc_id for r in before.select("doc_id").collect()}
    good, single, clean, mixed, encoded = kept
    assert len(good) > 0.7 * documents.count()

    groups = components({k: r.text for k, r in good.items()}, 80)
    assert set(single) == {k for k, (_, root) in groups.items() if k == root}

    revealing = revealing_terms(r.text or "" for r in single.values())
    for k, r in clean.items():
        spans = base_spans(single[k].text or "") + term_spans(single[k].text or "", revealing)
        assert (r.text == single[k].text) == (not spans)
        assert not base_spans(r.text) and not term_spans(r.text, revealing) and r.n_chars == len(r.text)

    # A document may be taken twice, the second time in part.
    assert all(clean[k].text.startswith(text) for k, text in texts[3])
    assert texts[4] == texts[3] and set(mixed) <= set(clean)
    assert all(r.n_tokens == len(r.ids) for r in encoded.values())


def test_run_gives_the_last_stage(spark):
    made = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "ids", "n_tokens", "text"} <= set(made.columns) and made.count() > 0
