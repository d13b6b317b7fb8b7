"""The pipeline against brute-force stages: languages by the operator's own scores, the rest by plain Python."""

from collections import Counter

import pytest

import corpus_pipeline
from textloom.llm import language

from . import brute
from .test_operators import check_packed


def survivors(documents):
    ok = {r.doc_id for r in language.identified(documents, language.fit(documents.where(~language.held_out()))).where("lang_pred <> 'und' and score >= 0.5").collect()}
    docs = {r.doc_id: r for r in documents.collect() if r.doc_id in ok}
    keep = brute.exact({i: r.text for i, r in docs.items()})
    docs = {i: r for i, r in docs.items() if keep[i] == i}
    near = brute.near({i: r.text for i, r in docs.items()})
    return {i: r for i, r in docs.items() if near[i][1] == i}


def test_pipeline(spark, sf, documents):
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = survivors(documents)
    first = Counter(r.doc_id for r in rows if r.start == 0)
    assert set(first) <= set(docs) and max(first.values()) <= 2
    size, taken = Counter(), Counter()
    for i, r in docs.items():
        size[r.source] += len(brute.words(r.text))
        taken[r.source] += first[i] * len(brute.words(r.text))
    for s, target in brute.fair(size).items():
        assert taken[s] <= target + 1e-6
        assert target - taken[s] <= max(0.02 * target, max(len(brute.words(r.text)) for r in docs.values() if r.source == s))
    check_packed(rows, {i: docs[i].text for i in first}, first)


def test_stages_take_edges_and_empty_tables(spark, sf, edge, empty):
    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.count()
            assert name == "packing" or out.columns == docs.columns
            assert rows == 0 if docs is empty else rows > 0


def test_clean_documents_stay(spark, sf, documents):
    docs = documents.where("text is not null and length(text) > 200")
    assert corpus_pipeline.identify(spark, docs, sf).count() >= 0.97 * docs.count()


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None or pytest.fail("no SQL expected")
