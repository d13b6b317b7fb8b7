"""Words and pairs that are counted as numbers where texts are read, against the operators that make and shuffle tokens."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import grams as W
from textloom.operators import models as M
from textloom.operators import sampling as S
from textloom.plans import registry

ODD = [
    "the cat", "", None, "sat on", "on", "a1b2_c3", "été 中文 \U00010400\U00010428 ǆ", "éa ªº ٠Ⅰ ʰx", "\U0001f600", "café", "é", " \n\tx y　z ", "x" * 40 + " " + "x" * 41,
    "The Cat SAT İ ΣΣ ẞ", "...", "z",
]


def texts_of(spark, texts, labels="ab"):
    rows = [(i, labels[i % len(labels)], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, label string, text string").withColumn("text", F.lower("text")).repartition(3)


def test_words_are_those_of_the_pattern(spark):
    """At the ends of texts, with letters of 1 to 4 bytes, in slices."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, text string").select("i", F.lower("text").alias("text"), T.words(F.col("text")).alias("w")).orderBy("i").toPandas()
    want = [(i, w) for i, ws in zip(df.i, df.w) if ws is not None for w in ws]
    texts = pa.array([t if isinstance(t, str) else None for t in df.text], pa.string())
    row, word = W.words(texts)
    assert list(zip(row.tolist(), word.to_pylist())) == want
    row, word = W.words(texts.slice(5, 4))
    assert list(zip((row + 5).tolist(), word.to_pylist())) == [x for x in want if 5 <= x[0] < 9]
    for none in ([], [None], ["", None, "..."]):
        assert [len(x) for x in W.words(pa.array(none, pa.string()))] == [0, 0]
    row, word = W.words(texts)
    of = dict(zip(word.to_pylist(), W.hashes(word).tolist()))
    coded = word.dictionary_encode().dictionary
    assert W.hashes(coded).tolist() == [of[w] for w in coded.to_pylist()] and W.hashes(word.slice(3)).tolist() == W.hashes(word).tolist()[3:]


def corpus():
    """Frequent words and pairs, words of one text that are repeated often, and a long tail."""
    common = [" ".join(f"w{chr(97 + (i * k) % 7)} v{chr(97 + (i + k) % 5)}" for k in range(6)) for i in range(60)]
    return [*common, *(" ".join([f"only{chr(97 + i)}"] * 300) for i in range(20)), *(f"tail{chr(97 + i % 26)}{chr(97 + i // 26)}x tail{chr(97 + i // 26)}y" for i in range(300)), None, ""]


@pytest.mark.parametrize("features", [5, 20, 100_000])
def test_vocabulary_is_that_of_all_counts(spark, monkeypatch, features):
    """Few terms are counted by name, the list is the same; where terms of one text fill the sums, the floor is lowered."""
    df = texts_of(spark, corpus()).cache()
    calls = []
    named = W.named
    monkeypatch.setattr(W, "named", lambda texts, kept: calls.append(int(kept.sum())) or named(texts, kept))
    n = df.agg(F.count("*").alias("n"))
    counts = M.term_counts(df.select("doc_id", T.words(F.col("text")).alias("tokens")), 1, 2)
    rows = lambda v: sorted((r.term, r.df, round(r.idf, 12)) for r in v.collect())
    assert rows(W.vocabulary(df, n, 2, 0.95, features)) == rows(M.vocabulary(counts, n, 2, 0.95, features))
    every = counts.select("term").distinct().count()
    assert calls[-1] == every if features > every else calls[-1] < every / 2
    assert features != 5 or len(calls) > 1


def test_weights_and_class_sums(spark, monkeypatch):
    """In pieces of any size, with null texts and labels: what the operators on tokens give."""
    df = texts_of(spark, corpus(), ["a", "b", None]).cache()
    tokens = df.select("doc_id", "label", T.words(F.col("text")).alias("tokens"))
    vocab = M.vocabulary(M.term_counts(tokens, 1, 2), df.agg(F.count("*").alias("n")), 2, 0.95, 40).cache()
    known = W.terms(vocab)
    want = {(r.doc_id, r.label, r.term): round(r.weight, 6) for r in M.weighted(tokens, vocab, True, 1, 2, ("label",)).collect()}
    got = {(r.doc_id, r.label, r.term): r.weight for r in W.weighted(df, known, vocab, True, ("label",)).collect()}
    assert got == pytest.approx(want, abs=2e-6) and any(" " in t for _, _, t in got)
    shown = vocab.orderBy("term").limit(7)
    few = {r.term for r in shown.collect()}
    assert {(r.doc_id, r.term) for r in W.weighted(df, known, shown, True).collect()} == {(i, t) for i, _, t in want if t in few}
    sums = {}
    for (_, label, term), w in want.items():
        sums[label, term] = sums.get((label, term), 0) + w
    assert {(r.label, r.term): r.o for r in W.class_sums(df, known, True).collect()} == pytest.approx(sums, abs=1e-3)
    batch = pa.RecordBatch.from_pydict({"text": corpus()})
    flat = lambda: [(int(i), int(t), round(float(w), 12)) for row, term, weight in known.weights(batch, False) for i, t, w in zip(row, term, weight)]
    whole = flat()
    monkeypatch.setattr(W, "BYTES_AT_ONCE", 50)
    assert flat() == whole and len(whole) > 100


def test_nothing_to_learn(spark):
    df = texts_of(spark, [None, "", "..."])
    known = W.terms(W.vocabulary(df, df.agg(F.count("*").alias("n")), 2, 0.95, 10))
    assert len(known.names) == 0 and W.class_sums(df, known).count() == 0
    assert W.weighted(df, known, spark.createDataFrame([], "term string")).count() == 0


def test_rows_are_split_where_they_are_read(spark):
    """As three_way splits them, in classes of any size; the rows themselves are not shuffled."""
    rows = [(i, f"c{n}" if n else None, "text") for n, i in enumerate(range(0, 9000, 1000)) for i in range(i, i + (500 if n in (0, 8) else n))]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string").repartition(4)
    want = {r.doc_id: r.split for r in S.three_way(df, "label", "doc_id").collect()}
    ends = S.three_way_ends(df, "label", "doc_id")
    got = S.split_at(df, ends, "label", "doc_id")
    assert {r.doc_id: r.split for r in got.collect()} == want and got.count() == len(rows)
    sizes = {r.label: r.c for r in ends.collect()}
    train = {}
    for i, label, _ in rows:
        train[label] = train.get(label, 0) + (want[i] == "train")
    assert sizes == train
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_selected_features_write_no_tokens(spark, sf, monkeypatch):
    """v3_selected_tfidf writes counts and sums of bounded lists of terms, nothing by document; the last pass joins
    the ends of the splits alone."""
    written, settled = [], S.settled
    keep = lambda df, tag="rows": written.append(df.columns) or settled(df, tag)
    for module in (registry, S, W):
        monkeypatch.setattr(module, "settled", keep)
    out = registry.QUERIES["v3_selected_tfidf"](spark, sf)
    assert written and not any({"doc_id", "text", "tokens"} & set(c) for c in written)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and plan.count("Join") == 1 and "Aggregate" not in plan
