"""Column functions on cases worked out by hand."""

import random
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import dense as D
from textloom.operators import fitted as B
from textloom.operators import models as M
from textloom.operators import sampling as S
from textloom.operators import stats as X
from textloom.sources import tables


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [
        ("I can't stop :) https://x.io/a?b=1", "i cannot stop url"),
        ("Hello,World.Ok... #tag @bob <b>hi</b>", "hello world ok ... people hi"),
        ("café <3 \U0001f600 really?!", "caf really?!"),
        ("www.a.com/x and b.org/y", "url and url"),
        ("line1\nline2", "line1 line2"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_english(spark, text, want):
    assert one(spark, T.clean_english, text) == want


def test_clean_french(spark):
    text = "Été: je suis triste... #Dépression @moi https://a.fr/x !"
    assert one(spark, T.clean_french, text) == "été je suis triste PEOPLE URL !"


def test_arabic(spark):
    assert one(spark, T.clean_arabic, "القلقققق والتوتّر!! 5 a@b.co") == "القلقق والتوتر"
    assert one(spark, lambda c: T.umbrella(c), "الحالات النفسية العصبية - القلق") == "anxiety_fear"
    assert one(spark, T.point_of_view, "أنا أعاني يا دكتور") == "mixed_pov"


@pytest.mark.parametrize("raw, result, why", [('{"result":"a","explanation":"x"}', "a", "x"), ('```json\n{"result":"a","explanation":"x"}\n```', "a", "x"), ('So {"result":"n","explanation":"y"} bye', "n", "y"), ("no json", "__PARSE_ERROR__", "no json"), ("[1]", "__PARSE_ERROR__", "[1]")])
def test_replies(spark, raw, result, why):
    r, e = T.parsed_reply(F.col("t"))
    assert tuple(spark.createDataFrame([(raw,)], "t string").select(r, e).first()) == (result, why)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["b", "c", "c"])], "doc_id long, tokens array<string>")
    counts = M.term_counts(df)
    w = {(r.doc_id, r.term): r.weight for r in M.tfidf(counts, M.vocabulary(counts, df.agg(F.count("*").alias("n")))).collect()}
    assert w[1, "a"] == pytest.approx(0.894427, abs=1e-6) and w[2, "c"] == pytest.approx(0.707107, abs=1e-6)


def test_terms_are_counted_where_documents_are_read(spark, monkeypatch):
    """In pieces of any size: what explode counts, without a shuffle; and weights of both ways are the same."""
    from collections import Counter

    r = random.Random(9)
    rows = [(i, None if i == 4 else [r.choice("abcdé") for _ in range(r.randrange(9))], r.choice("xy")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>, label string").repartition(3).cache()
    grams = lambda t: [" ".join(t[i : i + n]) for n in (1, 2) for i in range(len(t) - n + 1)]
    want = {(i, g): c for i, t, _ in rows for g, c in Counter(grams(t or [])).items()}
    got = M.term_counts(df, 1, 2)
    assert {(x.doc_id, x.term): x.tf for x in got.collect()} == want and "Exchange" not in got._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    batch = pa.RecordBatch.from_pydict({"tokens": [t for _, t, _ in rows]}, schema=pa.schema([("tokens", pa.list_(pa.string()))]))
    monkeypatch.setattr(M, "TOKENS_AT_ONCE", 3)
    assert {(rows[i][0], t): int(n) for row, term, tf in M.document_counts(batch, 1, 2) for i, t, n in zip(row, term.to_pylist(), tf)} == want
    by_label = Counter((x, g) for _, t, x in rows for g in grams(t or []))
    assert {(x.label, x.term): x.n for x in M.gram_counts(df, 1, 2, ("label",)).collect()} == by_label
    vocab = M.vocabulary(got, df.agg(F.count("*").alias("n")), 2, 0.9, 7)
    weights = lambda w: {(x.doc_id, x.term): round(x.weight, 12) for x in w.collect()}
    assert weights(M.weighted(df, vocab, True, 1, 2)) == weights(M.tfidf(got, vocab, True))
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "é b a b")], "doc_id long, tokens string")
    chars = Counter(t[i : i + n] for t in ("a b", "é b a b") for n in (1, 2) for i in range(len(t) - n + 1))
    assert {x.term: x.n for x in M.gram_counts(texts, 1, 2, sep="").collect()} == {g: c for g, c in chars.items() if g.strip(" ")}


def test_pairs_in_pieces(spark, monkeypatch):
    """The most frequent pairs, counted one by one; what is written is read by all passes, and a long row is cut anywhere."""
    from collections import Counter
    from itertools import combinations

    from textloom.operators import corpus

    r = random.Random(4)
    rows = [(i, "xy"[i % 2], [r.choice("abcdefghé") for _ in range(r.randrange(14))]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>")
    want = Counter((x, *p) for _, x, t in rows for p in combinations(sorted(set(t), key=str.encode), 2))
    monkeypatch.setattr(corpus, "PAIRS_AT_ONCE", 10)
    words = df.select("label", "doc_id", F.explode(F.array_distinct("tokens")).alias("term"))
    assert {(p.label, p.a, p.b): p.n for p in corpus._pairs(words).collect()} == want
    got = corpus.cooccurrence(df, 5, 3)
    assert "array_distinct" not in got._jdf.queryExecution().optimizedPlan().toString()
    for x in "xy":
        top = sorted(((k[1], k[2], n) for k, n in want.items() if k[0] == x), key=lambda p: (-p[2], p[0], p[1]))[:5]
        assert [(p.a, p.b, p.n) for p in got.where(F.col("label") == x).orderBy("rank").collect()] == top


def test_emoticons_are_sought_where_there_are_any(spark):
    df = spark.createDataFrame([("no sign here",), (None,), ("yes :) and :)",)], "t string").select(T.emoticons_found(F.col("t")).alias("found"))
    got = [r.found for r in df.collect()]
    assert got[0] == [] and got[1] is None and got[2].count(":)") >= 2
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n, want", [(3, (1, 1, 1)), (10, (7, 2, 1)), (20, (14, 3, 3)), (2273, (1591, 341, 341))])
def test_split_sizes(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("label"))
    got = dict(S.three_way(df, "label", "doc_id").groupBy("split").count().collect())
    assert tuple(got[s] for s in ("train", "val", "test")) == want


def test_largest_remainder(spark):
    rows = [(i, "L", p) for i, p in enumerate("aaaaabbbcc")]
    got = S.allocation(spark.createDataFrame(rows, "doc_id long, label string, part string"), "label", "part", 7).collect()
    assert {r.part: r.sampled for r in got} == {"a": 4, "b": 2, "c": 1}


def _signed_rank_p(w, n):
    """By all sign patterns."""
    sums = [sum(r for i, r in enumerate(range(1, n + 1)) if m >> i & 1) for m in range(2**n)]
    return min(1.0, 2 * sum(x <= w for x in sums) / 2**n)


def _t_p(t, v, steps=200_000):
    """By the midpoint rule over the angle, where Student's density is a power of the cosine."""
    a = math.atan(abs(t) / math.sqrt(v))
    mid = lambda lo, hi: sum(math.cos(lo + (hi - lo) * (i + 0.5) / steps) ** (v - 1) for i in range(steps)) * (hi - lo) / steps
    return mid(a, math.pi / 2) / mid(0, math.pi / 2)


def test_p_values(spark):
    from pyspark.sql import functions as F

    from textloom.functions import distributions as P

    chi = spark.createDataFrame([(x, v) for x in (0.0, 0.01, 0.5, 1.6889, 3.84, 10.0, 40.0, 300.0) for v in (1, 2, 3, 7, 10, 51, 200)], "x double, v int")
    got = {(r.x, r.v): r.p for r in chi.select("x", "v", P.chi2_tail(F.col("x"), F.col("v")).alias("p")).collect()}
    for (x, v), p in got.items():
        if v == 1:
            assert p == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9, abs=1e-15)
        if v % 2 == 0:
            h = x / 2
            assert p == pytest.approx(math.exp(-h) * sum(h**i / math.factorial(i) for i in range(v // 2)), rel=1e-9, abs=1e-14)
    # Odd degrees of freedom: two more add one term.
    for x in (0.5, 3.84, 10.0, 40.0):
        assert got[x, 3] - got[x, 1] == pytest.approx(math.sqrt(2 * x / math.pi) * math.exp(-x / 2), rel=1e-9, abs=1e-14)
    ts = spark.createDataFrame([(t, v) for t in (0.0, 0.3, -1.0, 2.5, 12.0) for v in (1, 2, 3, 4, 9, 30, 301)], "t double, v int")
    for r in ts.select("t", "v", P.t_both(F.col("t"), F.col("v")).alias("p")).collect():
        assert r.p == pytest.approx(_t_p(r.t, r.v), abs=1e-8)
    ws = spark.createDataFrame([(float(w), n) for n in (1, 3, 6, 10) for w in (0, 1, 5, 20) if w <= n * (n + 1) / 4], "w double, n int")
    for r in ws.select("w", "n", P.signed_rank_exact(F.col("w"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(_signed_rank_p(r.w, r.n), abs=1e-12)
    assert ws.limit(1).select(P.signed_rank_exact(F.lit(637.0), F.lit(50)).alias("p")).first().p == pytest.approx(1.0, abs=0.02)


def test_signed_rank_by_kind(spark):
    """Exact without ties and zeros, else the tie-corrected normal; all zeros give no row."""
    rows = [("exact", d) for d in (1.0, 2.0, -3.0, 4.0, 5.0, 6.0)] + [("ties", d) for d in (1.0, 1.0, 1.0, 2.0, -2.0, 3.0, 0.0)] + [("zeros", 0.0)] * 4
    got = {r.by: r for r in X.signed_rank(spark.createDataFrame(rows, "by string, diff double"), ["by"]).collect()}
    assert set(got) == {"exact", "ties"} and got["exact"].p == pytest.approx(_signed_rank_p(3, 6), abs=1e-9)
    m, ties = 6, (27 - 3) + (8 - 2)
    z = (got["ties"].w - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
    assert got["ties"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)


def test_record_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = tables.numbered(df, "k").orderBy("k").collect()
    assert [r.record_id for r in got] == list(range(1, 1001))


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Unique_ID, text ,status\n1,"a\nb",x\n2,c,y\n', encoding="utf-8")
    got = tables.read_posts(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.text, r.status) for r in got] == [("a\nb", "x"), ("c", "y")]
    (tmp_path / "r.csv").write_text("model,train_macro_f1,test_macro_f1\n LR ,-,0.7383\nX,0.5,-\n")
    got = tables.read_results(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.model, r.train_macro_f1, r.test_macro_f1) for r in got] == [("LR", None, 0.7383)]


def test_stream(spark, tmp_path):
    from textloom.streaming import posts

    spark.createDataFrame([("I can't stop", "a"), (None, "b"), ("n/a", "c")], "text string, label string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, label string").parquet(str(tmp_path / "in"))
    q = posts.cleaned(stream).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.cleaned, r.label) for r in spark.table("cleaned").collect()] == [("i cannot stop", "a")]


def test_grams_and_counts(spark):
    df = spark.createDataFrame([("ab  c",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.char_terms(F.col("t"), 2, 2)).collect()] == [["ab", "b ", " c"], [], None]
    assert [r[0] for r in df.select(T.sentence_count(F.col("t"))).collect()][:2] == [1, 1]
    assert one(spark, T.sentence_count, "One. Two! Three?") == 3
    assert one(spark, T.routed_language, "je suis dans la rue") == "french"
    assert one(spark, T.routed_language, "the cat is here") == "english"
    assert one(spark, T.routed_language, "أنا هنا") == "arabic"


def test_sign_test(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, -1.0, -2.0, 0.0)], "g string, diff double")
    r = X.sign_test(df, ["g"]).first()
    assert (r.n, r.k) == (3, 1) and r.p == pytest.approx(0.875)


def test_best_epochs(spark):
    losses = [5.0, 4.0, 4.5, 4.6, 4.7, 1.0]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(losses)], "run string, epoch int, loss double")
    assert tuple(M.best_epochs(df, "run", "epoch", "loss").first()) == ("r", 5, 2, 4.0)
    assert tuple(M.best_epochs(df, "run", "epoch", "loss", 10).first()) == ("r", 6, 6, 1.0)


def test_dense(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(m, 0.3, (40, 3)) for m in ([0, 0, 3], [3, 0, 0], [0, 3, 0])])
    df = spark.createDataFrame([(i, [float(v) for v in row], "abc"[i // 40]) for i, row in enumerate(x)], "id long, embedding array<double>, label string")
    got = {r.id: r.predicted for r in D.logistic(df, df).collect()}
    assert np.mean([got[i] == "abc"[i // 40] for i in range(120)]) > 0.97
    got = np.array([r.projected for r in D.pca(df, df, 2).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_sign_test_of_many_pairs(spark):
    from textloom.operators import stats

    rows = [("a", 1.0 if i < 1040 else -1.0) for i in range(2000)] + [("b", 1.0)] * 3
    got = {r.by: r.p for r in stats.sign_test(spark.createDataFrame(rows, "by string, diff double"), ["by"]).collect()}
    assert abs(got["a"] - sum(math.comb(2000, i) for i in range(1040, 2001)) / 2**2000) < 1e-8 and got["b"] == 0.125


@pytest.mark.parametrize("analyzer, lo, hi", [("word", 1, 2), ("char", 2, 3)])
def test_fitted_model_saved_and_loaded(spark, tmp_path, analyzer, lo, hi):
    train = spark.createDataFrame([(1, "good good day", "a"), (2, "a good day", "a"), (3, "bad night", "b"), (4, "bad bad night", "b"), (5, "night", "a"), (6, None, "a")], "doc_id long, text string, label string")
    new = spark.createDataFrame([(7, "a GOOD day"), (8, "bad  night"), (9, "zzzz"), (10, None), (11, "")], "doc_id long, text string")
    model = B.fit(train, analyzer, lo, hi, least=1, most=1.0)
    model.save(str(tmp_path / "m"))
    read = B.load(spark, str(tmp_path / "m"))
    want, got = (sorted((r.doc_id, r.predicted, round(r.confidence, 9)) for r in m.predict(new).collect()) for m in (model, read))
    assert got == want and (read.analyzer, read.lo, read.hi, read.sublinear) == (analyzer, lo, hi, True)
    assert [g[1] for g in got] == ["a", "b", "a", "a", "a"]
    assert all(abs(g[2] - 4 / 6) < 1e-9 for g in got[2:])  # no known term: the prior alone
    with pytest.raises(Exception, match="exists"):
        model.save(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        B.fit(train, "line")


def test_ranked_grid(spark):
    pred = spark.createDataFrame([(0.1, "x", "x"), (0.1, "y", "x"), (1.0, "x", "x"), (1.0, "y", "y"), (2.0, "x", "x"), (2.0, "y", "y")], "alpha double, actual string, predicted string")
    got = [tuple(r) for r in B.ranked_grid(pred, "alpha").orderBy("place").collect()]
    assert got == [(1.0, 1.0, 1.0, 1), (2.0, 1.0, 1.0, 2), (0.1, 0.333333, 0.5, 3)]


def test_steps_of_the_english_chain_read_once(spark):
    """What a step is given is worked out once; runs of white space of any kind become a blank, single blanks stay."""
    for step in (T.expanded, T.urls_replaced):
        assert str(step(F.upper("t"))).count("upper") == 1
    assert one(spark, T.collapsed, "\ta  b\nc d \t e\r\n") == "a b c d e"
    assert one(spark, T.without_emojis, "a\x00☃b\U0001f600 ﻿\xa0€é~\x7f") == "ab \xa0€é~"
    assert one(spark, T.expanded, "CAN'T gonna, gonnas it's been") == "cannot going to , gonnas it has been"
