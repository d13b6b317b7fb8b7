"""Arabic rules, lemmas, emoticons, features and classes in ranges, against plain Python; the sequence classifier on order."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import lexicons as L
from textloom.functions import text as T
from textloom.operators import filters, profiles, sampling, sequence


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]


def test_words_of_lists_take_the_shape_of_tokens(spark):
    """The driver's shape of a listed word is the column's, for every list."""
    words = [*L.ARABIC_GENERAL, *L.ARABIC_CONSULTATION, *L.ARABIC_LABEL_WORDS, *L.ARABIC_DATA_WORDS, *L.ARABIC_DISCOURSE, *L.ARABIC_NEGATIONS, "والسلام", "للعلاج", "فشكرا", "وكالة", "فالقلق", "البيت", "ووالبيت"]
    assert column(spark, T.normal_arabic, words) == [" ".join(T.plain_arabic(w).split()) if all("\u0600" <= c <= "\u06ff" or c == " " for c in T.plain_arabic(w)) else " ".join(re.sub("[^\u0600-\u06ff]", " ", T.plain_arabic(w)).split()) for w in words]
    plain = [T.plain_arabic(w) for w in words]
    assert column(spark, T.canonical_arabic, plain) == [T.canonical_word(w) for w in words]


@pytest.mark.parametrize("word, want", [
    ("والبيت", "بيت"), ("للعلاج", "علاج"), ("ووالبيت", "ووالبيت"), ("فشكرا", "شكرا"), ("وكاله", "وكاله"), ("الله", "الله"), ("بالله", "الله"), ("الناس", "الناس"), ("الام", "الام"), ("البيت", "بيت"), ("فالقلق", "قلق"),
])
def test_clitics(spark, word, want):
    assert column(spark, T.canonical_arabic, [word]) == [want] and T.canonical_word(word) == want


def test_negations_stay(spark):
    assert not {"لا", "لم", "ليس", "بدون"} & set(T.arabic_stopwords()) and {"لا", "لم"} <= set(T.arabic_stopwords(False))
    assert column(spark, T.arabic_tokens, ["أنا لا أنام، وليس عندي سبب في البيت"]) == [["لا", "انام", "وليس", "سبب", "بيت"]]
    assert column(spark, T.arabic_phrase, ["السلام   عليكم!!", ""]) == ["سلام عليكم", ""]
    got = column(spark, lambda c: T.arabic_ngrams(F.split(c, " "), 2), ["قلق شديد جزيل شكر نوم قليل"])
    assert got == [["قلق شديد", "نوم قليل"]]


def test_arabic_steps_are_written_out_once(spark):
    """An expression names its text a few times, not a power of the steps; and grams are as many as counted one by one."""
    assert str(T.canonical_arabic(F.col("needle"))).count("needle") == 1
    assert str(T.arabic_ngrams(F.col("needle"), 3)).count("needle") < 10
    words = "لا انام والبيت قلق شديد جزيل شكر نوم في من قليل".split()
    stop, known = set(T.arabic_stopwords()), {" ".join(T.canonical_word(w) for w in T.plain_arabic(p).split()) for p in L.ARABIC_PHRASES}
    for n in (1, 2, 3):
        grams = [words[i : i + n] for i in range(len(words) - n + 1)]
        again = [[T.canonical_word(w) for w in g] for g in grams]
        want = [" ".join(g) for g, a in zip(grams, again) if " ".join(a) not in known and (n < 2 or sum(w in stop for w in a) < n - 1)]
        assert column(spark, lambda c, n=n: T.arabic_ngrams(F.split(c, " "), n), [" ".join(words)]) == [want]


def test_lemmas(spark):
    words = ["was", "studies", "running", "glasses", "class", "cats", "bus", "his", "ing", "carried", "churches", "nationalities"]
    assert column(spark, T.lemma, words) == ["be", "study", "runn", "glass", "class", "cat", "bus", "his", "ing", "carry", "church", "nationality"]
    assert column(spark, T.french_lemma, ["suis", "chevaux", "directrices", "mangées", "portes", "pas", "nations"]) == ["être", "cheval", "directeur", "manger", "porte", "pas", "nation"]


def test_emoticons(spark):
    r = random.Random(5)
    parts = [":)", ":-))", ":(", ":D", "xD", "XD", "<3", "</3", "=)", "8-D", "o/", "\\o/", "T_T", "^_^", "^^", "-_-", "u_u", ":P", ";)", ">:(", "¯\\_(ツ)_/¯", "a", " ", "word", "é", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300)]
    both = lambda p: rf"(?<!\w){p}(?!\w)"
    want = [[m for p in L.EMOTICONS for m in re.findall(both(p), t, re.IGNORECASE)] + re.findall(L.SHRUG, t) for t in texts]
    assert column(spark, T.emoticons_found, texts) == want
    count = lambda t: sum(len(re.findall(p, t, re.IGNORECASE)) for p in L.FRENCH_EMOTICONS)
    assert column(spark, T.french_emoticons, texts) == [count(t) for t in texts]


def test_contractions_in_one_pass(spark):
    """The same as one contraction after the other, the longest first."""
    r = random.Random(8)
    words = [*L.CONTRACTIONS, "it's been", "can't", "IT'S", "Gonna", "river", "don", "t", "'", "won't.", "x'll", "(i'm)", "idk,idk"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(9))) for _ in range(400)] + ["", "don't", "can't've", "i'm i'm"]

    def plain(t):
        for k in sorted(L.CONTRACTIONS, key=lambda k: (-len(k), k)):
            t = re.sub(rf"\b{re.escape(k)}\b", f" {L.CONTRACTIONS[k]} ", t, flags=re.IGNORECASE)
        return re.sub(r"\s+", " ", t).strip()

    assert column(spark, T.expanded, texts) == [plain(t) for t in texts]


def test_file_names():
    assert T.file_name(' a/b\\c: "x"?? ') == "a_b_c: _x_"


def test_cleaned_english(spark):
    rows = [(1, "I can't go :)"), (1, "I can't go :)"), (2, "N/A"), (3, None), (4, "?!..."), (5, "Rivers <b>run</b> deep")]
    got = {r.id: (r.cleaned_text, r.tokens) for r in profiles.cleaned_english(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert set(got) == {1, 5} and "cannot" in got[1][0] and got[5][1] == ["rivers", "run", "deep"]


def test_averages(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 0), ("b", 4, 0)], "label string, x int, y int")
    assert {tuple(r) for r in profiles.averages(df, "label", "x", "y").collect()} == {("b", "x", 4.0, 1), ("a", "x", 2.0, 2), ("a", "y", 0.0, 1), ("b", "y", 0.0, 2)}


def test_arabic_block_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "السلام عليكم 😀 :)"), (4, "القلق والتوتر يا دكتور، ما تشخيصكم؟"), (5, "القلق والتوتر يا دكتور ما تشخيصكم")], "id int, text string")
    got = {r.id: r for r in profiles.arabic_features(df).collect()}
    assert got[1].token_count_clean == 0 and got[1].is_very_short_clean and got[1].is_duplicate_clean and got[3].emoji_count == 1 and got[3].emoticon_count == 1
    assert got[4].is_duplicate_clean and got[4].clean_text == got[5].clean_text and got[4].punct_count == 2 and not got[3].is_duplicate_clean


def test_classes_in_ranges(spark):
    """Numbers of a class are those of one window over the class, null classes too."""
    import hashlib

    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.choice("xy")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, label string, part string").repartition(6)
    got = {x.id: (x.at, x.n) for x in sampling.numbered(df, "id", 42, "label").collect()}
    for label in ("a", "b", None):
        ids = sorted((i for i, c, _ in rows if c == label), key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        assert [got[i] for i in ids] == [(k, len(ids)) for k in range(1, len(ids) + 1)]
    assert len(sampling.numbered(df, "id", 42, "label", "part").collect()) == 3000


def test_first_and_flags_by_digest(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (5, None), (4, "y")], "id int, text string")
    assert sorted(r.id for r in filters.first_of_each(df, "text", "id").collect()) == [1, 2, 4]
    assert {r.id: r.twice for r in filters.duplicate_flags(df, "text", "twice").collect()} == {1: True, 3: True, 2: False, 5: False, 4: False}


# ---------------------------------------------------------------- sequences


def test_gradient_is_the_slope():
    import pyarrow as pa

    form = sequence.Shape(hashed=20, width=3, window=3, filters=4, classes=3)
    w = form.start(1)
    w[96:100] = [0.1, -0.2, 0.3, 0.15]
    ids = pa.array([[1, 2, 3, 4, 5, 6], [7], [], [2, 2, 2, 9, 11, 19, 3]], pa.list_(pa.int32()))
    code = np.array([0, 1, 2, 1])
    loss = lambda v: sum(-sequence.forward(form, form.split(v), x)[0][np.arange(len(at)), code[at]].sum() for at, x in sequence.padded(ids))
    got = sum(sequence.gradient(form, form.split(w), x, code[at])[1] for at, x in sequence.padded(ids))
    step = 1e-6 * np.eye(len(w))
    assert np.abs(got - [(loss(w + s) - loss(w - s)) / 2e-6 for s in step]).max() < 1e-7


def ordered(spark, seed, n):
    """"no" and "good" among other words: the label is whether "no" stands right before "good"; the bag of words is the same."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice("river stone lamp rain road tree".split()) for _ in range(r.randrange(4, 12))]
        at, label = r.randrange(len(words)), r.choice(["after", "before"])
        rows.append((i, words[:at] + (["no", "good"] if label == "before" else ["good", "no"]) + words[at:], label))
    return spark.createDataFrame(rows, "id long, tokens array<string>, label string").repartition(4)


def test_sequence_learns_order(spark, tmp_path):
    train, val, test = ordered(spark, 1, 400), ordered(spark, 2, 100), ordered(spark, 3, 200)
    model = sequence.fit(train, val, epochs=60, hashed=256)
    truth = {r.id: r.label for r in test.collect()}
    got = {r.id: r.predicted for r in model.predict(test).collect()}
    assert np.mean([got[i] == truth[i] for i in truth]) > 0.95
    losses = [h["val_loss"] for h in model.history]
    assert losses[-1] < losses[0] / 2
    model.save(spark, f"{tmp_path}/cnn")
    again = sequence.load(spark, f"{tmp_path}/cnn")
    assert {r.id: r.predicted for r in again.predict(test).collect()} == got
    # Bayes sees the same words in both labels.
    from textloom.operators import fitted

    text = lambda df: df.select(F.col("id").alias("doc_id"), F.array_join("tokens", " ").alias("text"), "label")
    bayes = {r.doc_id: r.predicted for r in fitted.fit(text(train), "word", 1, 1, least=1, most=1.0).predict(text(test)).collect()}
    assert np.mean([bayes[i] == truth[i] for i in truth]) < 0.7


def test_sequence_edges_and_early_stop(spark):
    rows = [(1, ["a", "b"], "x"), (2, [], "y"), (3, None, "x"), (4, ["c"] * 5000, "y"), (5, ["a"], None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, label string")
    model = sequence.fit(df, df.where("id < 0"), epochs=3, hashed=64)
    assert len(model.history) == 3 and {r.id for r in model.predict(df).collect()} == {1, 2, 3, 4, 5}
    wrong = spark.createDataFrame([(1, ["a", "b"], "y"), (4, ["c"], "x")], "id long, tokens array<string>, label string")
    stopped = sequence.fit(df, wrong, epochs=60, patience=3, hashed=64)
    assert len(stopped.history) < 60
