"""TF-IDF, chi-squared scores, Naive Bayes and their evaluation, as aggregates over long tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tokens of a batch that are counted at a time, unless one document has more.
TOKENS_AT_ONCE = 400_000


def document_counts(batch: pa.RecordBatch, lo: int = 1, hi: int = 1, sep: str = " ", group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(row of the batch, term, tf) of the n-grams of lo to hi tokens of each row of ``tokens``, some rows at a time: a document
    is in one row, so its terms are counted where it is read and no occurrence is shuffled.

    Rows are counted together whose number in ``group`` is the same. Without a separator, tokens are the characters of
    ``tokens``, and blank grams are left out.
    """
    column = batch.column("tokens")
    if not sep:
        column = pc.fill_null(column, "")
    sizes = (pc.fill_null(pc.list_value_length(column), 0) if sep else pc.utf8_length(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    at, first = np.concatenate([[0], np.cumsum(sizes)]), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(at, at[first] + TOKENS_AT_ONCE, side="right")) - 1)
        part = column.slice(first, last - first)
        tokens = pc.list_flatten(part) if sep else pa.array(list("".join(part.to_pylist())), pa.string())
        row = np.repeat(np.arange(first, last), sizes[first:last])
        rows, grams, gram = [], [], tokens
        for n in range(1, hi + 1):
            if n > 1:
                gram = pc.binary_join_element_wise(gram.slice(0, max(0, len(gram) - 1)), tokens.slice(n - 1), sep)
            if n >= lo:
                whole = row[: len(gram)] == row[len(row) - len(gram) :]
                rows.append(row[: len(gram)][whole])
                grams.append(gram.filter(pa.array(whole)))
        if rows and sum(map(len, rows)):
            coded, rows = pa.concat_arrays(grams).dictionary_encode(), np.concatenate(rows)
            words, kept = coded.dictionary, len(coded.dictionary)
            key, tf = np.unique((rows if group is None else group[rows]) * kept + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            if not sep:
                shown = pc.not_equal(pc.utf8_trim(words, " "), "").to_numpy(zero_copy_only=False)[key % kept]
                key, tf = key[shown], tf[shown]
            yield key // kept, words.take(pa.array(key % kept)), tf
        first = last


def _typed(df: DataFrame, columns, more: str) -> StructType:
    """A schema of columns of df and more."""
    return StructType([*[df.schema[c] for c in columns], *StructType.fromDDL(more)])


def gram_counts(tokens: DataFrame, lo: int = 1, hi: int = 1, keys: tuple[str, ...] = (), sep: str = " ", where=None) -> DataFrame:
    """(keys, term, n): how often each n-gram of lo to hi tokens occurs with each value of the keys. Rows that are read together
    are counted together, and ``where``, a condition on a term, is asked before counts are shuffled."""

    def count(batches):
        for batch in batches:
            seen: dict = {}
            group = np.array([seen.setdefault(k, i) for i, k in enumerate(zip(*[batch.column(k).to_pylist() for k in keys]))] if keys else [0] * batch.num_rows, np.int64)
            for row, term, n in document_counts(batch, lo, hi, sep, group):
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in keys], term, pa.array(n, pa.int64())], names=[*keys, "term", "n"])

    counted = tokens.select(*keys, "tokens").mapInArrow(count, _typed(tokens, keys, "term string, n long"))
    return (counted if where is None else counted.where(where)).groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def term_counts(tokens: DataFrame, lo: int = 1, hi: int = 1, also: tuple[str, ...] = (), sep: str = " ") -> DataFrame:
    """(doc_id, also, term, tf) of rows (doc_id, tokens), one a document: n-grams of lo to hi tokens."""
    keys = ("doc_id", *also)

    def count(batches):
        for batch in batches:
            for row, term, tf in document_counts(batch, lo, hi, sep):
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in keys], term, pa.array(tf, pa.int64())], names=[*keys, "term", "tf"])

    return tokens.select(*keys, "tokens").mapInArrow(count, _typed(tokens, keys, "term string, tf long"))


def weighted(tokens: DataFrame, vocab: DataFrame, sublinear: bool = False, lo: int = 1, hi: int = 1, also: tuple[str, ...] = (), sep: str = " ") -> DataFrame:
    """(doc_id, also, term, weight) with rows of length 1, as ``tfidf`` of ``term_counts`` has them, where documents are read:
    counts, the words that are kept and lengths need no shuffle. vocab (term, idf) is bounded, as it goes to every task."""
    kept = vocab.select("term", "idf").toArrow().combine_chunks()
    terms, idf = kept.column("term").combine_chunks(), kept.column("idf").to_numpy()
    shared, keys = tokens.sparkSession.sparkContext.broadcast((terms, idf)), ("doc_id", *also)

    def weigh(batches):
        terms, idf = shared.value
        for batch in batches:
            for row, term, tf in document_counts(batch, lo, hi, sep):
                place = pc.index_in(term, value_set=terms)
                known = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
                if not len(known):
                    continue
                row, tf, term = row[known], tf[known].astype(np.float64), term.take(pa.array(known))
                v = (np.log(tf) + 1 if sublinear else tf) * idf[pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[known]]
                norm = np.sqrt(np.bincount(row - row[0], weights=v * v))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row)) for k in keys], term, pa.array(v / norm[row - row[0]])], names=[*keys, "term", "weight"])

    return tokens.select(*keys, "tokens").mapInArrow(weigh, _typed(tokens, keys, "term string, weight double"))


def within(totals: DataFrame, n_docs: DataFrame, least: int = 1, most: float = 1.0) -> DataFrame:
    """The terms (term, df, total) within the document-frequency limits; n_docs has one row (n)."""
    v = totals.crossJoin(F.broadcast(n_docs))
    return v.where((F.col("df") >= least) & (F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * most))))


def most_frequent(v: DataFrame, features: int | None = None) -> DataFrame:
    """(term, df, idf) of terms (term, df, total, n), the most frequent first."""
    if features:
        v = v.orderBy(F.desc("total"), "term").limit(features)
    return v.select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, least: int = 1, most: float = 1.0, features: int | None = None) -> DataFrame:
    """(term, df, idf) of the terms within the document-frequency limits, the most frequent first; n_docs has one row (n)."""
    return most_frequent(within(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), n_docs, least, most), features)


def tfidf(counts: DataFrame, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """(doc_id, term, weight) with rows of length 1."""
    tf = F.log("tf") + 1 if sublinear else F.col("tf")
    raw = counts.join(vocab, "term").select("doc_id", "term", (tf * F.col("idf")).alias("v"))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", (F.col("v") / F.col("norm")).alias("weight"))


def with_label(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """weights with the label of each document, unless they have it."""
    return weights if "label" in weights.columns else weights.join(labels, "doc_id")


def chi2(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, score): observed against expected sums of the weights by class. weights may have labels already."""
    return chi2_of_sums(with_label(weights, labels).groupBy("term", "label").agg(F.sum("weight").alias("o")), labels.groupBy("label").agg(F.count("*").alias("c")))


def chi2_of_sums(seen: DataFrame, classes: DataFrame) -> DataFrame:
    """(term, score) of the sums of the weights by class (term, label, o) and the classes' sizes (label, c)."""
    shares = classes.crossJoin(F.broadcast(classes.agg(F.sum("c").alias("n")))).select("label", (F.col("c") / F.col("n")).alias("p"))
    total = seen.groupBy("term").agg(F.sum("o").alias("t"))
    grid = total.crossJoin(F.broadcast(shares)).join(seen, ["term", "label"], "left").fillna(0.0, ["o"])
    e = F.col("p") * F.col("t")
    return grid.groupBy("term").agg(F.sum((F.col("o") - e) ** 2 / e).alias("score"))


def fit_multinomial(weights: DataFrame, labels: DataFrame, alphas=(1.0,)) -> tuple[DataFrame, DataFrame]:
    """Log shares (alpha, label, term, logp) and priors (label, prior); sums are made once for all alphas. weights may have
    labels already."""
    sums = with_label(weights, labels).where("label IS NOT NULL").groupBy("label", "term").agg(F.sum("weight").alias("s"))
    terms = sums.select("term").distinct()
    classes = sums.groupBy("label").agg(F.sum("s").alias("total")).crossJoin(F.broadcast(terms.agg(F.count("*").alias("v"))))
    grid = terms.crossJoin(F.broadcast(classes)).join(sums, ["label", "term"], "left").fillna(0.0, ["s"])
    grid = grid.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    logp = grid.select("alpha", "label", "term", F.log((F.col("s") + F.col("alpha")) / (F.col("total") + F.col("alpha") * F.col("v"))).alias("logp"))
    n = labels.agg(F.count("*").alias("n"))
    return logp, labels.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("label", F.log(F.col("c") / F.col("n")).alias("prior"))


def by_term(logp: DataFrame) -> DataFrame:
    """(term, of): a term's log shares in one row, so that a bounded vocabulary is broadcast once for all classes and alphas."""
    return logp.groupBy("term").agg(F.collect_list(F.struct(*[c for c in logp.columns if c != "term"])).alias("of"))


def predict_multinomial(weights: DataFrame, logp: DataFrame, priors: DataFrame) -> DataFrame:
    """(alpha, doc_id, predicted): the class with the largest sum, ties by name. The vocabulary is bounded and broadcast, so a
    document's sums are added up where its weights are read."""
    seen = weights.join(F.broadcast(by_term(logp)), "term").select("doc_id", "weight", F.inline("of"))
    scores = seen.groupBy("alpha", "doc_id", "label").agg(F.sum(F.col("weight") * F.col("logp")).alias("s")).join(F.broadcast(priors), "label")
    best = F.row_number().over(Window.partitionBy("alpha", "doc_id").orderBy(F.desc(F.round(F.col("s") + F.col("prior"), 9)), "label"))
    return scores.withColumn("r", best).where("r = 1").select("alpha", "doc_id", F.col("label").alias("predicted"))


def gaussian_scores(train: DataFrame, rows: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(id, label, s): log joint density of rows (id, embedding) in each class of train (id, embedding, label)."""
    long = train.select("id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    eps = long.groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.greatest(smoothing * F.max("v"), F.lit(1e-12)).alias("eps"))
    stats = long.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).crossJoin(F.broadcast(eps)).select("label", "dim", "m", (F.col("v") + F.col("eps")).alias("v"))
    n = train.agg(F.count("*").alias("n"))
    priors = train.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("label", F.log(F.col("c") / F.col("n")).alias("prior"))
    seen = rows.select("id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    d = F.col("x") - F.col("m")
    score = seen.join(F.broadcast(stats), "dim").groupBy("id", "label").agg(F.sum(-0.5 * (F.log(6.283185307179586 * F.col("v")) + d * d / F.col("v"))).alias("s")).join(F.broadcast(priors), "label")
    return score.select("id", "label", (F.col("s") + F.col("prior")).alias("s"))


def gaussian(train: DataFrame, rows: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(id, predicted): the class with the largest score, ties by name."""
    r = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("s", 6)), "label"))
    return gaussian_scores(train, rows, smoothing).withColumn("r", r).where("r = 1").select("id", F.col("label").alias("predicted"))


def posteriors(scores: DataFrame, key: str = "id") -> DataFrame:
    """scores (key, label, s) with p, their softmax within each key."""
    w = Window.partitionBy(key)
    e = scores.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def best_epochs(history: DataFrame, run: str, epoch: str, loss: str, patience: int = 3) -> DataFrame:
    """Of each run: the epoch at which training stops (``patience`` epochs without a new least loss, else the last) and the best until then."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    h = history.withColumn("_least", F.min(loss).over(before))
    h = h.withColumn("_new", F.when(F.col("_least").isNull() | (F.col(loss) < F.col("_least")), F.col(epoch)))
    h = h.withColumn("_at", F.max("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    stops = F.coalesce(F.min(F.when(F.col(epoch) - F.col("_at") >= patience, F.col(epoch))), F.max(epoch))
    stopped = h.groupBy(run).agg(stops.alias("stop_epoch"))
    kept = h.join(stopped, run).where(F.col(epoch) <= F.col("stop_epoch"))
    return kept.groupBy(run, "stop_epoch").agg(F.max("_at").alias("best_epoch"), F.min(loss).alias("best_loss"))


def confusion(pred: DataFrame) -> DataFrame:
    """All (actual, predicted) pairs of labels with their counts, zeros included."""
    labels = pred.select(F.col("actual").alias("l")).union(pred.select("predicted")).distinct()
    grid = labels.select(F.col("l").alias("actual")).crossJoin(F.broadcast(labels.select(F.col("l").alias("predicted"))))
    return grid.join(pred.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").fillna(0, ["n"])


def report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, with accuracy and macro F1; a zero division is zero."""
    c = confusion(pred)
    tp = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), tp.alias("tp"))
    cols = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    r = rows.join(cols, "class")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    r = r.withColumn("precision", ratio(F.col("tp"), F.col("claimed"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    r = r.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    total = r.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("weighted_f1"))
    out = r.crossJoin(F.broadcast(total))
    return out.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1")])


def standardized(df: DataFrame) -> DataFrame:
    """(id, dim, z) of (id, embedding) by the population deviation of each dimension; a constant dimension is 0."""
    long = df.select("id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    s = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return long.join(F.broadcast(s), "dim").select("id", "dim", F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd")).otherwise(0.0).alias("z"))


def fold_scores(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, accuracy, macro_f1) of (fold, actual, predicted), in one aggregation of hits and misses by class."""
    side = lambda c, tp, miss: F.struct(F.col(c).alias("class"), F.lit(tp).alias("tp"), F.lit(miss).alias("miss"))
    sides = F.when(F.col("actual") == F.col("predicted"), F.array(side("actual", 1, 0))).otherwise(F.array(side("actual", 0, 1), side("predicted", 0, 1)))
    by_class = pred.select(fold, F.explode(sides).alias("s")).groupBy(fold, "s.class").agg(F.sum("s.tp").alias("tp"), F.sum("s.miss").alias("miss"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("miss"))
    return by_class.groupBy(fold).agg((F.sum("tp") / (F.sum("tp") + F.sum("miss") / 2)).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def cross_validated(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population deviation of accuracy and macro F1 over the folds."""
    s = fold_scores(pred, fold)
    return s.agg(*[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("accuracy", "macro_f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def reply_scores(pred: DataFrame, labels, case_sensitive: bool = True) -> DataFrame:
    """Language model replies (actual, predicted): accuracy and macro F1 among replies within the labels, and how many are not.

    Without any reply within the labels, the scores are 0.
    """
    if not case_sensitive:
        pred, labels = pred.withColumns({c: F.lower(c) for c in ("actual", "predicted")}), [x.lower() for x in labels]
    known = F.col("predicted").isin(*labels)
    hit, share = known & (F.col("actual") == F.col("predicted")), F.try_divide
    of = lambda c, x: F.count_if(known & (F.col(c) == x))
    f1 = sum((F.coalesce(share(2 * F.count_if(hit & (F.col("actual") == x)), of("actual", x) + of("predicted", x)), F.lit(0.0)) for x in labels), F.lit(0.0))
    return pred.agg(
        F.count("*").alias("total"), F.count_if(~known).alias("out_of_vocab"), F.round(F.coalesce(share(F.count_if(hit), F.count_if(known)), F.lit(0.0)), 6).alias("accuracy"), F.round(f1 / len(labels), 6).alias("macro_f1")
    )
