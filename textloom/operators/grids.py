"""Searches over settings: all runs of a grid in a few passes, the best by the validation split, refitted on both and tested once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dense import LEAST_VARIANCE, MODES, Projection, fit_projection, load_projection, prepared
from .models import document_counts, term_counts
from .partial import matrix, partitions, settled, tree_sum

#: The settings that are tried with words: longest n-gram, documents a term is in at least, terms kept, smoothing.
NGRAMS, LEAST_DOCS, FEATURES, ALPHAS = (1, 2), (1, 2, 3), (30_000, 50_000, 80_000), (0.01, 0.1, 0.5, 1.0, 2.0)
#: And with vectors: axes kept and variance smoothing, for each mode of dense.MODES, whitened and not.
AXES, SMOOTHING = (16, 32, 64, 96, 128, 192, 256, 384, 512, 768), (1e-12, 1e-11, 1e-10, 1e-9, 1e-8, 1e-7, 1e-6)
MOST_SHARE = 0.95


@dataclass(frozen=True)
class WordLists:
    """The terms of all settings, one after the other: idf, and for each pair of longest n-gram and least document frequency the
    rank by total, then name (NOWHERE where the list lacks the term). Limits bound them, so they go to every task."""

    pairs: list[tuple[int, int]]
    terms: pa.Array
    idf: np.ndarray
    ranks: np.ndarray

    def entries(self, batch: pa.RecordBatch, hi: int):
        """(row, place of the term, tf * idf) of the known terms of a batch's documents, some documents at a time."""
        for row, term, tf in document_counts(batch, 1, hi):
            place = pc.index_in(term, value_set=self.terms)
            known = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
            if len(known):
                at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False)[known]
                yield row[known], at, tf[known] * self.idf[at]

    def weights(self, row: np.ndarray, at: np.ndarray, v: np.ndarray, features) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each setting (pair, then limit) which entries are in its list, and their weights in rows of length 1."""
        row = row - row[0]
        for ranks in self.ranks:
            for f in features:
                own = np.flatnonzero(ranks[at] <= f)
                norm = np.sqrt(np.bincount(row[own], weights=v[own] * v[own], minlength=row[-1] + 1))
                yield own, v[own] / norm[row[own]]


NOWHERE = np.iinfo(np.int32).max


def word_lists(fitted: DataFrame, n_docs: int, ngrams, least_docs, features) -> WordLists:
    """The lists of (doc_id, tokens). Terms that occur once are most of all pairs of words; they are written only if the others
    do not fill a list, which is seen from their number."""

    def counted(hi):
        terms = term_counts(fitted, 1, hi).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        return terms.where(F.col("df") <= max(1, int(n_docs * MOST_SHARE))).withColumn("size", F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1)

    often, most, pairs, out = settled(counted(max(ngrams)).where("total > 1"), "terms"), max(features), list(product(ngrams, least_docs)), None
    for number, (hi, least) in enumerate(pairs):
        full = least > 1 or often.where(F.col("size") <= hi).limit(most).count() == most
        kept = (often if full else counted(hi)).where((F.col("size") <= hi) & (F.col("df") >= least)).orderBy(F.desc("total"), "term").limit(most)
        kept = kept.select(F.lit(number).alias("number"), "term", (F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1).alias("idf"), F.row_number().over(Window.orderBy(F.desc("total"), "term")).alias("rank"))
        out = kept if out is None else out.unionByName(kept)
    table = out.toArrow().combine_chunks()
    coded = table.column("term").combine_chunks().dictionary_encode()
    at, number = coded.indices.to_numpy(zero_copy_only=False), table.column("number").to_numpy()
    idf, ranks = np.zeros(len(coded.dictionary)), np.full((len(pairs), len(coded.dictionary)), NOWHERE, np.int32)
    idf[at], ranks[number, at] = table.column("idf").to_numpy(), table.column("rank").to_numpy()
    return WordLists(pairs, coded.dictionary, idf, ranks)


def _word_sums(fitted: DataFrame, lists: WordLists, hi: int, features) -> tuple[list[str], np.ndarray]:
    """Labels in order, and sums of weights by setting, label and term. Tasks add up what they read, and Spark the rest."""
    shared, many = fitted.sparkSession.sparkContext.broadcast(lists), len(lists.pairs) * len(features)

    def add(batches):
        own = shared.value
        for batch in batches:
            labels = batch.column("label").dictionary_encode()
            code, size = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(own.idf)
            for row, at, v in own.entries(batch, hi):
                key, place = np.unique(code[row] * size + at, return_inverse=True)
                sums = [pa.array(np.bincount(place[i], weights=w, minlength=len(key))) for i, w in own.weights(row, at, v, features)]
                yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(key // size)), pa.array(key % size), *sums], names=["label", "at", *[f"s{c}" for c in range(many)]])

    rows = fitted.where("label IS NOT NULL").select("label", "tokens").mapInArrow(add, "label string, at long, " + ", ".join(f"s{c} double" for c in range(many)))
    table = rows.groupBy("label", "at").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(many)]).toArrow()
    names = table.column("label").to_pylist()
    labels = sorted(set(names))
    sums, code, at = np.zeros((many, len(labels), len(lists.idf))), np.array([labels.index(x) for x in names], np.int64), table.column("at").to_numpy()
    for c in range(many):
        sums[c, code, at] = table.column(f"s{c}").to_numpy()
    return labels, sums


SCORED = "ngram_max int, min_df int, max_features int, alpha double, retained long"


def words_scored(fitted: DataFrame, tested: DataFrame, ngrams=NGRAMS, least_docs=LEAST_DOCS, features=FEATURES, alphas=ALPHAS) -> DataFrame:
    """(ngram_max, min_df, max_features, alpha, retained, doc_id, actual, predicted): TF-IDF and multinomial Naive Bayes learned from
    ``fitted`` (doc_id, label, tokens), applied to ``tested`` (the same columns), for every combination of the settings.

    A document is counted and weighted where it is read, for all settings at once. What is shuffled are counts of terms, and sums
    by label and term of the lists, which the limits bound; no weights are written.
    """
    n_docs, hi = fitted.count(), max(ngrams)
    lists = word_lists(fitted, n_docs, ngrams, least_docs, features)
    labels, sums = _word_sums(fitted, lists, hi, features)
    counts = {r.label: r.n for r in fitted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = np.log(np.array([counts[x] for x in labels]) / max(1, n_docs))
    settings = [(*pair, f, int((ranks <= f).sum())) for pair, ranks in zip(lists.pairs, lists.ranks) for f in features]
    shared = tested.sparkSession.sparkContext.broadcast((lists, labels, sums, prior, settings))

    def predict(batches):
        lists, labels, sums, prior, settings = shared.value
        totals = sums.sum(2)
        for batch in batches:
            x, w = np.zeros((len(settings), len(alphas), len(labels), batch.num_rows)), np.zeros((len(settings), batch.num_rows))
            for row, at, v in lists.entries(batch, hi):
                low, high = row[0], row[-1] + 1
                for c, (own, u) in enumerate(lists.weights(row, at, v, features)):
                    there, term = row[own] - low, at[own]
                    w[c, low:high] += np.bincount(there, weights=u, minlength=high - low)
                    for k in range(len(labels)):
                        s = sums[c, k, term]
                        for i, a in enumerate(alphas):
                            x[c, i, k, low:high] += np.bincount(there, weights=u * np.log(s + a), minlength=high - low)
            for c, (ngram, least, f, retained) in enumerate(settings):
                # A label without a term of the list has no part in the run.
                able = np.flatnonzero(totals[c] > 0)
                for i, a in enumerate(alphas if len(able) else ()):
                    score = x[c, i, able] - w[c] * np.log(totals[c, able] + a * retained)[:, None] + prior[able, None]
                    best = able[np.round(score, 9).argmax(0)]
                    same = lambda value, kind: pa.repeat(pa.scalar(value, kind), batch.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [same(ngram, pa.int32()), same(least, pa.int32()), same(f, pa.int32()), same(float(a), pa.float64()), same(retained, pa.int64()), batch.column("doc_id"), batch.column("label"), pa.array([labels[k] for k in best], pa.string())],
                        names=["ngram_max", "min_df", "max_features", "alpha", "retained", "doc_id", "actual", "predicted"],
                    )

    kind = tested.schema["doc_id"].dataType.simpleString()
    return tested.select("doc_id", "label", "tokens").mapInArrow(predict, f"{SCORED}, doc_id {kind}, actual string, predicted string")


def scored(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, accuracy, macro_precision, macro_recall, macro_f1) of (by, actual, predicted), over the labels on either side."""
    cells = pred.groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    side = lambda c, claimed: F.struct(F.col(c).alias("label"), (hit if not claimed else F.lit(0)).alias("tp"), (F.lit(0) if claimed else F.col("n")).alias("support"), (F.col("n") if claimed else F.lit(0)).alias("claimed"))
    sides = cells.select(*by, F.explode(F.array(side("actual", False), side("predicted", True))).alias("s")).groupBy(*by, "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "claimed")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, support, claimed = (F.col(c).cast("double") for c in ("tp", "support", "claimed"))
    return sides.groupBy(*by).agg(
        F.round(F.sum(tp) / F.sum(support), 6).alias("accuracy"), F.round(F.avg(ratio(tp, claimed)), 6).alias("macro_precision"), F.round(F.avg(ratio(tp, support)), 6).alias("macro_recall"),
        F.round(F.avg(ratio(2 * tp, support + claimed)), 6).alias("macro_f1"),
    )


def words_searched(tokens: DataFrame, split: DataFrame, ngrams=NGRAMS, least_docs=LEAST_DOCS, features=FEATURES, alphas=ALPHAS) -> DataFrame:
    """The runs with their validation scores and place; the first one also has the scores of its refit on train and val, on test.

    split is (doc_id, label, split). The best has the largest macro F1, then accuracy, then is the first in the grid's order.
    """
    rows = settled(tokens.select("doc_id", "tokens").join(split.select("doc_id", "label", "split"), "doc_id"), "rows")
    part = lambda *names: rows.where(F.col("split").isin(*names)).select("doc_id", "label", "tokens")
    setting = ["ngram_max", "min_df", "max_features", "alpha", "retained"]
    pred = words_scored(part("train"), part("val"), ngrams, least_docs, features, alphas)
    runs = scored(pred, setting)
    place = F.row_number().over(Window.orderBy(F.desc("macro_f1"), F.desc("accuracy"), *setting[:4]))
    ranked = settled(runs.withColumn("place", place), "grid")
    best = ranked.where("place = 1").first()
    if best is None:
        return ranked.select("*", *[F.lit(None).cast("double").alias(f"test_{c}") for c in ("accuracy", "macro_f1")])
    final = words_scored(part("train", "val"), part("test"), (best.ngram_max,), (best.min_df,), (best.max_features,), (best.alpha,))
    tested = scored(final, ["alpha"]).select(F.lit(1).alias("place"), F.col("accuracy").alias("test_accuracy"), F.col("macro_f1").alias("test_macro_f1"))
    return ranked.join(F.broadcast(tested), "place", "left")


@dataclass(frozen=True)
class GaussianModel:
    """Gaussian Naive Bayes over the axes of a projection."""

    projection: Projection
    labels: list[str]
    means: np.ndarray
    variances: np.ndarray
    priors: np.ndarray

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, predicted): the label with the largest density, the first of equals; rows without a vector are left out."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def classify(batches):
            own = shared.value
            for batch in batches:
                at = log_density(batch.column("projected"), own).argmax(1) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([own.labels[i] for i in at], pa.string())], names=["id", "predicted"])

        def log_density(column, own):
            return _densities(matrix(column), own.means, own.variances) + own.priors

        kind = rows.schema["id"].dataType.simpleString()
        return self.projection.project(rows).mapInArrow(classify, f"id {kind}, predicted string")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        self.projection.save(spark, f"{path}/projection", mode)
        rows = [(x, float(p), [float(v) for v in m], [float(v) for v in s]) for x, p, m, s in zip(self.labels, self.priors, self.means, self.variances)]
        spark.createDataFrame(rows, "label string, prior double, means array<double>, variances array<double>").coalesce(1).write.mode(mode).parquet(f"{path}/classes")


def load_gaussian(spark: SparkSession, path: str) -> GaussianModel:
    rows = spark.read.parquet(f"{path}/classes").orderBy("label").collect()
    return GaussianModel(load_projection(spark, f"{path}/projection"), [r.label for r in rows], *[np.array([r[c] for r in rows]) for c in ("means", "variances", "prior")])


def _densities(x: np.ndarray, means: np.ndarray, variances: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Log densities of the rows of x in each class, by products of matrices; ``squares`` are those of x, if they are known."""
    squares = x * x if squares is None else squares
    const = np.log(2 * np.pi * variances).sum(1) + (means * means / variances).sum(1)
    return -0.5 * (const + squares @ (1 / variances).T - 2 * x @ (means / variances).T)


def _coded(rows: DataFrame, labels: list[str]) -> DataFrame:
    codes = F.create_map(*[F.lit(v) for pair in ((x, i) for i, x in enumerate(labels)) for v in pair])
    return rows.where(F.size("embedding") > 0).select(codes[F.col("label").cast("string")].alias("code"), "embedding")


def _class_sums(rows: DataFrame, projections: list[Projection], k: int, parts: int) -> np.ndarray:
    """(projection, class, 2, axes + 1): counts, sums and sums of squares of the unwhitened coordinates."""

    def block(batch):
        raw, code = matrix(batch.column("embedding")), batch.column("code").to_numpy()
        one = np.equal.outer(np.arange(k), code).astype(float)
        out = []
        for p in projections:
            x = (prepared(raw, p.mode) - p.center) / p.scale @ p.axes.T
            out.append(np.stack([np.hstack([one.sum(1)[:, None], one @ x]), np.hstack([one.sum(1)[:, None], one @ (x * x)])], 1))
        return np.stack(out)

    return tree_sum(rows, block, parts)


def _moments(sums: np.ndarray, whiten: np.ndarray | float, n_axes: int, smoothing: float):
    """Means, smoothed variances and log priors of the first n_axes, coordinates divided by ``whiten``."""
    n, total, squares = sums[:, 0, :1], sums[:, 0, 1:] / whiten, sums[:, 1, 1:] / whiten**2
    total, squares = total[:, :n_axes], squares[:, :n_axes]
    means = total / n
    everywhere = squares.sum(0) / n.sum() - (total.sum(0) / n.sum()) ** 2
    return means, np.maximum(squares / n - means * means, 0) + max(smoothing * everywhere.max(), 1e-12), np.log(n[:, 0] / n.sum())


def vectors_searched(train: DataFrame, val: DataFrame, test: DataFrame, axes=AXES, smoothing=SMOOTHING, modes=MODES) -> tuple[list[dict], GaussianModel, np.ndarray]:
    """Every run of (mode, whiten, axes, smoothing) of Gaussian Naive Bayes over principal axes, ranked by macro F1 on val, then
    accuracy, then order; the model of the best, refitted on train and val; and its (actual, predicted) counts on test.

    Frames are (id, embedding, label). Numbers of axes above the vectors' entries are left out. The axes of a smaller number are
    the first of a larger one, whitening divides each by a number, and smoothing is added to a variance: so one pass of
    class sums and one over val serve all runs, and only arrays of fixed size move.
    """
    labels = [r[0] for r in train.select(F.col("label").cast("string")).where("label IS NOT NULL").distinct().orderBy("label").collect()]
    k, spark = len(labels), train.sparkSession
    learn, judge = _coded(train, labels), _coded(val, labels)
    width = learn.agg(F.max(F.size("embedding"))).first()[0]
    axes = [a for a in axes if a <= width]
    projections = [fit_projection(train, max(axes), mode) for mode in modes]
    spread = [np.sqrt(np.maximum(p.variance, LEAST_VARIANCE)) for p in projections]
    sums = _class_sums(learn, projections, k, partitions(learn))
    runs = list(product(range(len(modes)), (False, True), axes, smoothing))
    fitted = [_moments(sums[m], spread[m] if white else 1.0, a, s) for m, white, a, s in runs]
    shared = spark.sparkContext.broadcast((projections, spread, runs, fitted))

    def counts(batch):
        own, scale, each, learned = shared.value
        raw, code = matrix(batch.column("embedding")), batch.column("code").to_numpy()
        out, last = np.zeros((len(each), k, k)), None
        for i, ((m, white, a, _), (means, variances, priors)) in enumerate(zip(each, learned)):
            if (m, white) != last:  # runs of one mode, then of one whitening, follow each other
                if last is None or m != last[0]:
                    plain = (prepared(raw, own[m].mode) - own[m].center) / own[m].scale @ own[m].axes.T
                x = plain / scale[m] if white else plain
                squares, last = x * x, (m, white)
            found = (_densities(x[:, :a], means, variances, squares[:, :a]) + priors).argmax(1)
            out[i] = np.bincount(code * k + found, minlength=k * k).reshape(k, k)
        return out

    table = tree_sum(judge.where("code IS NOT NULL"), counts, partitions(judge))
    grid = []
    for (m, white, a, s), c in zip(runs, table):
        tp, support, claimed = np.diag(c), c.sum(1), c.sum(0)
        share = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y > 0)
        there = support + claimed > 0
        grid.append({
            "mode": modes[m], "whiten": white, "axes": a, "smoothing": s, "accuracy": round(float(tp.sum() / max(1, c.sum())), 6), "macro_precision": round(float(share(tp, claimed)[there].mean()), 6),
            "macro_recall": round(float(share(tp, support)[there].mean()), 6), "macro_f1": round(float(share(2 * tp, support + claimed)[there].mean()), 6),
        })
    order = sorted(range(len(grid)), key=lambda i: (-grid[i]["macro_f1"], -grid[i]["accuracy"], i))
    for place, i in enumerate(order, 1):
        grid[i]["place"] = place
    m, white, a, s = runs[order[0]]
    both = train.select("id", "embedding", "label").unionByName(val.select("id", "embedding", "label"))
    final = fit_projection(both, a, modes[m], white)
    again = _coded(both, labels)
    means, variances, priors = _moments(_class_sums(again, [final], k, partitions(again))[0], np.sqrt(np.maximum(final.variance, LEAST_VARIANCE)) if white else 1.0, a, s)
    model = GaussianModel(final, labels, means, variances, priors)
    result = model.predict(test).join(test.select("id", F.col("label").cast("string").alias("actual")), "id").groupBy("actual", "predicted").count().collect()
    tested = np.zeros((k, k))
    for r in result:
        if r.actual in labels:
            tested[labels.index(r.actual), labels.index(r.predicted)] += r["count"]
    return [grid[i] for i in order], model, tested
