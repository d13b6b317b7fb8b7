"""A text classifier that outlives its query: what it learned is three tables and its settings, kept in one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import models as M
from .partial import settled


def term_lists(rows: DataFrame, analyzer: str) -> DataFrame:
    """rows (doc_id, text, ...) with tokens: the words of a text, or the text of which characters are counted."""
    if analyzer not in ("word", "char"):
        raise ValueError(f"analyzer is word or char, not {analyzer}")
    return rows.withColumn("tokens", T.words(F.col("text")) if analyzer == "word" else T.collapsed(F.lower("text")))


SEPARATORS = {"word": " ", "char": ""}


@dataclass(frozen=True)
class TextModel:
    """TF-IDF over n-grams and multinomial Naive Bayes: vocab (term, df, idf), logp (label, term, logp), priors (label, prior)."""

    vocab: DataFrame
    logp: DataFrame
    priors: DataFrame
    analyzer: str = "word"
    lo: int = 1
    hi: int = 1
    sublinear: bool = False
    features: int | None = None

    def weights(self, rows: DataFrame) -> DataFrame:
        """(doc_id, term, weight) of rows (doc_id, text), which need not be those that were learned from."""
        return _weights(rows, self.vocab, self.analyzer, self.lo, self.hi, self.sublinear, self.features)

    def scores(self, rows: DataFrame) -> DataFrame:
        """(doc_id, label, s), a row a class. A text without a known term, or none at all, has the priors alone."""
        of = M.by_term(self.logp)
        seen = self.weights(rows).join(F.broadcast(of) if self.features else of, "term").select("doc_id", "weight", F.inline("of"))
        known = seen.groupBy("doc_id", "label").agg(F.sum(F.col("weight") * F.col("logp")).alias("known"))
        grid = rows.select("doc_id").crossJoin(self.priors)
        return grid.join(known, ["doc_id", "label"], "left").select("doc_id", "label", (F.coalesce("known", F.lit(0.0)) + F.col("prior")).alias("s"))

    def predict(self, rows: DataFrame) -> DataFrame:
        """(doc_id, predicted, confidence): the class with the largest score, ties by name; doc_id is unique in rows."""
        r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("s", 9)), "label"))
        return M.posteriors(self.scores(rows), "doc_id").withColumn("r", r).where("r = 1").select("doc_id", F.col("label").alias("predicted"), F.col("p").alias("confidence"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Writes the model's tables below path, a folder that all executors reach."""
        settings = self.priors.sparkSession.createDataFrame([(self.analyzer, self.lo, self.hi, self.sublinear, self.features)], "analyzer string, lo int, hi int, sublinear boolean, features int")
        for name, table in (("vocabulary", self.vocab), ("weights", self.logp), ("priors", self.priors), ("settings", settings)):
            table.write.mode(mode).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> TextModel:
    kept = spark.read.parquet(f"{path}/settings").first()
    return TextModel(*[spark.read.parquet(f"{path}/{t}") for t in ("vocabulary", "weights", "priors")], **kept.asDict())


def fit(train: DataFrame, analyzer: str = "word", lo: int = 1, hi: int = 2, least: int = 2, most: float = 0.95, features: int | None = 10_000, sublinear: bool = True, alpha: float = 0.1) -> TextModel:
    """Learns from train (doc_id, text, label) alone: vocabulary, document frequencies, shares of the classes and priors. Each is
    written to the shared folder once, so predicting reads it."""
    labels = train.select("doc_id", "label")
    counts = M.term_counts(term_lists(train, analyzer), lo, hi, sep=SEPARATORS[analyzer])
    vocab = settled(M.vocabulary(counts, labels.agg(F.count("*").alias("n")), least, most, features), "vocabulary")
    logp, priors = M.fit_multinomial(_weights(train, vocab, analyzer, lo, hi, sublinear, features, ("label",)), labels, (alpha,))
    return TextModel(vocab, settled(logp.drop("alpha"), "weights"), settled(priors, "priors"), analyzer, lo, hi, sublinear, features)


def _weights(rows: DataFrame, vocab: DataFrame, analyzer: str, lo: int, hi: int, sublinear: bool, features: int | None, also: tuple[str, ...] = ()) -> DataFrame:
    """A vocabulary with a limit goes to where the texts are; one without is joined, whatever its size."""
    listed, sep = term_lists(rows, analyzer), SEPARATORS[analyzer]
    return M.weighted(listed, vocab, sublinear, lo, hi, also, sep) if features else M.tfidf(M.term_counts(listed, lo, hi, sep=sep), vocab, sublinear)


def ranked_grid(pred: DataFrame, by: str) -> DataFrame:
    """(by, macro_f1, accuracy, place) of predictions (by, actual, predicted): the best first by macro F1, then accuracy, then the smaller ``by``."""
    hit = (F.col("actual") == F.col("predicted")).cast("int")
    sides = pred.select(by, F.explode(F.array(
        F.struct(F.col("actual").alias("label"), hit.alias("tp"), F.lit(1).alias("actual")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("actual"))
    )).alias("x")).select(by, "x.*")
    f1 = sides.groupBy(by, "label").agg((2 * F.sum("tp") / F.count("*")).alias("f1"), F.sum("tp").alias("tp"), F.sum("actual").alias("n"))
    out = f1.groupBy(by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("n"), 6).alias("accuracy"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("macro_f1"), F.desc("accuracy"), by)))
