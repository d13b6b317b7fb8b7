"""Models by name for each kind of features, trained and compared alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dense, fitted, models, svm
from .corpus import united
from .reports import model_comparison

#: A model is what fits it: train (id, features, label) gives a function from rows (id, features) to (id, predicted).
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def _words(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    model = fitted.fit(train.select(F.col("id").alias("doc_id"), "text", "label"))
    return lambda rows: model.predict(rows.select(F.col("id").alias("doc_id"), "text")).select(F.col("doc_id").alias("id"), "predicted")


MODELS: dict[str, dict[str, Fit]] = {
    "words": {"Multinomial NB": _words},
    "vectors": {
        "Gaussian NB": lambda train: lambda rows: models.gaussian(train, rows), "Logistic regression": lambda train: lambda rows: dense.logistic(train, rows), "SVM": lambda train: svm.fit(train, folds=0).predict,
    },
}


def make_models(kind: str, *names: str) -> dict[str, Fit]:
    """The models of a kind of features, all or those named; raises for a kind or a name that there is none of."""
    if kind not in MODELS:
        raise ValueError(f"features are {', '.join(MODELS)}, not {kind}")
    if unknown := [n for n in names if n not in MODELS[kind]]:
        raise ValueError(f"no {', '.join(unknown)} on {kind}; there are {', '.join(MODELS[kind])}")
    return {n: f for n, f in MODELS[kind].items() if not names or n in names}


def compared(kind: str, train: DataFrame, test: DataFrame, *names: str) -> DataFrame:
    """``model_comparison`` of the models: each is fitted on train and predicts train and test."""
    out = []
    for name, fit in make_models(kind, *names).items():
        predict = fit(train)
        for split, rows in (("train", train), ("test", test)):
            actual = rows.select("id", F.col("label").cast("string").alias("actual"))
            out.append(predict(rows).join(actual, "id").select(F.lit(name).alias("model"), F.lit(split).alias("split"), "actual", F.col("predicted").cast("string").alias("predicted")))
    return model_comparison(united(*out))
