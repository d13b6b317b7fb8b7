"""Classifiers of dense vectors by Spark's own estimators, and principal axes by sums of products; frames are (id, embedding, label)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partial import matrix, partitions, tree_sum

#: What is done to vectors before their axes are found, and the least norm, deviation and variance that something is divided by.
MODES = ("centered", "standardized", "l2_normalized")
LEAST_NORM, LEAST_SPREAD, LEAST_VARIANCE = 1e-12, 1e-8, 1e-8


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def _classified(estimator, train: DataFrame, rows: DataFrame) -> DataFrame:
    codes = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc").fit(train)
    model = estimator.setLabelCol("code").fit(_vectors(codes.transform(train)))
    names = F.array(*[F.lit(x) for x in codes.labelsArray[0]])
    return model.transform(_vectors(rows.select("id", "embedding"))).select("id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def logistic(train: DataFrame, rows: DataFrame, c: float = 1.0, l1_ratio: float = 0.0) -> DataFrame:
    """(id, predicted) by multinomial logistic regression; c is the inverse strength of the penalty summed over all rows."""
    return _classified(LogisticRegression(regParam=1 / (c * max(1, train.count())), elasticNetParam=l1_ratio, standardization=False), train, rows)


@dataclass(frozen=True)
class Projection:
    """Principal axes of dense vectors: what a fit on one split learned, to be used on others."""

    mode: str
    whiten: bool
    center: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    n: int

    def project(self, rows: DataFrame) -> DataFrame:
        """(id, projected) of rows (id, embedding); rows without a vector are left out. Nothing is shuffled."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def onto(batches):
            own = shared.value
            spread = np.sqrt(np.maximum(own.variance, LEAST_VARIANCE)) if own.whiten else 1.0
            for batch in batches:
                p = ((prepared(matrix(batch.column("embedding")), own.mode) - own.center) / own.scale @ own.axes.T / spread).tolist() if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.list_(pa.float64()))], names=["id", "projected"])

        kind = rows.schema["id"].dataType.simpleString()
        return rows.where(F.size("embedding") > 0).select("id", "embedding").mapInArrow(onto, f"id {kind}, projected array<double>")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        row = (self.mode, self.whiten, self.n, *[[float(v) for v in a.ravel()] for a in (self.center, self.scale, self.axes, self.variance)])
        spark.createDataFrame([row], "mode string, whiten boolean, n long, center array<double>, scale array<double>, axes array<double>, variance array<double>").write.mode(mode).parquet(path)


def load_projection(spark: SparkSession, path: str) -> Projection:
    r = spark.read.parquet(path).first()
    return Projection(r.mode, r.whiten, np.array(r.center), np.array(r.scale), np.array(r.axes).reshape(len(r.variance), -1), np.array(r.variance), r.n)


def prepared(x: np.ndarray, mode: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), LEAST_NORM) if mode == "l2_normalized" else x


def fit_projection(train: DataFrame, k: int, mode: str = "centered", whiten: bool = False) -> Projection:
    """The ``k`` axes of most variance of train (id, embedding): centred; centred and divided by the deviation; or brought to
    length 1 and then centred.

    Two passes add up means, then products of what is centred, in blocks of fixed size; vectors never move. Variances have the
    divisor n - 1; an axis points to where its largest entry is positive.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode}")
    rows = train.where(F.size("embedding") > 0).select("embedding")
    parts = partitions(rows)
    sums = tree_sum(rows, lambda b: np.vstack([(x := prepared(matrix(b.column("embedding")), mode)).sum(0), np.full(x.shape[1], len(x))]), parts)
    if sums is None:
        raise ValueError("no vectors to learn from")
    n = int(sums[1, 0])
    center = sums[0] / n
    width = len(center)
    if k > min(n, width):
        raise ValueError(f"{k} axes of {n} vectors of {width} entries")
    centred = lambda b: prepared(matrix(b.column("embedding")), mode) - center
    products = tree_sum(rows, lambda b: (x := centred(b)).T @ x, parts)
    scale = np.maximum(np.sqrt(np.diag(products) / n), LEAST_SPREAD) if mode == "standardized" else np.ones(width)
    values, vectors = np.linalg.eigh(products / np.outer(scale, scale))
    axes = vectors[:, ::-1].T[:k]
    axes = axes * np.where(axes[np.arange(k), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Projection(mode, whiten, center, scale, axes, np.maximum(values[::-1][:k], 0) / max(n - 1, 1), n)


def pca(train: DataFrame, rows: DataFrame, k: int, standardize: bool = False) -> DataFrame:
    """(id, projected): rows centred by train (and scaled, if asked) on the k directions of most variance."""
    return fit_projection(train, k, "standardized" if standardize else "centered").project(rows)
