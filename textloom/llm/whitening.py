"""Embedding whitening by TSQR: exact sums centre the rows, partitions keep triangular factors, a tree merges them, and an SVD ends it."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import materialize, small_batches

#: An entry c becomes floor(SCALE * c) + SHIFT; fixed values of the contract.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Factors that one merge stacks, and rows that are stacked on a factor before it is reduced again.
FAN_IN = 8
STACK = 4096
#: Eigenvalues below this share of the largest are zero: that direction can't be whitened.
NOTHING = 1e-20


@dataclass
class Whitening:
    """What a fit gives: rows and exact sums of the fit list, eigenvalues by falling size, components as rows, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fixed_point(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the rows that can be used, entries as whole numbers.

    Rows go whose vector is null or empty or has a null, a non-finite entry or one whose number is beyond 2^53 (no double has
    it exactly). Rows that repeat a key, or have none, stay each. Vectors of another length than the longest are not
    comparable: ``fit`` and ``projected`` leave them out.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    limit = float(1 << 53)
    usable = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < limit))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & usable)
    return rows.select("key", F.transform("x", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")).alias("x"))


def matrix(column, width: int) -> np.ndarray:
    """The x-vectors of an Arrow batch as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and the sum of each dimension, exact: longs within a batch whose sums can't overflow, decimals between batches."""

    def add(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            # High and low halves: a batch is far too short for either to overflow.
            low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
            total = [Decimal((int(h) << 32) + int(v)) for h, v in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([len(x)] * width, pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["at", "n", "total"])

    got = rows.select("x").mapInArrow(add, "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    return (got[0].n, [int(r.total) for r in got]) if got else (0, [0] * width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in doubles: n * x - S is a whole number, so only the last division and the way into a double round."""
    if n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums)) < 1 << 62:
        return (x * n - np.array(sums, np.int64)) / n
    return np.array([[float(n * int(v) - s) / n for v, s in zip(row, sums)] for row in x])


def _triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _factor(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.shape[0]], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "height", "r"])


def local_factors(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(part, height, r): the triangular factor of each partition's centred rows. A task holds one factor and STACK rows."""
    width = len(sums)

    def reduce(batches):
        r, held, part = np.zeros((0, width)), [], 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                held.append(centred(matrix(batch.column("x"), width), n, sums))
            if sum(map(len, held)) >= STACK:
                r, held = _triangle(np.vstack([r, *held])), []
        if held:
            r = _triangle(np.vstack([r, *held]))
        if len(r):
            yield _factor(part, r)

    return rows.select(F.spark_partition_id().cast("long").alias("part"), "x").mapInArrow(reduce, "part long, height int, r binary")


def merged_factor(factors: DataFrame, width: int, fan_in: int = FAN_IN) -> np.ndarray:
    """The factor of all rows: ``fan_in`` factors are stacked and reduced at a time, level by level, each level written to the
    shared folder. Only the last one, width x width, reaches the driver."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["part"])
        stacked = np.vstack([np.frombuffer(row["r"]).reshape(row["height"], width) for row in rows])
        return pa.Table.from_batches([_factor(rows[0]["part"] // fan_in, _triangle(stacked))])

    level = materialize(factors, "factors")
    # Numbers of factors shrink by fan_in a level, so the last level has one group.
    while level.count() > 1:
        level = materialize(level.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(merge, level.schema), "factors")
    got = level.first()
    return np.frombuffer(got.r).reshape(got.height, width) if got else np.zeros((0, width))


def width_of(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("x"))).first()[0] or 0


def fit(rows: DataFrame) -> Whitening:
    """The whitening of all rows of ``fixed_point`` of the longest length; nothing but sums and one factor reaches the driver.

    One row, or rows that are all equal, have eigenvalues of zero; an empty table has no components.
    """
    width = width_of(rows)
    if not width:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    rows = rows.where(F.size("x") == width)
    n, sums = exact_sums(rows, width)
    r = merged_factor(local_factors(rows, n, sums), width)
    _, s, v = np.linalg.svd(r, full_matrices=True)
    values = np.zeros(width)
    values[: len(s)] = s * s / n
    sign = np.where(v[np.arange(width), np.abs(v).argmax(1)] < 0, -1.0, 1.0)
    return Whitening(n, sums, values, v * sign[:, None], float(values.sum()))


def projected(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(key, deviation, whitened): of each row the exact sum of (n * x - S)^2 and its first ``components`` whitened coordinates;
    null for a component without variance. Row by row, nothing is shuffled."""
    width, k = len(model.sums), min(components, len(model.sums))
    alive = model.values[:k] > NOTHING * max(model.values[:1], default=0.0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, model.values[:k], 1.0)), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors[:k].T * scale))

    def deviations(x, n, sums):
        top = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums))
        if top < 1 << 62:
            d = x * n - np.array(sums, np.int64)
            if int(np.abs(d).max(initial=0)) ** 2 * width < 1 << 62:
                return [int(v) for v in (d * d).sum(1)]
        return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]

    def project(batches):
        n, sums, onto = shared.value
        for batch in batches:
            x = matrix(batch.column("x"), width)
            w = (centred(x, n, sums) @ onto).tolist() if len(x) else []
            w = [[v if a else None for v, a in zip(row, alive)] for row in w]
            d = [Decimal(v) if v < 10**38 else None for v in deviations(x, n, sums)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(d, pa.decimal128(38, 0)), pa.array(w, pa.list_(pa.float64()))], names=["key", "deviation", "whitened"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.where(F.size("x") == width).mapInArrow(project, f"key {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, over components with variance:
    means first, then products of what is centred."""

    def summed(how):
        def add(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                    total = how(w) if total is None else total + how(w)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

        got = white.select("whitened").mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
        return np.array([r.v for r in got])

    mean = summed(lambda w: w.sum(0)) / n
    cov = summed(lambda w: (w - mean).T @ (w - mean)).reshape(components, components) / n
    live = ~np.isnan(np.diag(cov))
    off = np.abs(cov - np.eye(components))[np.ix_(live, live)]
    return float(off.max()) if off.size else 0.0


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), one row for each usable row and component.

    The fit list is every usable row. deviation is decimal(38,0), exact, null beyond its 38 digits; whitened is null and
    explained 0 for a component without variance (explained is null if there is none at all). Nulls and lengths are as in
    ``fixed_point``; rows that repeat a key, or have none, are projected each; other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    rows = materialize(fixed_point(vectors, key, vector), "fixed_point")
    model = fit(rows)
    k = min(components, len(model.sums))
    white = materialize(projected(rows, model, k), "whitened")
    error = identity_error(white, model.n, k) if model.n and k else 0.0
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values[:k]]) if k else F.array().cast("array<double>")
    return white.select(F.col("key").alias(key), "deviation", F.posexplode("whitened").alias("at", "w")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.try_element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long; null if it does not fit one."""
    return whitened(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
