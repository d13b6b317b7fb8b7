"""Support vector machines on dense vectors: kernel features by random Fourier waves, one-vs-rest squared hinge, folds and grid in one run."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .partial import matrix, partitions, settled, tree_sum

#: Waves that stand for the radial kernel (its error falls with their root), folds, passes, and the gradient at which to stop.
WAVES, FOLDS, PASSES, CLOSE = 512, 5, 40, 1e-3
#: Pairs of steps that the optimizer remembers.
MEMORY = 8


def waves(width: int, gamma: float, n: int = WAVES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases such that products of ``mapped`` vectors come near exp(-gamma * distance^2)."""
    g = np.random.default_rng(seed)
    return g.normal(scale=np.sqrt(2 * gamma), size=(width, n)), g.uniform(0, 2 * np.pi, n)


def mapped(x: np.ndarray, directions: np.ndarray | None, phases: np.ndarray | None) -> np.ndarray:
    """Kernel features of the rows of x (x itself for the linear kernel) and a column of ones."""
    z = x if directions is None else np.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)
    return np.hstack([z, np.ones((len(x), 1))])


def minimized(evaluate, shape: tuple[int, int], passes: int = PASSES, close: float = CLOSE) -> np.ndarray:
    """The columns of a matrix that minimize a sum of one smooth convex function of each column.

    ``evaluate`` gives all values and gradients in one pass over the rows. Each column has its own quasi-Newton memory and
    step, halved until its value falls enough; a column whose gradient is ``close`` to zero stands still.
    """
    w = np.zeros(shape)
    f, g = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    used, least = 1, close * np.maximum(1.0, np.linalg.norm(g, axis=0))
    while used < passes and (np.linalg.norm(g, axis=0) > least).any():
        q, back = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s * q).sum(0)
            q -= a * y
            back.append(a)
        if steps:
            s, y, rho = steps[-1]
            q *= np.where(rho > 0, (s * y).sum(0) / np.maximum((y * y).sum(0), 1e-300), 1.0)
        else:
            q /= np.maximum(1.0, np.linalg.norm(g, axis=0))
        for (s, y, rho), a in zip(steps, reversed(back)):
            q += (a - rho * (y * q).sum(0)) * s
        d = np.where(((q * g).sum(0) > 0) & (np.linalg.norm(g, axis=0) > least), -q, -g * (np.linalg.norm(g, axis=0) > least) / np.maximum(1.0, np.linalg.norm(g, axis=0)))
        slope, step = (g * d).sum(0), np.ones(shape[1])
        while True:
            f2, g2 = evaluate(w + step * d)
            used += 1
            good = f2 <= f + 1e-4 * step * slope + 1e-12 * np.abs(f)
            if good.all() or used >= passes:
                break
            step = np.where(good, step, step / 2)
        move = np.where(good, step, 0.0) * d
        s, y = move, np.where(good, g2 - g, 0.0)
        product = (s * y).sum(0)
        steps = [*steps[-MEMORY + 1 :], (s, y, np.where(product > 1e-12, 1 / np.where(product > 1e-12, product, 1.0), 0.0))]
        w, f, g = w + move, np.where(good, f2, f), np.where(good, g2, g)
    return w


@dataclass(frozen=True)
class KernelSvm:
    """What was learned: labels in order, a column of weights for each, and the waves of the kernel (none if it is linear).

    ``grid`` has a row for each C: mean and deviation of macro F1 over the folds, and rank.
    """

    labels: list
    weights: np.ndarray
    directions: np.ndarray | None
    phases: np.ndarray | None
    gamma: float
    c: float
    grid: list[dict]

    def decisions(self, rows: DataFrame) -> DataFrame:
        """(id, decisions): one number for each label in order; null vectors have none."""
        shared = rows.sparkSession.sparkContext.broadcast((self.weights, self.directions, self.phases))

        def decide(batches):
            weights, directions, phases = shared.value
            for batch in batches:
                d = mapped(matrix(batch.column("embedding")), directions, phases) @ weights if batch.num_rows else np.zeros((0, weights.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d.tolist(), pa.list_(pa.float64()))], names=["id", "decisions"])

        kind = rows.schema["id"].dataType.simpleString()
        return rows.where(F.size("embedding") > 0).select("id", "embedding").mapInArrow(decide, f"id {kind}, decisions array<double>")

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, predicted): the label with the largest decision, the first of equals."""
        names = F.array(*[F.lit(x) for x in self.labels])
        best = F.array_position("decisions", F.array_max("decisions")).cast("int")
        return self.decisions(rows).select("id", F.element_at(names, best).alias("predicted"))

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        """One row of plain columns in one folder."""
        kept = {"labels": self.labels, "gamma": self.gamma, "c": self.c, "grid": self.grid}
        flat = lambda a: None if a is None else [float(v) for v in a.ravel()]
        row = (json.dumps(kept), len(self.weights), flat(self.weights), flat(self.directions), flat(self.phases))
        spark.createDataFrame([row], "kept string, height int, weights array<double>, directions array<double>, phases array<double>").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> KernelSvm:
    r = spark.read.parquet(path).first()
    phases = None if r.phases is None else np.array(r.phases)
    directions = None if r.directions is None else np.array(r.directions).reshape(-1, len(phases))
    return KernelSvm(weights=np.array(r.weights).reshape(r.height, -1), directions=directions, phases=phases, **json.loads(r.kept))


def scale(rows: DataFrame) -> tuple[int, float]:
    """(width, gamma): gamma is 1 / (width * variance of all entries), as kernel machines usually take it."""
    x = F.transform("x", lambda v: v.cast("double"))
    s = rows.select(F.size("x").alias("n"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("q"))
    r = s.agg(F.max("n").alias("width"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    variance = r.q / r.n - (r.s / r.n) ** 2 if r.n else 0.0
    return r.width or 0, 1 / (r.width * variance) if variance > 0 else 1.0


def fit(train: DataFrame, cs=(1.0,), kernel: str = "rbf", gamma: float | None = None, n_waves: int = WAVES, folds: int = FOLDS, seed: int = 42, passes: int = PASSES) -> KernelSvm:
    """Learns from train (id, embedding, label): for each C of ``cs`` one machine on all rows and one without each fold, all at once.

    Minimizes |w|^2 / 2 + C * sum of squared hinges for each label against the rest. The fold of a row is a hash of its id. The
    C with the best mean macro F1 over the folds is kept, the smaller of equals; its machine on all rows is there already.
    Every pass reads the rows once and adds up gradients of fixed size in a tree; rows never move. Rows without a label or with
    an empty vector are left out; vectors have one length.
    """
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel is rbf or linear, not {kernel}")
    known = train.where(F.col("label").isNotNull() & (F.size("embedding") > 0))
    labels = [r.label for r in known.select("label").distinct().orderBy("label").collect()]
    codes = F.create_map(*[F.lit(v) for pair in ((x, i) for i, x in enumerate(labels)) for v in pair]) if labels else F.lit(None)
    fold = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)).cast("int") if folds > 1 else F.lit(-1)
    rows = settled(known.select(codes[F.col("label")].alias("code"), fold.alias("fold"), F.col("embedding").alias("x")), "svm")
    width, usual = scale(rows)
    gamma = usual if gamma is None else gamma
    directions, phases = waves(width, gamma, n_waves, seed) if kernel == "rbf" else (None, None)
    height = (n_waves if kernel == "rbf" else width) + 1
    # Columns: for each C, without each fold and then on all rows, one for each label.
    held = [*range(folds), -2] if folds > 1 else [-2]
    settings = [(c, h) for c in cs for h in held]
    k, parts = len(labels), partitions(rows)
    of_fold, of_c = np.repeat([h for _, h in settings], k), np.repeat([c for c, _ in settings], k)
    spark = rows.sparkSession
    shape = (height, len(settings) * k)
    fixed = spark.sparkContext.broadcast((directions, phases))

    def evaluate(w):
        sent = spark.sparkContext.broadcast(w)

        def block(batch):
            z = mapped(matrix(batch.column("x")), *fixed.value)
            code, fold = (batch.column(c).to_numpy() for c in ("code", "fold"))
            sign = np.where(code[:, None] == np.tile(np.arange(k), len(settings)), 1.0, -1.0)
            slack = np.maximum(0.0, 1 - sign * (z @ sent.value)) * (fold[:, None] != of_fold)
            return np.vstack([(slack * slack).sum(0) * of_c, -2 * of_c * (z.T @ (sign * slack))])

        total = tree_sum(rows, block, parts)
        sent.destroy()
        return total[0] + (w * w).sum(0) / 2, total[1:] + w

    w = minimized(evaluate, shape, passes) if k else np.zeros(shape)
    chosen = spark.sparkContext.broadcast(w)

    def confusions(batch):
        z = mapped(matrix(batch.column("x")), *fixed.value) @ chosen.value
        code, fold = (batch.column(c).to_numpy() for c in ("code", "fold"))
        out = np.zeros((len(settings), k, k))
        for i, (_, h) in enumerate(settings):
            mine = fold == h if h >= 0 else np.ones(len(code), bool)
            np.add.at(out[i], (code[mine], z[mine, i * k : (i + 1) * k].argmax(1)), 1)
        return out

    counts = tree_sum(rows, confusions, parts) if k else np.zeros((len(settings), 0, 0))
    grid = []
    for c in cs:
        scores = [macro_f1(counts[i]) for i, s in enumerate(settings) if s[0] == c and (s[1] >= 0 or folds <= 1)]
        grid.append({"c": float(c), "mean_macro_f1": float(np.mean(scores)), "std_macro_f1": float(np.std(scores))})
    order = sorted(grid, key=lambda r: (-round(r["mean_macro_f1"], 9), r["c"]))
    for place, r in enumerate(order, 1):
        r["rank"] = place
    at = settings.index((next(c for c in cs if float(c) == order[0]["c"]), -2))
    return KernelSvm(labels, w[:, at * k : (at + 1) * k], directions, phases, float(gamma), order[0]["c"], order)


def macro_f1(counts: np.ndarray) -> float:
    """Of a table of (actual, predicted) counts; a label that occurs on neither side is left out."""
    both = counts.sum(0) + counts.sum(1)
    return float(np.mean(2 * np.diag(counts)[both > 0] / both[both > 0])) if (both > 0).any() else 0.0
