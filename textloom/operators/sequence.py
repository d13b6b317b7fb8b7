"""A small convolutional classifier of token sequences, trained data-parallel: each pass adds up gradients over all rows in a tree."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .partial import partitions, settled, tree_sum

#: Tokens are told apart by a hash into so many rows of the embedding; numbers of an embedding, words of a window, windows kinds.
HASHED, WIDTH, WINDOW, FILTERS = 4096, 8, 3, 24
#: Passes at most, passes without a new least validation loss after which training stops, and the size of a step.
EPOCHS, PATIENCE, RATE = 60, 6, 0.03
#: Tokens (padding included) that are computed with at a time.
CHUNK = 1 << 15


@dataclass(frozen=True)
class Shape:
    hashed: int = HASHED
    width: int = WIDTH
    window: int = WINDOW
    filters: int = FILTERS
    classes: int = 2

    def parts(self) -> list[tuple[int, ...]]:
        return [(self.hashed, self.width), (self.window * self.width, self.filters), (self.filters,), (self.filters, self.classes), (self.classes,)]

    def split(self, w: np.ndarray) -> list[np.ndarray]:
        """Views of the flat weights: embedding, windows and their offsets, output and its offsets."""
        out, at = [], 0
        for p in self.parts():
            n = int(np.prod(p))
            out.append(w[at : at + n].reshape(p))
            at += n
        return out

    def start(self, seed: int) -> np.ndarray:
        g = np.random.default_rng(seed)
        return np.concatenate([g.normal(scale=0.3 if len(p) == 2 and p[0] == self.hashed else np.sqrt(2 / p[0]) if len(p) == 2 else 0.0, size=p).ravel() for p in self.parts()])


def hashed_tokens(tokens: Column, hashed: int = HASHED) -> Column:
    """Rows of the embedding for an array of tokens; row 0 stands for no token."""
    return F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(hashed - 1)) + 1).cast("int"))


def padded(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, ids) of an Arrow column of id lists: rows of like length together, CHUNK ids or one row at a time, ends filled with 0."""
    ends = column.offsets.to_numpy()
    flat, size = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    order, out, at = np.argsort(size, kind="stable"), [], 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * max(1, size[order[at + n]]) <= CHUNK:
            n += 1
        rows = order[at : at + n]
        ids = np.zeros((n, max(1, size[rows].max())), np.int64)
        for i, r in enumerate(rows):
            ids[i, : size[r]] = flat[ends[r] : ends[r + 1]]
        out.append((rows, ids))
        at += n
    return out


def forward(shape: Shape, weights: list[np.ndarray], ids: np.ndarray):
    """Log shares of the classes, and what the way back needs: the strongest window of each kind, wherever it is in the text."""
    emb, wide, offset, top, bias = weights
    ids = np.pad(ids, ((0, 0), (0, shape.window - 1)))
    n, length = ids.shape
    steps = length - shape.window + 1
    x = emb[ids] * (ids > 0)[:, :, None]
    windows = np.concatenate([x[:, k : k + steps] for k in range(shape.window)], axis=2)
    strength = windows @ wide + offset
    # A window that begins behind the text is none, but for the first of an empty one.
    strength[np.broadcast_to(((ids[:, :steps] == 0) & (np.arange(steps) > 0))[:, :, None], strength.shape)] = -np.inf
    at = strength.argmax(1)
    best = np.take_along_axis(strength, at[:, None], 1)[:, 0]
    hidden = np.maximum(best, 0)
    logits = hidden @ top + bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True)), (ids, windows, at, best, hidden)


def gradient(shape: Shape, weights: list[np.ndarray], ids: np.ndarray, code: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of the rows and its gradient by the flat weights."""
    _, wide, _, top, _ = weights
    logs, (ids, windows, at, best, hidden) = forward(shape, weights, ids)
    rows = np.arange(len(code))
    back = np.exp(logs)
    back[rows, code] -= 1
    up = (back @ top.T) * (best > 0)
    chosen = windows[rows[:, None], at]
    d_emb = np.zeros((shape.hashed, shape.width))
    spread = (up[:, :, None] * wide.T[None]).reshape(len(code), shape.filters, shape.window, shape.width)
    for k in range(shape.window):
        np.add.at(d_emb, ids[rows[:, None], at + k], spread[:, :, k])
    d_emb[0] = 0
    parts = [d_emb, np.einsum("nfk,nf->kf", chosen, up), up.sum(0), hidden.T @ back, back.sum(0)]
    return float(-logs[rows, code].sum()), np.concatenate([p.ravel() for p in parts])


@dataclass(frozen=True)
class SequenceModel:
    """Labels in order, weights of the best pass, and the history of all passes."""

    labels: list[str]
    shape: Shape
    weights: np.ndarray
    history: list[dict]

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, predicted, confidence) of rows (id, tokens); a null or empty list of tokens is classified too."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        def classify(batches):
            own = shared.value
            weights = own.shape.split(own.weights)
            for batch in batches:
                logs = np.zeros((batch.num_rows, len(own.labels)))
                for at, ids in padded(batch.column("ids")):
                    logs[at] = forward(own.shape, weights, ids)[0]
                best = logs.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([own.labels[i] for i in best], pa.string()), pa.array(np.exp(logs.max(1, initial=-np.inf)))], names=["id", "predicted", "confidence"])

        ids = F.coalesce(hashed_tokens(F.col("tokens"), self.shape.hashed), F.array().cast("array<int>")).alias("ids")
        return rows.select("id", ids).mapInArrow(classify, f"id {rows.schema['id'].dataType.simpleString()}, predicted string, confidence double")

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        kept = json.dumps({"labels": self.labels, "shape": vars(self.shape), "history": self.history})
        spark.createDataFrame([(kept, [float(v) for v in self.weights])], "kept string, weights array<double>").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> SequenceModel:
    r = spark.read.parquet(path).first()
    kept = json.loads(r.kept)
    return SequenceModel(kept["labels"], Shape(**kept["shape"]), np.array(r.weights), kept["history"])


def fit(train: DataFrame, val: DataFrame, epochs: int = EPOCHS, patience: int = PATIENCE, rate: float = RATE, seed: int = 42, **shape) -> SequenceModel:
    """Learns from train (id, tokens, label), and stops by val: after ``patience`` passes without a new least loss; the weights of
    the best pass are kept.

    A pass reads every row once, whole texts, and adds up the gradient of train and the loss of val; between passes the
    driver takes one step of moments. What moves is of the size of the weights, so a lost executor costs its part of a pass.
    Rows without a label, and labels that train lacks, are left out.
    """
    labels = [r[0] for r in train.select(F.col("label").cast("string")).where("label IS NOT NULL").distinct().orderBy("label").collect()]
    if not labels:
        raise ValueError("no labels to learn")
    form = Shape(classes=len(labels), **shape)
    code = F.create_map(*[F.lit(v) for pair in ((x, i) for i, x in enumerate(labels)) for v in pair])[F.col("label").cast("string")]
    ids = F.coalesce(hashed_tokens(F.col("tokens"), form.hashed), F.array().cast("array<int>"))
    both = train.withColumn("held", F.lit(False)).unionByName(val.withColumn("held", F.lit(True)))
    rows = settled(both.select(code.alias("code"), ids.alias("ids"), "held").where("code IS NOT NULL"), "sequences")
    spark, parts, size = rows.sparkSession, partitions(rows), sum(int(np.prod(p)) for p in form.parts())
    w, first, second = form.start(seed), np.zeros(size), np.zeros(size)
    best, least, since, history = w, np.inf, 0, []
    for epoch in range(1, epochs + 1):
        sent = spark.sparkContext.broadcast(w)

        def block(batch):
            weights = form.split(sent.value)
            code, held = batch.column("code").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            out = np.zeros(5 + size)  # train loss, rows; val loss, rows, hits; gradient
            for at, x in padded(batch.column("ids")):
                mine = ~held[at]
                if mine.any():
                    loss, g = gradient(form, weights, x[mine], code[at][mine])
                    out[0] += loss
                    out[1] += mine.sum()
                    out[5:] += g
                if not mine.all():
                    logs, y = forward(form, weights, x[~mine])[0], code[at][~mine]
                    out[2] -= logs[np.arange(len(y)), y].sum()
                    out[3] += len(y)
                    out[4] += (logs.argmax(1) == y).sum()
            return out

        total = tree_sum(rows, block, parts)
        sent.destroy()
        loss = total[2] / total[3] if total[3] else total[0] / max(1, total[1])
        history.append({"epoch": epoch, "train_loss": float(total[0] / max(1, total[1])), "val_loss": float(loss), "val_accuracy": float(total[4] / max(1, total[3]))})
        best, least, since = (w, loss, 0) if loss < least - 1e-6 else (best, least, since + 1)
        if since >= patience:
            break
        g = total[5:] / max(1, total[1])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
    return SequenceModel(labels, form, best, history)
