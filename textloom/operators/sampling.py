"""Balanced samples and stratified splits, seeded by a hash of the key so that reruns and engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .partial import settled


def turn(key: str, seed: int):
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


#: Hexadecimal digits of a turn that name its range: a class is ranked in 16 ** RANGE_DIGITS ranges of about equal size.
RANGE_DIGITS = 3


def numbered(df: DataFrame, key: str, seed: int, *label: str) -> DataFrame:
    """df with ``at``, from 1 in the order of the seeded turns within each class of ``label``, and ``n``, the size of the class.

    Turns are hashes, so their first digits cut a class into even ranges. The ranges' counts give where each starts, and rows
    are ranked inside their range: no task holds a class, however large. A null label is a class too.
    """
    rows = _ranged(df, key, seed)
    starts = _starts(rows, *label)
    inside = F.row_number().over(Window.partitionBy(*label, "_range").orderBy("_turn", key))
    same = F.col("_range") == F.col("_r")
    for c in label:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    out = rows.withColumn("_i", inside).join(starts, same)
    return out.withColumn("at", F.col("_start") + F.col("_i")).drop("_turn", "_range", "_i", "_r", "_start", "_c", *[f"_{c}_" for c in label])


def _ranged(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_turn", turn(key, seed)).withColumn("_range", F.substring("_turn", 1, RANGE_DIGITS))


def _starts(rows: DataFrame, *label: str) -> DataFrame:
    """Where each range of a class starts, and the size n of the class; names of the columns of label get a line before and after."""
    counts, whole = rows.groupBy(*label, "_range").agg(F.count("*").alias("_c")), Window.partitionBy(*label)
    return counts.select(
        *[F.col(c).alias(f"_{c}_") for c in label], F.col("_range").alias("_r"), (F.sum("_c").over(whole.orderBy("_range")) - F.col("_c")).alias("_start"), F.sum("_c").over(whole).alias("n"), "_c"
    )


def balanced(df: DataFrame, label: str, key: str, seed: int = 42, n: int | None = None) -> DataFrame:
    """n rows of each class, or as many as the smallest class has."""
    sizes = df.groupBy(label).count()
    if n is None:
        limit = sizes.agg(F.min("count").alias("_n"))
    else:
        if sizes.where(F.col("count") < n).limit(1).count():
            raise ValueError(f"a class has fewer than {n} rows")
        limit = df.sparkSession.range(1).select(F.lit(n).alias("_n"))
    return numbered(df, key, seed, label).crossJoin(F.broadcast(limit)).where("at <= _n").drop("at", "n", "_n")


def allocation(df: DataFrame, label: str, part: str, n: int) -> DataFrame:
    """Largest remainders: n rows of each class shared by its parts in proportion, whole numbers, none above its size."""
    counts = df.groupBy(label, part).agg(F.count("*").alias("size"))
    ideal = F.col("size") * n / F.sum("size").over(Window.partitionBy(label))
    c = counts.withColumn("ideal", ideal).withColumn("floor", F.floor("ideal"))
    left = F.lit(n) - F.sum("floor").over(Window.partitionBy(label))
    order = Window.partitionBy(label).orderBy(F.desc(F.round(F.col("ideal") - F.col("floor"), 9)), part)
    return c.withColumn("left", left).withColumn("by", F.row_number().over(order)).select(label, part, "size", F.least(F.col("size"), F.col("floor") + F.when(F.col("by") <= F.col("left"), 1).otherwise(0)).cast("long").alias("sampled"))


def balanced_by_part(df: DataFrame, label: str, part: str, key: str, n: int, seed: int = 42) -> DataFrame:
    plan = allocation(df, label, part, n).select(F.col(label).alias("_l"), F.col(part).alias("_p"), "sampled")
    rows = numbered(df, key, seed, label, part).drop("n")
    return rows.join(F.broadcast(plan), F.col(label).eqNullSafe(F.col("_l")) & F.col(part).eqNullSafe(F.col("_p"))).where("at <= sampled").drop("at", "_l", "_p", "sampled")


def three_way(df: DataFrame, label: str, key: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """train, val and test of each class: halves round to even, and no part of a class of three or more is empty."""
    d = _sizes(numbered(df, key, seed, label), train, val)
    return d.withColumn("split", F.when(F.col("at") <= F.col("nt"), "train").when(F.col("at") <= F.col("nt") + F.col("nv"), "val").otherwise("test")).drop("at", "n", "nt", "nv")


def _sizes(d: DataFrame, train: float, val: float) -> DataFrame:
    """d with nt and nv, how many of the n rows of a class are train and val."""
    d = d.withColumn("nt", F.greatest(F.lit(1), F.bround(F.col("n") * train).cast("int"))).withColumn("nv", F.greatest(F.lit(1), F.bround(F.col("n") * val).cast("int")))
    return d.withColumn("nt", F.when(F.col("nt") + F.col("nv") >= F.col("n"), F.greatest(F.lit(1), F.col("n") - F.col("nv") - 1)).otherwise(F.col("nt")))


def three_way_ends(df: DataFrame, label: str, key: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(label, c, train, val), one row a class: how many of its rows ``three_way`` makes train, and turn and key of the last row of
    train and of val. Only ranges that hold such rows are ranked; of all others, rows are counted."""
    rows = _ranged(df.select(label, key), key, seed)
    last = F.array(F.col("nt").cast("long"), F.least(F.col("n"), F.col("nt") + F.col("nv")).cast("long"))  # a class of one has no val
    ends = _sizes(_starts(rows, label), train, val).select("*", F.posexplode(last).alias("_which", "_end")).where("_start < _end AND _end <= _start + _c").drop("n", "nv", "_c")
    found = rows.join(settled(ends, "ends"), (F.col("_range") == F.col("_r")) & F.col(label).eqNullSafe(F.col(f"_{label}_")))
    at = F.col("_start") + F.row_number().over(Window.partitionBy(f"_{label}_", "_which").orderBy("_turn", key))
    found = found.withColumn("_at", at).where("_at = _end").withColumn("_row", F.struct(F.col("_turn").alias("turn"), F.col(key).alias("key")))
    of = lambda which: F.max(F.when(F.col("_which") == which, F.col("_row")))
    return settled(found.groupBy(F.col(f"_{label}_").alias(label)).agg(F.max("nt").alias("c"), of(0).alias("train"), of(1).alias("val")), "ends")


def split_at(df: DataFrame, ends: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """df with ``split``, as ``three_way`` has it: a row is held against the ends of its class, so rows stay where they are read."""
    row = F.struct(turn(key, seed).alias("turn"), F.col(key).alias("key"))
    ends = ends.select(F.col(label).alias("_label"), F.col("train").alias("_train"), F.col("val").alias("_val"))
    out = df.join(ends, F.col(label).eqNullSafe(F.col("_label"))).withColumn("_row", row)
    return out.withColumn("split", F.when(F.col("_row") <= F.col("_train"), "train").when(F.col("_row") <= F.col("_val"), "val").otherwise("test")).drop("_label", "_train", "_val", "_row")


def two_way(df: DataFrame, label: str, key: str, train: float = 0.80, seed: int = 42) -> DataFrame:
    """train and test of each class; halves round to even."""
    d = numbered(df, key, seed, label)
    return d.withColumn("split", F.when(F.col("at") <= F.bround(F.col("n") * train), "train").otherwise("test")).drop("at", "n")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return numbered(df, key, seed, label).withColumn("fold", ((F.col("at") - 1) % k).cast("int")).drop("at", "n")


def encoded(df: DataFrame, label: str) -> DataFrame:
    """Labels numbered in order, from 0."""
    codes = df.select(label).distinct().where(F.col(label).isNotNull()).withColumn("code", F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(F.broadcast(codes), label)
