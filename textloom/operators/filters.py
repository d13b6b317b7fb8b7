"""Row filters and dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def find_column(df: DataFrame, *names: str) -> str:
    """The first of names that df has, letter case aside."""
    have = {c.strip().lower(): c for c in df.columns}
    return next(have[n.lower()] for n in names if n.lower() in have)


def drop_missing(df: DataFrame, column: str = "text") -> DataFrame:
    return require_columns(df, column).dropna(subset=[column])


def drop_placeholders(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~T.is_placeholder(F.col(column)))


def drop_invalid(df: DataFrame, column: str) -> DataFrame:
    return df.where(T.is_valid(F.col(column)))


def _digest(column: str):
    """What stands for a value when values are compared: long texts are no shuffle keys. Null is a value of its own."""
    return F.coalesce(F.sha2(F.col(column).cast("string"), 256), F.lit("null"))


def first_of_each(df: DataFrame, by: str, order: str) -> DataFrame:
    """One row a value of ``by``, the first in ``order``: by partial aggregation, so copies never meet in one task. Values are
    equal if their SHA-256 is, nulls too."""
    keyed = df.withColumn("_d", _digest(by))
    return keyed.join(keyed.groupBy("_d").agg(F.min(order).alias(order)), ["_d", order], "left_semi").drop("_d")


def large_classes(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of classes of at least ``least`` rows; only the class counts are shuffled."""
    return df.join(df.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi")


def keyword(df: DataFrame, label: str, value: str, word: str, column: str = "text") -> DataFrame:
    return df.where((F.col(label) == value) & F.lower(column).contains(word.lower()))


def duplicate_flags(df: DataFrame, column: str, flag: str) -> DataFrame:
    """Marks every row whose value occurs more than once, by SHA-256; counts are pre-aggregated and only values that repeat are
    joined. A null is not marked."""
    keyed = df.withColumn("_d", F.sha2(F.col(column).cast("string"), 256))
    counts = keyed.where("_d IS NOT NULL").groupBy("_d").count().where("count > 1").select("_d", F.lit(True).alias(flag))
    return keyed.join(counts, "_d", "left").drop("_d").fillna(False, [flag])


def row_audit(df: DataFrame, text: str, kept) -> DataFrame:
    """Rows before, after the empty go, after ``kept``: one pass."""
    full = F.col(text).isNotNull() & (F.trim(text) != "")
    return df.agg(F.count("*").alias("before_rows"), F.count_if(full).alias("after_empty"), F.count_if(full & kept).alias("after_final"))


def ranked(df: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first k rows of each group, with their rank; order must be total. The rank limit is pushed below the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)
