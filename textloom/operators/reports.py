"""Report tables: length profiles, duplicates, top symbols, and summaries of scores by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import scored

#: A symbol: neither letter, digit, underscore nor blank.
SYMBOL = r"([^\p{L}\p{N}_\s])"


def length_profile(df: DataFrame, label: str, words: Column, chars: Column) -> DataFrame:
    """(label, n, mean_words, median_words, mean_chars), rounded to 2: of each label, over texts that are not null."""
    d = df.select(label, words.alias("words"), chars.alias("chars")).where("chars is not null")
    middle = F.percentile("words", 0.5)
    return d.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg("words"), 2).alias("mean_words"), F.round(middle, 2).alias("median_words"), F.round(F.avg("chars"), 2).alias("mean_chars"))


def duplicate_report(df: DataFrame, **keys: Column) -> DataFrame:
    """(key, n, repeated, percent): rows whose key another row has too, for each named key; one pre-aggregated pass a key."""
    out = None
    for name, key in keys.items():
        counts = df.groupBy(F.xxhash64(key).alias("h"), F.sha2(key.cast("string"), 256).alias("k")).agg(F.count("*").alias("c"))
        row = counts.agg(F.lit(name).alias("key"), F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("repeated"))
        row = row.withColumn("percent", F.round(100 * F.try_divide("repeated", "n"), 2))
        out = row if out is None else out.unionByName(row)
    return out


def top_symbols(df: DataFrame, label: str, text: str, top: int = 8) -> DataFrame:
    """(label, symbol, n, per_symbol): the symbols most frequent overall, counted by label, and their share of the label's symbols."""
    seen = df.select(label, F.explode(F.regexp_extract_all(F.col(text), F.lit(SYMBOL), F.lit(1))).alias("symbol"))
    counts = seen.groupBy(label, "symbol").agg(F.count("*").alias("n"))
    best = counts.groupBy("symbol").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "symbol").limit(top)
    total = counts.groupBy(label).agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(best.select("symbol")), "symbol").join(total, label).select(label, "symbol", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def best_per_group(df: DataFrame, by: list[str], score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(score).alias("best"))


def class_description(df: DataFrame, by: str, score: str) -> DataFrame:
    """(by, n, mean, std, min, max, median), rounded to 4; the deviation of one value is 0."""
    r = lambda c: F.round(c, 4)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), r(F.avg(score)).alias("mean"), r(F.coalesce(F.stddev_samp(score), F.lit(0.0))).alias("std"), r(F.min(score)).alias("min"), r(F.max(score)).alias("max"), r(F.percentile(score, 0.5)).alias("median")
    )


def class_support(df: DataFrame, by: str, support: str) -> DataFrame:
    """(by, support): the median, rounded to a whole number, halves to even."""
    return df.groupBy(by).agg(F.bround(F.percentile(support, 0.5)).cast("long").alias("support"))


def rank_frequency(ranks: DataFrame, by: str, rank: str) -> DataFrame:
    return ranks.groupBy(by, rank).agg(F.count("*").alias("n"))


def ranked_by_mean(df: DataFrame, by: str, score: str) -> DataFrame:
    """(by, mean, place): 1 for the highest mean, ties by name. A row a class, so one task orders them."""
    means = df.groupBy(by).agg(F.round(F.avg(score), 4).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), by)))


def model_comparison(pred: DataFrame) -> DataFrame:
    """(model, train_accuracy, train_macro_f1, test_accuracy, test_macro_f1, gap, rank) of predictions (model, split, actual,
    predicted): a row a model, the best on test first; gap is how much macro F1 falls from train to test."""
    s = scored(pred, ["model", "split"])
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    wide = s.groupBy("model").agg(*[of(x, c).alias(f"{x}_{c}") for x in ("train", "test") for c in ("accuracy", "macro_f1")])
    wide = wide.withColumn("gap", F.round(F.col("train_macro_f1") - F.col("test_macro_f1"), 6))
    return wide.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("test_macro_f1"), F.desc("test_accuracy"), "model")))


def significance(*rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(test, about, statistic, n, p, significant, effect, size) of several tests' rows (test, about, statistic, n, p, effect), with
    the usual names of effects: of a rank correlation from 0.3 and 0.5, of eta squared from 0.06 and 0.14."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    size = F.abs("effect")
    low, high = F.when(F.col("test") == "kruskal_wallis", 0.06).otherwise(0.3), F.when(F.col("test") == "kruskal_wallis", 0.14).otherwise(0.5)
    named = F.when(size >= high, "large").when(size >= low, "medium").when(size.isNotNull(), "small")
    return out.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False))).withColumn("size", named)
