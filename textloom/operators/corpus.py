"""Corpus statistics by label, over long tables of (label, term, count)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .filters import ranked
from .models import gram_counts
from .partial import settled


def share(df: DataFrame, by: str, n: str = "n") -> DataFrame:
    """df, already aggregated, with the percentage of all rows (or of the group ``by``)."""
    return df.withColumn("pct", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(*([by] if by else []))), 6))


def distribution(df: DataFrame, label: str) -> DataFrame:
    return share(df.groupBy(label).agg(F.count("*").alias("n")), "")


def described(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum of columns, long."""
    long = df.unpivot(by, list(columns), "feature", "value")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*by, "feature").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").cast("double").alias("least"), q.alias("q"), F.max("value").cast("double").alias("most")
    )
    return out.select(*by, "feature", "n", "mean", "std", "least", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)], "most")


def histogram(df: DataFrame, label: str, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value of the whole table."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(label, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def terms(tokens: DataFrame, n: int = 1, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """(keys, doc_id, term) of every n-gram of tokens."""
    return tokens.select(*keys, "doc_id", F.explode(T.ngrams(F.col("tokens"), n)).alias("term"))


def top_terms(tokens: DataFrame, n: int = 1, k: int = 10, keys: tuple[str, ...] = ("label",)) -> DataFrame:
    counts = gram_counts(tokens, n, n, keys)
    return ranked(counts, k, list(keys), F.desc("n"), "term")


def top_terms_by_df(tokens: DataFrame, n: int, k: int, least: int = 2, most: float = 0.95) -> DataFrame:
    """Top terms of each label among those in at least ``least`` and at most a share ``most`` of the label's documents."""
    sizes = tokens.groupBy("label").agg(F.count("*").alias("docs"))
    by_doc = terms(tokens, n).groupBy("label", "doc_id", "term").agg(F.count("*").alias("tf"))
    counts = by_doc.groupBy("label", "term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    return ranked(counts.join(F.broadcast(sizes), "label").where((F.col("df") >= least) & (F.col("df") <= most * F.col("docs"))).drop("docs"), k, ["label"], F.desc("n"), "term")


def vocabulary(tokens: DataFrame) -> DataFrame:
    return terms(tokens).select("label", "term").distinct()


def vocabulary_stats(tokens: DataFrame) -> DataFrame:
    """Of each label: terms, terms that all labels share, and the others."""
    v = vocabulary(tokens)
    labels = tokens.select("label").distinct().agg(F.count("*").alias("k"))
    spread = v.groupBy("term").agg(F.count("*").alias("labels"))
    out = v.join(spread, "term").crossJoin(F.broadcast(labels))
    return out.groupBy("label").agg(F.count("*").alias("total"), F.count_if(F.col("labels") == F.col("k")).alias("shared")).withColumn("own", F.col("total") - F.col("shared"))


def shared_terms(tokens: DataFrame) -> DataFrame:
    """Terms that all labels have."""
    labels = tokens.agg(F.count_distinct("label").alias("k"))
    return vocabulary(tokens).groupBy("term").agg(F.count("label").alias("c")).crossJoin(F.broadcast(labels)).where("c = k").select("term")


def exclusive_terms(tokens: DataFrame) -> DataFrame:
    """(label, term) of the terms that one label alone has."""
    return vocabulary(tokens).groupBy("term").agg(F.count("*").alias("c"), F.max("label").alias("label")).where("c = 1").select("label", "term")


def outside_counts(tokens: DataFrame) -> DataFrame:
    """(label, term, n): of each label's terms, the occurrences outside the label, where there are any."""
    counts = terms(tokens).groupBy("label", "term").agg(F.count("*").alias("c"))
    everywhere = counts.groupBy("term").agg(F.sum("c").alias("g"))
    return counts.join(everywhere, "term").where("g > c").select("label", "term", (F.col("g") - F.col("c")).alias("n"))


def top_matches(df: DataFrame, label: str, text: str, pattern: str, k: int = 10) -> DataFrame:
    """The most frequent matches of a pattern (emojis, hashtags) in each label."""
    found = df.select(label, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("found"))
    return ranked(found.groupBy(label, "found").agg(F.count("*").alias("n")), k, [label], F.desc("n"), "found")


def wide(df: DataFrame, row: str, column: str, values, agg) -> DataFrame:
    """Pivot with the columns named, so that no pass looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(agg)


def venn(tokens: DataFrame) -> DataFrame:
    """Terms that exactly each combination of labels has."""
    masks = terms(tokens).groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("label")), "+").alias("labels"))
    return masks.groupBy("labels").agg(F.count("*").alias("n"))


def presence(df: DataFrame, label: str, column: str) -> DataFrame:
    return df.groupBy(label).agg(F.round(100 * F.avg(F.when(F.col(column) > 0, 1.0).otherwise(0.0)), 6).alias("pct"))


#: Pairs of words that a task holds before it counts them.
PAIRS_AT_ONCE = 2_000_000


def _pairs(words: DataFrame) -> DataFrame:
    """(label, a, b, n) of the pairs a < b among each document's words (label, doc_id, term); pairs are made inside rows, as
    numbers, and those of rows that are read together are counted before they are words again."""

    def count(batches):
        for batch in batches:
            labels, words = batch.column("label").dictionary_encode(), pc.list_flatten(batch.column("tokens")).dictionary_encode()
            label, word, k = (*(x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (labels, words)), len(words.dictionary))
            after, held = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)), []
            total = 0

            def counted(held):
                key, n = np.unique(np.concatenate(held), return_counts=True)
                a, b = (words.dictionary.take(pa.array(x)) for x in (key // k % k, key % k))  # noqa: B023
                return pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(key // (k * k))), a, b, pa.array(n, pa.int64())], names=["label", "a", "b", "n"])  # noqa: B023

            for own, start, end in zip(label, np.append(0, after), after):
                w, first = word[start:end], 0
                while first < len(w) - 1:
                    last = min(len(w) - 1, first + max(1, PAIRS_AT_ONCE // len(w)))
                    many = len(w) - 1 - np.arange(first, last)
                    a = np.repeat(np.arange(first, last), many)
                    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + a + 1
                    held.append((own * k + w[a]) * k + w[b])
                    total, first = total + len(a), last
                    if total > PAIRS_AT_ONCE:
                        yield counted(held)
                        held, total = [], 0
            if held:
                yield counted(held)

    one = words.groupBy("label", "doc_id").agg(F.sort_array(F.collect_list("term")).alias("tokens")).where(F.size("tokens") > 1).select("label", "tokens")
    kind = words.schema["label"].dataType.simpleString()
    return one.mapInArrow(count, f"label {kind}, a string, b string, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))


def cooccurrence(tokens: DataFrame, k: int = 20, seeds: int = 40) -> DataFrame:
    """The k most frequent pairs of different words of one document, by label, exactly.

    No pair is more frequent than either word. So the pairs among each label's ``seeds`` most frequent words give a floor,
    the k-th of their counts, and only words of at least that document frequency can be in the result: rare words, which
    make nearly all pairs of a long document, are left out before any pair is made. A document's words are made different in
    its row and written once, and so are the counts of its words: four passes read them.
    """
    documents = settled(tokens.select("label", "doc_id", F.array_distinct("tokens").alias("tokens")), "words")
    words, by_docs = terms(documents), settled(gram_counts(documents, 1, 1, ("label",)).withColumnRenamed("n", "docs"), "counts")
    first = ranked(by_docs, seeds, ["label"], F.desc("docs"), "term").select("label", "term")
    floor = ranked(_pairs(words.join(F.broadcast(first), ["label", "term"])), k, ["label"], F.desc("n"), "a", "b")
    floor = floor.groupBy("label").agg(F.when(F.count("*") == k, F.min("n")).otherwise(1).alias("floor"))
    able = by_docs.join(F.broadcast(floor), "label", "left").where(F.col("docs") >= F.coalesce("floor", F.lit(1))).select("label", "term")
    return ranked(_pairs(words.join(able, ["label", "term"])), k, ["label"], F.desc("n"), "a", "b")


def crosstab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts with totals; a total is named Total."""
    total = lambda c: F.when(F.grouping(c) == 1, "Total").otherwise(F.col(c))
    return df.cube(rows, columns).agg(F.count("*").alias("n"), total(rows).alias("row"), total(columns).alias("col")).select("row", "col", "n")


def distinctive(tokens: DataFrame, k: int = 12, least: int = 5) -> DataFrame:
    """Words by the log ratio of their smoothed share in the label and outside it."""
    counts = terms(tokens).groupBy("label", "term").agg(F.count("*").alias("c"))
    everywhere = counts.groupBy("term").agg(F.sum("c").alias("g"))
    sizes = counts.groupBy("label").agg(F.sum("c").alias("cc"))
    total = counts.agg(F.sum("c").alias("gg"))
    s = counts.where(F.col("c") >= least).join(everywhere, "term").join(F.broadcast(sizes), "label").crossJoin(F.broadcast(total))
    score = F.log((F.col("c") + 1) / (F.col("cc") + 1)) - F.log((F.col("g") - F.col("c") + 1) / (F.col("gg") - F.col("cc") + 1))
    return ranked(s.select("label", "term", "c", F.round(score, 6).alias("score")), k, ["label"], F.desc("score"), F.desc("c"), "term")


def symbol_matrix(df: DataFrame, label: str, text: str, symbols: dict[str, str]) -> DataFrame:
    """Occurrences of each group of symbols for a word, by label."""
    n_words = F.sum(F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")))
    count = lambda group: F.sum(sum((T.occurrences(F.col(text), s) for s in group), F.lit(0)))
    return df.where(F.col(text).isNotNull()).groupBy(label).agg(*[F.round(count(group) / n_words, 6).alias(name) for name, group in symbols.items()])


def filled(df: DataFrame, order: str, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Forward fill of columns read as text, within each group ``by``; without groups only for small tables, which have one order."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.nullif(F.trim(c), F.lit("")), ignorenulls=True).over(w) for c in columns})


def average_ranks(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """Ranks with ties averaged."""
    o = F.desc(value) if descending else F.asc(value)
    r = F.rank().over(Window.partitionBy(*by).orderBy(o))
    return df.withColumn("rank", r + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0)


def united(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, columns by name; a column that a frame lacks is null in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def mapped(df: DataFrame, column: str, names: dict[str, str], into: str) -> DataFrame:
    """df with the name of each value in ``into``, as a literal map in the plan; a value that has none is null."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return df.withColumn(into, F.create_map(*pairs)[F.col(column)])
