"""The column functions on streams of posts; statistics by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cleaned(posts: DataFrame) -> DataFrame:
    """Each post (text, ...) with its cleaned text and tokens, as it arrives."""
    return posts.where(F.col("text").isNotNull() & ~T.is_placeholder(F.col("text"))).withColumn("cleaned", T.clean_english(F.col("text"))).withColumn("tokens", T.english_tokens(F.col("text")))


def label_counts(posts: DataFrame, time: str = "time", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Posts by label and window of event time; later posts than ``late`` are left out."""
    return posts.withWatermark(time, late).groupBy(F.window(time, window), "label").agg(F.count("*").alias("n"))
