"""Whole chains over a frame of posts: English cleaning, the French features, the Arabic block, and averages by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from .filters import drop_invalid, drop_missing, drop_placeholders, duplicate_flags


def cleaned_english(df: DataFrame, column: str = "text") -> DataFrame:
    """df without missing, repeated and placeholder rows, with cleaned_text and tokens; rows go whose cleaned text is not valid."""
    kept = drop_placeholders(drop_missing(df, column).dropDuplicates(), column).withColumn("cleaned_text", T.clean_english(F.col(column)))
    return drop_invalid(kept, "cleaned_text").withColumn("tokens", T.english_tokens(F.col("cleaned_text")))


def french_features(df: DataFrame, column: str = "text") -> DataFrame:
    """df with what French posts are described by: lengths and marks of the cleaned text, hashtags, emojis and emoticons of the
    text as it is, and the words that are left without stopwords."""
    raw, clean = F.col(column), F.col("cleaned_text")
    tokens = T.french_tokens(clean)
    marks = {"question_count": "?", "exclamation_count": "!", "ellipsis_count": "..."}
    out = df.withColumn("cleaned_text", T.clean_french(raw)).withColumns({n: T.occurrences(clean, m) for n, m in marks.items()})
    return out.withColumns({
        "char_count": F.length(clean), "text_length": F.regexp_count(clean, F.lit(r"\S+")), "punct_count": sum((F.col(n) for n in marks), F.lit(0)), "hashtags": F.regexp_extract_all(F.lower(raw), F.lit(rf"#([{T.Letter}]+)"), F.lit(1)),
        "emoji_count": F.regexp_count(raw, F.lit(L.EMOJIS)), "emoticon_count": T.french_emoticons(raw), "emoji_count_after": F.regexp_count(clean, F.lit(L.EMOJIS)), "text_nostop": F.array_join(tokens, " "),
    })


def averages(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """Mean of each column by label, as (label, feature, mean, rank): the largest mean of a feature first, then by label."""
    means = df.groupBy(label).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns])
    long = means.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in columns])).alias("m")).select(label, "m.*")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("mean"), label)))


def arabic_block(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the block that Arabic posts are described by; a null text is empty. A column that others come from is made once."""
    raw, tokens, clean = F.coalesce(F.col(column), F.lit("")), F.col("tokens"), F.col("clean_text")
    out = df.withColumns({"structured_text": T.structured_arabic(raw), "question_pov": T.point_of_view(raw)}).withColumn("clean_text", T.normal_arabic(F.col("structured_text")))
    out = out.withColumn("tokens", T.content_arabic(T.canonical_words(T.arabic_words(clean))))
    return out.withColumns({
        "analysis_text": F.array_join(tokens, " "), "token_count_clean": F.size(tokens), "is_very_short_clean": F.size(tokens) <= 2, "bigrams": T.arabic_ngrams(tokens, 2), "trigrams": T.arabic_ngrams(tokens, 3), "word_count": F.regexp_count(raw, F.lit(r"\S+")), "char_count": F.length(raw),
        "punct_count": F.regexp_count(raw, F.lit(L.ARABIC_PUNCTUATION)), "emoji_count": F.regexp_count(raw, F.lit(L.ARABIC_EMOJIS)), "emoticon_count": F.regexp_count(raw, F.lit(L.ARABIC_EMOTICONS)),
    })


def arabic_features(df: DataFrame, column: str = "text") -> DataFrame:
    """The block, with flags that say whether another row has the same cleaned text, or the same words."""
    return duplicate_flags(duplicate_flags(arabic_block(df, column), "clean_text", "is_duplicate_clean"), "analysis_text", "is_duplicate_analysis_text")
