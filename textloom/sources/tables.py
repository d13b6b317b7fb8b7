"""Readers of posts, consultations and result tables, and writers of features and reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import find_column, require_columns
from ..operators.profiles import cleaned_english


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. If fewer tasks hold its rows than there are cores (a row group is one task), its rows are dealt out
    anew; of a table with many row groups nothing is shuffled. Finding out reads no column."""
    df, cores = spark.read.parquet(f"{folder}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.select(F.spark_partition_id().alias("p")).distinct().count() < cores else df


def read_posts(spark: SparkSession, path: str, text: str = "text", sep: str = ",", encoding: str = "UTF-8", skip_bad: bool = False) -> DataFrame:
    """A CSV with a header; blanks around column names go, and so does Unique_ID. Quoted texts may span lines."""
    df = spark.read.options(header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', mode="DROPMALFORMED" if skip_bad else "PERMISSIVE").csv(path)
    df = df.toDF(*[c.strip().lstrip("﻿") for c in df.columns]).drop("Unique_ID")
    return require_columns(df, text)


def read_cleaned(spark: SparkSession, path: str, text: str = "text", cleaner=cleaned_english, **options) -> DataFrame:
    """A CSV of posts, cleaned: ``cleaner`` takes the frame and the name of its text column. None leaves posts as they are."""
    df = read_posts(spark, path, text, **options)
    return cleaner(df, text) if cleaner else df


def read_french(spark: SparkSession, path: str) -> DataFrame:
    df = read_posts(spark, path)
    return df.where(F.lower(F.trim("language")) == "french").dropDuplicates(["text"])


def modelling_rows(df: DataFrame, text: str, label: str, kept=None) -> DataFrame:
    """record_id, text and label, blanks trimmed, empty texts and other classes left out."""
    t, y = find_column(df, text), find_column(df, label)
    out = df.select(F.trim(F.coalesce(F.col(t), F.lit(""))).alias("text"), F.trim(F.coalesce(F.col(y), F.lit(""))).alias("label")).where("text <> ''")
    out = out.where(F.col("label").isin(*kept)) if kept else out
    return out.withColumn("record_id", F.xxhash64("text", "label")) if "record_id" not in df.columns else out


def read_results(spark: SparkSession, path: str, metrics=("train_accuracy", "train_macro_f1", "test_accuracy", "test_macro_f1"), needed: str = "test_macro_f1") -> DataFrame:
    """A table of scores: strings trimmed, metrics as numbers (- is null), rows without the needed one left out."""
    df = read_posts(spark, path, text=needed)
    return df.select(*[F.try_to_number(F.trim(c), F.lit("9.9999999")).cast("double").alias(c) if c in metrics else F.trim(c).alias(c) for c in df.columns]).where(F.col(needed).isNotNull())


def write_features(df: DataFrame, path: str, csv: str | None = None) -> None:
    """Parquet; and as CSV, arrays as JSON and without tokens."""
    df.write.mode("overwrite").parquet(path)
    if csv:
        df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if c != "tokens"]).write.mode("overwrite").option("header", True).csv(csv)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """record_id from 1 in the order of key: counts by range partition, so no task holds all rows.

    The ranges are sampled, so the rows' partitions are settled once and kept (in the checkpoint folder if there is one, else
    on the executors' disks): counts and numbers then come from the same ranges.
    """
    parts = df.repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    parts = parts.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else parts.persist(StorageLevel.DISK_ONLY)
    parts = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    return parts.join(F.broadcast(before), "_p").withColumn("record_id", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")
