"""What a run leaves behind: data sets for models, tables, summaries as text, and logs of what was found in posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import positioned

#: Columns of the data set that models read, after its record number.
MODELLING = ("raw_text", "clean_text", "analysis_text", "umbrella", "label_clean", "label_normalized")
BOM = "﻿"


def write_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "errorifexists", compression: str = "none") -> None:
    """CSV with a header in each file; arrays and maps as JSON. With ``bom`` a file begins with the mark by which spreadsheets
    know UTF-8: it stands before the first column's name."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in df.dtypes])
    out = flat.withColumnRenamed(flat.columns[0], BOM + flat.columns[0]) if bom else flat
    out.write.mode(mode).option("header", True).option("escape", '"').option("compression", compression).csv(path)


def modelling_set(df: DataFrame, key: str) -> DataFrame:
    """record_id, from 1 in the order of ``key``, and the columns of MODELLING; numbers are given before rows without words go,
    so they stay those of the whole table. A df that has record_id already keeps it: numbering long texts moves them, so it is
    best done before they are made. Raises if a column is missing."""
    missing = [c for c in MODELLING if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = df if "record_id" in df.columns else positioned(df.select(key, *MODELLING), [key]).withColumn("record_id", F.col("position") + 1)
    # Not a plain filter: the planner would push that below the columns and make the words of every text twice.
    full = F.filter(F.array(F.struct("record_id", *MODELLING)), lambda r: F.trim(F.coalesce(r["analysis_text"], F.lit(""))) != "")
    return rows.select(F.inline(full))


def class_summary(df: DataFrame, label: str = "umbrella") -> DataFrame:
    """(label, row_count, percentage), two decimals, the largest class first when written."""
    counts = df.groupBy(label).agg(F.count("*").alias("row_count"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("row_count").alias("_all")))).select(label, "row_count", F.round(100 * F.col("row_count") / F.col("_all"), 2).alias("percentage"))


def export_modelling(df: DataFrame, key: str, folder: str) -> None:
    """The data set as Parquet and as CSV (gzip, which Spark and others read as they do CSV), and its classes, each in a folder of
    its own below ``folder``."""
    folder, spark = folder.rstrip("/"), df.sparkSession
    modelling_set(df, key).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    write_csv(rows, f"{folder}/csv", bom=True, compression="gzip")
    write_csv(class_summary(rows).orderBy(F.desc("row_count"), "umbrella").coalesce(1), f"{folder}/classes", bom=True)


def write_tables(folder: str, mode: str = "errorifexists", **tables: DataFrame) -> None:
    """Each table as CSV in a folder of its name. Tables are reports: small, so each is one file."""
    for name, df in tables.items():
        write_csv(df.coalesce(1), f"{folder.rstrip('/')}/{name}", bom=True, mode=mode)


def feature_lines(df: DataFrame, label: str, *columns: str) -> DataFrame:
    """(line_no, line) of a summary: rows and labels, then count, mean, deviation and range of each column, then its mean by label.
    Two passes of aggregation; the lines are made of their few rows."""
    fixed = lambda c, d=2: F.format_string(f"%.{d}f", c)
    stats = df.agg(F.count("*").alias("_rows"), F.count_distinct(label).alias("_labels"), *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))])
    head = [F.format_string("rows: %d", "_rows"), F.format_string("labels: %d", "_labels")]
    head += [F.concat(F.lit(f"{c}: count "), F.col(f"n_{c}"), F.lit(", mean "), fixed(F.col(f"m_{c}").cast("double")), F.lit(", std "), F.coalesce(fixed(F.col(f"s_{c}").cast("double")), F.lit("-")), F.lit(", min "), fixed(F.col(f"lo_{c}").cast("double")), F.lit(", max "), fixed(F.col(f"hi_{c}").cast("double"))) for c in columns]
    first = stats.select(F.posexplode(F.array(*head)).alias("at", "line")).select(F.lit(0).alias("part"), F.lit("").alias("of"), "at", "line")
    means = df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("_of")).agg(F.count("*").alias("_rows"), *[F.avg(c).alias(c) for c in columns])
    rows = F.array(F.concat("_of", F.lit(": rows "), "_rows"), *[F.concat("_of", F.lit(f": mean {c} "), fixed(F.col(c).cast("double"))) for c in columns])
    second = means.select(F.lit(1).alias("part"), F.col("_of").alias("of"), F.posexplode(rows).alias("at", "line"))
    lines = first.unionByName(second)
    return lines.select(F.row_number().over(Window.orderBy("part", "of", "at")).alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines in order, as one text file: a summary is small."""
    lines.orderBy("line_no").select("line").coalesce(1).write.text(path)


def found_log(df: DataFrame, label: str, **lists) -> DataFrame:
    """(kind, label, found, n, posts) of what array columns hold: how often each value occurs and in how many posts."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("found")) for k, c in lists.items()])
    long = df.withColumn("_post", F.monotonically_increasing_id()).select("_post", label, F.explode(kinds).alias("k")).select("_post", label, "k.kind", F.explode("k.found").alias("found"))
    once = long.groupBy("_post", label, "kind", "found").agg(F.count("*").alias("n"))
    return once.groupBy("kind", label, "found").agg(F.sum("n").alias("n"), F.count("*").alias("posts"))
