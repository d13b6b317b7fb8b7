"""Feature stores: tables bucketed by key, kept with their schema and row count, and joined by key or by position."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.partial import settled


class CacheMismatch(ValueError):
    """What is in a folder is not what was put there, or tables that should have the same rows don't."""


def resolved(spark: SparkSession, candidates: list[str], needed: str = "_manifest") -> str:
    """The first of ``candidates`` that holds ``needed``, by the file system that Spark reaches it through."""
    for folder in candidates:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{needed}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return folder
    raise FileNotFoundError(f"no {needed} in {', '.join(candidates)}")


def write_cache(df: DataFrame, folder: str, key: str, buckets: int = 64) -> None:
    """df in ``buckets`` files by a hash of key, each sorted by it, and beside them a manifest of schema, key, buckets and rows.

    Tables of one key and one number of buckets join without a shuffle once ``read_cache`` has named them.
    """
    if df.where(F.col(key).isNull()).limit(1).count():
        raise CacheMismatch(f"a row without {key}")
    spark, name = df.sparkSession, f"cache_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{folder.rstrip('/')}/rows").saveAsTable(name)
    n = spark.table(name).count()
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    manifest = json.dumps({"key": key, "buckets": buckets, "rows": n, "schema": df.schema.json()})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{folder.rstrip('/')}/_manifest")


def read_cache(spark: SparkSession, folder: str, key: str | None = None) -> DataFrame:
    """The table in ``folder`` with its buckets known to the planner. Raises if rows or key are not those of the manifest; the
    count reads no column."""
    kept = json.loads(spark.read.text(f"{folder.rstrip('/')}/_manifest").first()[0])
    schema = StructType.fromJson(json.loads(kept["schema"]))
    if key not in (None, kept["key"]):
        raise CacheMismatch(f"{folder} is kept by {kept['key']}, not {key}")
    name = "cache_" + re.sub("[^a-z0-9]", "_", folder.lower())[-80:] + uuid.uuid4().hex[:8]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{kept['key']}`) SORTED BY (`{kept['key']}`) INTO {kept['buckets']} BUCKETS LOCATION '{folder.rstrip('/')}/rows'")
    df = spark.table(name)
    if (n := df.count()) != kept["rows"]:
        raise CacheMismatch(f"{folder} has {n} rows, its manifest {kept['rows']}")
    return df


def joined_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row a key with the columns of both; raises if a key is missing on one side or repeated on either.

    Of two caches with the same buckets nothing is shuffled, not even for the comparison.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("l")).join(right.groupBy(key).agg(F.count("*").alias("r")), key, "full")
    wrong = counts.fillna(0, ["l", "r"]).where("l <> 1 OR r <> 1").limit(1).collect()
    if wrong:
        raise CacheMismatch(f"{key} {wrong[0][0]} occurs {wrong[0].l} and {wrong[0].r} times")
    return left.join(right, key)


def positioned(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ``position`` from 0 in the order of ``order``, whose values are unique: ranges are settled on the shared folder,
    their sizes give where each starts, and no task holds more than a range."""
    parts = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return parts.withColumn("_at", at).join(F.broadcast(starts), "_range").withColumn("position", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def joined_by_position(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """The n-th row of left beside the n-th of right, as columns put next to each other; raises if their numbers of rows differ or
    a column has the same name in both."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise CacheMismatch(f"{', '.join(sorted(clash))} on both sides")
    n, m = left.count(), right.count()
    if n != m:
        raise CacheMismatch(f"{n} rows beside {m}")
    return positioned(left, left_order).join(positioned(right, right_order), "position")


def read_grouped(spark: SparkSession, path: str, grouped: list[str], numbers: list[str], needed: list[str], where: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """A table of scores whose ``grouped`` columns are written only on the first row of each block of rows.

    A blank cell takes the last value above it, over all files in the order of their paths. Lines are read in splits: each
    split's last values are one small row, a running fill over the splits carries them on, and inside a split a window fills
    the rest, so no task holds more than a split and one row of each split is in order in one. Then ``numbers`` become doubles
    (null if they are none), rows are kept whose columns equal ``where`` (blanks and case aside), and rows without a
    ``needed`` value go. Cells are trimmed; a line is a record, so no cell spans lines. A column that is not there raises.
    """
    df = spark.read.options(header=True).csv(path) if schema is None else spark.read.schema(schema).options(header=True).csv(path)
    place = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    columns = [c.strip().lstrip("﻿") for c in df.columns]
    rows = place.toDF(*columns, "_file", "_block").withColumn("_line", F.monotonically_increasing_id())
    missing = [c for c in (*grouped, *needed) if c not in columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns], "_file", "_block", "_line")
    # Lines of one split are read one after the other, so their numbers have the order of the lines.
    last = rows.groupBy("_file", "_block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_line"))).alias(f"_{c}") for c in grouped])
    above = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_file", "_block", *[F.last(f"_{c}", ignorenulls=True).over(above).alias(f"_{c}") for c in grouped])
    inside = Window.partitionBy("_file", "_block").orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in grouped}).join(carried, ["_file", "_block"], "left")
    out = filled.select(*[F.coalesce(c, f"_{c}").alias(c) if c in grouped else c for c in columns])
    out = out.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numbers if c in columns})
    for c, v in (where or {}).items():
        out = out.where(F.lower(c) == v.lower())
    return out.dropna(subset=needed)


def read_config(spark: SparkSession, path: str) -> dict:
    """Settings from a JSON file, or from a YAML file of plain ``name: value`` lines, by Spark's reader. Values are read as JSON
    where they are JSON, else as text."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out = {}
    for line in text.splitlines():
        name, sign, value = line.split(" #")[0].partition(":")
        if sign and name.strip() and not name.startswith((" ", "#", "-")):
            try:
                out[name.strip()] = json.loads(value.strip())
            except ValueError:
                out[name.strip()] = value.strip().strip("'\"")
    return out
