"""Sharding by a two-pass external shuffle: a seeded hash scatters rows into memory-sized buckets, then each bucket is Fisher-Yates shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import checked_broadcast, materialize

#: Text bytes and rows of one bucket: what one task holds in memory while it shuffles.
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1024
#: Equal rows (of one doc_id and text) from which each has a number, and with it a bucket of its own.
MANY_COPIES = 64


def shard_of(key, shards: int, seed: int):
    """Rendezvous hashing: the shard with the highest seeded hash of (key, shard). One more shard takes rows only into itself."""
    return F.array_max(F.array(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))["s"]


def fisher_yates(n, seed):
    """A permutation of 0 to n - 1 as an array: from the last place down, each is swapped with one drawn, by a seeded hash, from
    those up to it. ``seed`` is a column, so a bucket's permutation depends on nothing else."""
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("a"))

    def swap(state, i):
        a, j = state["a"], F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        moved = F.concat(F.slice(a, F.lit(1), j), F.array(F.get(a, i)), F.slice(a, j + 2, i - j - 1), F.array(F.get(a, j)), F.slice(a, i + 2, n - i - 1))
        return F.struct(F.when(i == j, a).otherwise(moved).alias("a"))

    return F.when(n < 2, F.sequence(F.lit(0), F.lit(0))).otherwise(F.reduce(F.sequence(n - 1, F.lit(1), F.lit(-1)), start, swap)["a"])


def numbered_copies(rows: DataFrame, most: int = MANY_COPIES) -> DataFrame:
    """rows (row, same, ...) with ``copy``: 0, but for values of ``same`` with over ``most`` rows the number of the row among them.

    Rows of such a value are written with the partition that they lie in; a partition's rows are numbered there, and what
    the partitions before hold is added, so that equal rows never meet in one task. Which of two equal rows has which number is open.
    """
    many = rows.groupBy("same").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("same")
    if not many.limit(1).count():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    many = checked_broadcast(many)
    placed = materialize(rows.join(many, "same").withColumn("_part", F.spark_partition_id()), "copies")
    counts = placed.groupBy("same", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("same", "_part", (F.sum("_n").over(Window.partitionBy("same").orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("same", "_part").orderBy(F.lit(0)))
    dealt = placed.withColumn("_at", at).join(checked_broadcast(before), ["same", "_part"]).withColumn("copy", F.col("_before") + F.col("_at"))
    return rows.join(many, "same", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(dealt.drop("_part", "_at", "_before"))


def sharded(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of docs with shard (0 to shards - 1), bucket and slot (0, 1, ... in each shard), in shuffled order.

    Pass 1: doc_id alone decides the shard (law ``key``); a seeded hash of doc_id and text decides the bucket in it, and whole
    rows go to their bucket in one exchange. Hashes spread a hot source evenly, and the number of buckets grows with the
    text and the rows, so a bucket stays memory-sized. Pass 2: each bucket is put in a fixed order (by a hash of doc_id and
    text) and Fisher-Yates shuffled. Every draw is a hash of seed, shard, bucket and place, so neither partitions nor the
    size of the cluster change a slot. A bucket's first slot is the number of rows in the shard's earlier buckets. Where many
    rows have one doc_id and text, each has a number that goes into its hashes, so they spread over the shard's buckets.

    Null texts stay rows with a null text; rows that repeat a doc_id share its shard, and those with one text too are in any order among
    themselves; a null doc_id is one more key. A very long text makes its bucket larger. Columns
    of any name and type stay, but ``shard``, ``slot`` and ``bucket`` (in any case) are replaced. An empty table gives an
    empty result.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot", "bucket")]
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-size // (shards * bucket_bytes)), -(-rows // (shards * bucket_rows)))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", text).alias("scatter"), F.xxhash64(F.lit(seed + 2), "doc_id", text).alias("turn")
    ).withColumn("same", F.struct("scatter", "turn"))
    alone = F.col("copy") == 0
    placed = numbered_copies(rows).select(
        "row", "shard", F.pmod(F.when(alone, F.col("scatter")).otherwise(F.xxhash64("scatter", "copy")), F.lit(n)).alias("bucket"), F.when(alone, F.col("turn")).otherwise(F.xxhash64("turn", "copy")).alias("turn")
    )
    order = Window.partitionBy("shard", "bucket").orderBy("turn", "row.doc_id")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n"))
    drawn = counts.withColumn("places", fisher_yates(F.col("n").cast("int"), F.xxhash64(F.lit(seed + 3), "shard", "bucket"))).drop("n")
    dealt = placed.withColumn("at", F.row_number().over(order) - 1).join(drawn, ["shard", "bucket"])
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in own], "shard", "bucket", (F.col("first") + F.get("places", F.col("at"))).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder a shard, rows in slot order within each file."""
    out = sharded(docs, **options)
    out.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2(spark: SparkSession, sf_dir: str, shards: int = 8, seed: int = 17) -> DataFrame:
    out = sharded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), shards, seed)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        F.col("shard").cast("int"), F.col("slot").cast("long"), shard_of(F.col("doc_id"), shards + 1, seed).cast("int").alias("grown_shard"),
    )
