"""Helpers that several operators share: the shared folder, checked broadcasts, document groups and key buckets."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all contracts: space and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
NON_WS_RE = r"[^\x20\x09-\x0D]+"

#: Rows up to which a narrow table (ids, keys, a few numbers) is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: Text bytes of one group of documents, the unit of work of the operators that exchange packed keys.
GROUP_BYTES = 8 << 20
#: Groups that a corpus of that many eighths of a group, or more, has at least.
LEAST_GROUPS = 8
#: Partitions that groups are dealt into at most.
MOST_PARTITIONS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without that setting gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_scratch: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A folder of its own for all that is materialized inside; it goes at the end, when what was built on it is written."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield
    finally:
        _scratch.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that Spark reaches it through."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here, and a lost executor costs only a read."""
    spark = df.sparkSession
    folder = _scratch[-1] if _scratch else shared_dir(spark).rstrip("/")
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, n: int) -> DataFrame:
    """df, materialized in ``n`` buckets by a hash of ``key``: what is grouped by the key meets it there, and it is never shuffled."""
    spark, name = df.sparkSession, f"{tag}_{uuid.uuid4().hex}"
    folder = _scratch[-1] if _scratch else shared_dir(spark).rstrip("/")
    df.write.bucketBy(n, key).format("parquet").option("path", f"{folder}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table has a path of its own
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by rows and, where this Spark has the setting, by bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def give_back() -> None:
    """Returns what a worker has freed to the machine: Arrow's pool, and by glibc (where there is one) the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_kept: dict = {}


def worker_cache(owner, make):
    """What a Python worker keeps from task to task for one operator. Another operator's goes first, so the memory of a
    pipeline's stages doesn't add up in workers that Spark uses again."""
    if owner not in _kept:
        _kept.clear()
        gc.collect()
        give_back()
        _kept[owner] = make()
    return _kept[owner]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, written out, with a broadcast hint if it has at most ``rows`` rows and its strings at most ``size`` bytes; else
    without, for a shuffle join that AQE can split."""
    df = materialize(df, "small")
    strings = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(sum(strings, F.lit(0))), F.lit(0)) if strings else F.lit(0)).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows inner-joined with groups (one row a key; ``size`` counts the key's rows), safe for hot keys.

    Few groups (by count) are broadcast whole. Of many, a key is hot if it has over a thousandth of all rows, so there are
    under 1,000 of them: they are joined by broadcast and never meet in one task. All others are joined by a shuffle.
    """
    groups = materialize(groups, "groups")
    n = groups.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key)
    total = groups.agg(F.sum(size)).first()[0]
    hot = groups.where(F.col(size) * 1000 > total)
    rest = groups.where(F.col(size) * 1000 <= total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def grouped_docs(docs: DataFrame, n_groups: int, *more: str) -> DataFrame:
    """(doc_id, text, g) and the columns ``more``: documents dealt into n_groups by a hash of the id, about GROUP_BYTES each whatever their source, and
    into as many partitions (at most MOST_PARTITIONS; beyond that a task works through several groups)."""
    dealt = docs.select("doc_id", "text", *more, F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).alias("g"))
    return dealt.repartition(min(n_groups, MOST_PARTITIONS), "g")


def count_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """Groups of about ``group_bytes`` of text; of a small corpus up to LEAST_GROUPS smaller ones, down to an eighth. Only bytes
    decide, so results that follow the groups are the same on any number of cores."""
    size = text_bytes(docs)
    return max(1, -(-size // group_bytes), min(LEAST_GROUPS, size * 8 // group_bytes))


def sorted_docs(table) -> tuple[np.ndarray, list]:
    """Ids and texts of an Arrow table in an order that does not depend on arrival; a null id sorts last, a null text is empty."""
    top = np.iinfo(np.int64).max
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (top if r[0] is None else r[0], r[1] or ""))
    return np.array([top if i is None else i for i, _ in rows], dtype=np.int64), [(i, t or "") for i, t in rows]


def bucket_runs(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (by the top bits) that sorted 64-bit keys fall in, and the bounds of each one's keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return bucket[first], np.append(first, len(keys))


def _nearest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest of a and all its b. Minima are pre-aggregated, and a hub's edges never meet in one task."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    return join_groups(edges, low, "a", "n").select("a", "b", F.least("a", "low").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable.

    Large-star and small-star steps, each written to the shared folder, until all edges lead from an id to its component:
    the number of rounds grows with the logarithm of the longest path, and no node, component or edge list reaches the driver.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # Done when each a has one edge and no b is an a.
        ends = e.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.where("out > 1 or out > 0 and into > 0").limit(1).count():
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_nearest(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        small = _nearest(large)
        e = materialize(small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
