"""Mixing sources to target weights: exact block quotas dealt to output shards by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import NON_WS_RE, checked_broadcast, fresh, materialize, small_batches, text_bytes

#: Weights of the sources in code point order, null last, repeating; the share of all words that the mix holds; and the
#: most times that a source's words are taken.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
#: Words of a block, output shards, and the seed of all draws.
BLOCK_WORDS = 100_000
#: Blocks of a source at most: beyond that its blocks get larger, so that ordering them stays a small task.
MOST_BLOCKS = 65_536
#: Sources of one splitting tree; more sources have several.
TREE_SOURCES = 10_000
#: Text bytes of one part of a shard that is shuffled in memory.
PART_BYTES = 64 << 20
SHARDS = 8
SEED = 11


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with target: the budget shared by weight, none above ``most`` times its size.

    What is above is reshared by weight until none is: the level at which sum(min(cap, level * weight)) is the budget, found
    by sorting the sources by cap / weight. The table has a row a source, not a row a document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("at", (F.row_number().over(order) - 1) % len(weights))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("at") + 1)).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("budget", budget * F.sum("source_size").over(everything))
    below = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))))
    # With the first k capped, the level rises with k as long as source k is above it, and falls from then on.
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _split(quotas: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """The blocks of each source that one output shard gets: its path through the splitting tree.

    At each node the node's blocks are split between the left and right half of its shards, the left half's by a
    multivariate-hypergeometric draw without replacement. The node's own seed makes all shards agree on it.
    """
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(quotas.sum())
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quotas, total * (middle - low) // (high - low), method="marginals")
        quotas, low, high = (left, low, middle) if shard < middle else (quotas - left, middle, high)
    return quotas


def dealt_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (source_no, quota) dealt to shards: (source_no, shard, first, count), disjoint ranges that cover each quota."""
    tree = F.floor(F.col("source_no") / TREE_SOURCES).alias("tree")
    roots = quotas.groupBy(tree).agg(F.sort_array(F.collect_list(F.struct("source_no", "quota"))).alias("quotas"))
    leaves = roots.select("tree", "quotas", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def split(batches):
        for batch in batches:
            for tree, shard, quotas in zip(*(batch.column(c).to_pylist() for c in ("tree", "shard", "quotas"))):
                got = _split(np.array([q["quota"] for q in quotas or []], dtype=np.int64), shards, shard, seed + tree)
                yield pa.RecordBatch.from_arrays([pa.array([q["source_no"] for q in quotas or []], pa.int64()), pa.array([shard] * len(got), pa.int64()), pa.array(got, pa.int64())], names=["source_no", "shard", "count"])

    dealt = leaves.mapInArrow(split, "source_no long, shard long, count long")
    return dealt.withColumn("first", F.sum("count").over(Window.partitionBy("source_no").orderBy("shard")) - F.col("count"))


def mixture(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, shards), one row a document: how often the mix takes it, and where to.

    A seeded hash permutes each source's documents into blocks of about ``block_words`` words. A source draws whole
    permutations of its blocks and of one more permutation the first blocks whose words fit its target; of the block at
    the border it takes the documents that still fit, in hashed order. The number of block draws is its quota; the
    splitting tree deals the quotas to the output shards as disjoint ranges, and a document follows its blocks. Documents
    stay whole, so a source ends within one small document of its target if it has one that small.

    Only ids and sizes move; the hot source is spread over its blocks. Tables with a row a source or a block are broadcast
    when they are small by count, else joined by a shuffle. Sources are ordered in one task, as a table of one short row each,
    and so are the blocks of a source, of which there are at most MOST_BLOCKS. Draws depend on doc_id and seed alone, so
    reruns agree. A very long text stays whole, and is left out at the border if it does not fit.

    A null or blank text has size 0 and is taken as its block is; a null source is a source, the last; a source without
    words has target 0. Rows that repeat a doc_id share a block; those with one size too share their copies. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    sized = materialize(docs.select("doc_id", "source", F.regexp_count("text", F.lit(NON_WS_RE)).cast("long").alias("size")).fillna(0, ["size"]), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(totals, weights, budget, most).withColumn("source_no", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long"))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / block_words))).cast("long"))
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long"))
    sources = materialize(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    small = checked_broadcast(sources)
    placed = sized.join(small.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("n_blocks"))).withColumn("turn", F.xxhash64(F.lit(seed + 1), "doc_id"))
    placed = materialize(placed, "placed")
    blocks = placed.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("n_blocks").alias("n_blocks"))
    # Draw numbers: permutation e has draws e * n_blocks ...; the last, partial one ends with the border block.
    order = Window.partitionBy("source_no").orderBy(F.xxhash64(F.lit(seed + 2), "source_no", "block"), "block")
    blocks = blocks.withColumn("upto", F.sum("words").over(order)).withColumn("at", F.row_number().over(order) - 1).withColumn("n_blocks", F.count("*").over(Window.partitionBy("source_no")))
    full = F.col("upto") <= F.col("rest")
    border = ~full & (F.col("upto") - F.col("words") < F.col("rest"))
    blocks = blocks.select("source_no", "block", "at", "n_blocks", "whole", F.when(full, 1).when(border, 2).otherwise(0).alias("part"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    blocks = materialize(blocks, "blocks")
    quotas = blocks.groupBy("source_no").agg((F.first("whole") * F.first("n_blocks") + F.sum((F.col("part") > 0).cast("long"))).alias("quota"))
    dealt = dealt_blocks(quotas, shards, seed)
    ranges = dealt.groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct("first", "shard"))).alias("ranges"))
    draws = blocks.join(ranges, "source_no").withColumn("draws", F.transform(F.sequence(F.lit(0), F.col("whole").cast("int")), lambda e: e * F.col("n_blocks") + F.col("at")))
    draws = draws.withColumn("shards", F.transform("draws", lambda q: F.element_at(F.filter("ranges", lambda r: r["first"] <= q), -1)["shard"])).drop("ranges", "draws", "n_blocks", "at", "whole")

    def fits(table: pa.Table) -> pa.Table:
        """Of a border block, the documents that fit what is left of the target, in hashed order."""
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("turn", "size", "doc_id", "left", "same"))), key=lambda r: (r[0], r[1], r[2] is None, r[2]))
        taken, left = [], rows[0][3]
        for _, size, doc, _, same in rows:
            if size * same <= left:
                left -= size * same
                taken.append((doc, size))
        return pa.table({"doc_id": pa.array([t[0] for t in taken], pa.int64()), "size": pa.array([t[1] for t in taken], pa.int64())})

    draws = checked_broadcast(materialize(draws, "draws"))
    drawn = placed.join(draws, ["source_no", "block"])
    at_border = drawn.where("part = 2").groupBy("source_no", "block", "turn", "doc_id", "size", "left").agg(F.count("*").alias("same"))
    chosen = at_border.groupBy("source_no", "block").applyInArrow(fits, "doc_id long, size long").distinct().withColumn("chosen", F.lit(1))
    chosen = checked_broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "chosen"))
    drawn = drawn.join(chosen, (F.col("part") == 2) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")), "left")
    copies = F.col("whole") + F.when(F.col("part") == 1, 1).otherwise(F.coalesce("chosen", F.lit(0)))
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), F.slice("shards", F.lit(1), copies.cast("int")).alias("shards"))


def _repeated(docs: DataFrame, copy: str, shard: str, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the number of the copy and its shard."""
    key, size, shards = fresh(docs, "key"), fresh(docs, "size"), fresh(docs, "shards")
    plan = mixture(docs, **options).where("copies > 0").select(F.col("doc_id").alias(key), F.col("size").alias(size), F.col("shards").alias(shards)).dropDuplicates([key, size])
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.coalesce(F.regexp_count("text", F.lit(NON_WS_RE)), F.lit(0)) == F.col(size))
    return docs.join(checked_broadcast(plan), same).select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode(shards).alias(copy, shard))


def _shuffled(out: DataFrame, shard: str, turn: str, parts: int) -> DataFrame:
    """Rows in parts of memory size, each a range of turns of one shard, sorted by turn: read in order, a shard is shuffled."""
    part = F.shiftright(turn, 40) + (1 << 23)
    part = F.floor(part * parts / (1 << 24))
    return out.repartitionById(parts * SHARDS, (F.col(shard) % SHARDS * parts + part).cast("int")).sortWithinPartitions(shard, turn)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: rows of docs, with shard, copy and a seeded order in the shard (turn), which replace columns of these names.
    Sort a shard by turn to read it shuffled."""
    return _repeated(docs.drop("copy", "shard", "turn"), "copy", "shard", **options).withColumn("turn", F.xxhash64(F.lit(SEED + 3), "doc_id", "copy"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix with the columns of docs alone, dealt to its shards and shuffled in each: the rows of a part stand in their order."""
    copy, shard, turn = fresh(docs, "copy"), fresh(docs, "shard"), fresh(docs, "turn")
    out = _repeated(docs, copy, shard, **options).withColumn(turn, F.xxhash64(F.lit(SEED + 3), "doc_id", copy))
    return _shuffled(out, shard, turn, _parts(docs)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _parts(docs: DataFrame) -> int:
    """Parts of a shard, for a mix of BUDGET times the words."""
    return max(1, -(-int(text_bytes(docs) * BUDGET) // (SHARDS * PART_BYTES)))


def write_mixture(docs: DataFrame, path: str, **options) -> None:
    out = mixed(docs, **options)
    _shuffled(out, "shard", "turn", _parts(docs)).write.partitionBy("shard").parquet(path)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))
