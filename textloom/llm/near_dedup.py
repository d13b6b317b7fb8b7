"""Near-duplicates by min-max hashing: minimum and maximum under each permutation, banded; links confirmed on full sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import GROUP_BYTES, MOST_PARTITIONS, checked_broadcast, components, give_back, join_groups, materialize, small_batches, worker_cache

#: Words of a shingle; links need 100 * intersection >= SIMILARITY * union.
SHINGLE = 5
SIMILARITY = 75
#: Permutations, each giving a minimum and a maximum, and the bands of ROWS values: at similarity 0.75 all bands miss a
#: pair with probability 3e-5, at 0.85 with less than 1e-12; at 0.15, as passages shared by chance give, they meet in 1e-4.
PERMUTATIONS = 252
ROWS = 7
BANDS = 2 * PERMUTATIONS // ROWS
#: Documents and text bytes of one block of a large group of candidates: pairs are compared block by block.
BLOCK = 768
BLOCK_BYTES = 2 << 20
SEED = 20240607
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles; of the whole sequence if it has fewer words; else empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known: dict[bytes, int] = worker_cache("shingles", dict)
    if len(known) > KNOWN_WORDS:
        known.clear()
    get, put = known.get, known.setdefault
    h = np.fromiter((get(w) or put(w, _word_hash(w)) for w in words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    x = np.full(n, min(len(h), SHINGLE), dtype=np.uint64)
    for k in range(min(len(h), SHINGLE)):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def band_keys(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Band keys of one set of shingles: each permutation is evaluated once and gives two signature values."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 256):
        y = x[i : i + 256, None] * a
        y += b
        np.minimum(low, y.min(0), out=low)
        np.maximum(high, y.max(0), out=high)
    rows = np.concatenate([low, high]).reshape(2, BANDS // 2, ROWS).reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, n_bytes, set_key, bands): set_key is a 128-bit digest of the whole set, bands its band keys."""
    small_batches(docs.sparkSession)

    def sign(batches):
        a, b = _permutations()
        for batch in batches:
            sizes, lengths, keys, bands = [], [], [], []
            for cell in batch.column("text"):
                s = shingles(t := cell.as_py())
                lengths.append(len(t or ""))
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(band_keys(s, a, b) if len(s) else np.zeros(0, np.int64))
            give_back()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "n_bytes", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, n_bytes long, set_key binary, bands array<long>")


def spanning(ids: list, sets: list[np.ndarray], half: int | None) -> list[tuple[int, int]]:
    """Links that join what the similar pairs among sets join: all pairs, or those of the first ``half`` with the rest.

    Intersections come from products of 0/1 matrices over the shingles that two or more of the sets hold.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at, owner = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[at], owner
    owner, at = owner[at >= 0], at[at >= 0]
    left, right = (slice(0, half), slice(half, None)) if half else (slice(None), slice(None))
    common = np.zeros((len(sizes[left]), len(sizes[right])), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    links = []
    for i, j in zip(*np.nonzero(100 * common >= SIMILARITY * union)):
        i, j = int(i), int(j) + (half or 0)
        if i != j and (x := find(i)) != (y := find(j)):
            root[max(x, y)] = min(x, y)
            links.append((ids[i], ids[j]))
    return links


def compared(texts: DataFrame, members: DataFrame, kind: str, tag: str) -> DataFrame:
    """Links (a, b) that join what the similar pairs of each unit join, one row a link.

    members (unit, side, id, n_bytes): pairs are those of side 0 with side 1, or, where ``kind`` is "all", those within the
    unit. Texts go to bins of about GROUP_BYTES, of whole units; a bin works through its units one by one.
    """
    size = members.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bins = max(1, -(-size // GROUP_BYTES), min(members.count() // 200, members.sparkSession.sparkContext.defaultParallelism))
    dealt = members.select("unit", "side", "id", F.pmod(F.xxhash64("unit"), F.lit(bins)).alias("bin"))

    def confirm(table: pa.Table) -> pa.Table:
        table, links = table.sort_by([("unit", "ascending"), ("side", "ascending"), ("id", "ascending")]), []
        unit = np.asarray(table.column("unit"))
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        for lo, hi in zip(first.tolist(), np.append(first[1:], len(unit)).tolist()):
            part = table.slice(lo, hi - lo)
            half = None if kind == "all" else int((np.asarray(part.column("side")) == 0).sum())
            if half is None or 0 < half < hi - lo:
                links += spanning(part.column("id").to_pylist(), [shingles(t.as_py()) for t in part.column("text")], half)
        give_back()
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})

    work = texts.join(dealt, "id").repartition(min(bins, MOST_PARTITIONS), "bin")
    return materialize(work.select("bin", "unit", "side", "id", "text").groupBy("bin").applyInArrow(confirm, "a long, b long").distinct(), tag)


def between(texts: DataFrame, rest: DataFrame, of: DataFrame, facts: DataFrame) -> DataFrame:
    """Links (a, b) between the components c that meet in the buckets of rest (key, rep, low, c, size); step 3 of near_groups.

    of (id, component) are the components so far, facts (rep, n, n_bytes, sets) the sizes of the representatives.
    """
    large = rest.where(F.col("size") > BLOCK)
    cluster = components(large.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    small = rest.where(F.col("size") <= BLOCK).select(F.col("key").alias("unit"), F.col("rep").alias("id"), "c")
    wide = cluster.join(of, "id", "left").select(F.xxhash64(F.lit("cluster"), cluster["component"]).alias("unit"), "id", F.coalesce(of["component"], "id").alias("c"))
    units = small.unionByName(wide).join(facts.select(F.col("rep").alias("id"), "n", "n_bytes", "sets"), "id")
    # Sets whose sizes are more than one class apart cannot reach the similarity; ids with several sets are of no class.
    units = units.withColumn("class", F.when(F.col("sets") == 1, F.floor(F.log(100 / SIMILARITY, F.col("n").cast("double")))).cast("int"))
    units = materialize(units, "units")
    own = units.groupBy("unit", "c").agg(F.count("*").alias("size")).where(F.col("size") >= BLOCK)
    units = materialize(units.join(checked_broadcast(own.select("unit", "c", F.col("c").alias("whole"))), ["unit", "c"], "left"), "owned")
    counts = units.groupBy("unit", "whole", "class").agg(F.count("*").alias("size"), F.sum("n_bytes").alias("bytes"))
    counts = counts.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)))
    counts = materialize(counts, "counts")
    blocks = counts.select("unit", "whole", "class", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    name = F.xxhash64("whole", "class", "k")
    blocks = materialize(blocks.withColumn("block", name), "blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    near = F.col("x.class").isNull() | F.col("y.class").isNull() | (F.abs(F.col("x.class") - F.col("y.class")) <= 1)
    pairs = x.join(y, F.col("x.unit") == F.col("y.unit")).where(near & (F.col("x.block") <= F.col("y.block")) & F.coalesce(F.col("x.whole") != F.col("y.whole"), F.lit(True)))
    pairs = pairs.select("x.unit", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.select("unit", F.explode(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side"), "i", "j"), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"), "i", "j"))).alias("s"))
    sides = sides.select("unit", "s.*").where("not (i = j and side = 1)")
    placed = units.join(checked_broadcast(counts.select("unit", "whole", "class", "blocks")).alias("b"), (F.col("b.unit") == units["unit"]) & F.col("b.whole").eqNullSafe(units["whole"]) & F.col("b.class").eqNullSafe(units["class"]))
    placed = placed.select(units["unit"], "id", "n_bytes", F.xxhash64(units["whole"], units["class"], F.pmod(F.xxhash64("id"), F.col("b.blocks"))).alias("block"))
    placed = materialize(placed.join(sides, ["unit", "block"]).select("id", "n_bytes", "side", "unit", "i", "j"), "placed")
    unit = F.xxhash64("unit", "i", "j").alias("unit")
    within = placed.where("i = j").select(unit, "side", "id", "n_bytes")
    across = placed.where("i <> j").select(unit, "side", "id", "n_bytes")
    return compared(texts, within, "all", "links").unionByName(compared(texts, across, "sides", "links"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document; component_id is the smallest doc_id that links reach.

    1. Each task signs its documents from whole texts. Documents of one set (exact or re-spaced copies) are linked at once
       and go on as one representative, so copies never meet in pairs; hot groups of copies are joined by broadcast.
    2. Stars: in each band bucket every representative is compared, on full sets, with the smallest one, and components of
       the links that hold are formed. Most buckets are then of one component, and nothing in them is left to decide.
    3. What is left: buckets of three or more with several components. Those of up to BLOCK representatives are compared
       whole; larger ones are first chained to clusters, so that they are compared once, not once a band. A cluster is cut
       into blocks by size of set (of blocks whose sizes cannot reach the similarity no pair is made), and a component that
       fills a block has blocks of its own, which are not compared with each other: a hot group of near copies with a few
       strangers costs its members times the strangers, not its members squared.
    4. Components of all links that hold give the result.

    Nothing is lost: every pair that meets in any band is compared in 2 or 3, or already of one component. Counts and minima
    are pre-aggregated, so no bucket, hub or cluster meets in one task.

    A null text, or one without words, has no shingles and stays alone. A very long text is one block. Rows that repeat a
    doc_id are one document: links of each of their texts count for all of them. A null doc_id links nothing and has a null
    component. Ties (equal sets) are linked. An empty table gives an empty result. Other columns are ignored.
    """
    signed = materialize(signatures(docs), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    copies = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"), F.max("n_bytes").alias("n_bytes"))
    copies = materialize(copies, "copies")
    # A representative is a set; where rows of one doc_id have several sets, they are several, and one component by their id.
    facts = copies.groupBy("rep").agg(F.min("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("sets"))
    keyed = materialize(copies.select("rep", F.explode("bands").alias("key")), "keyed")
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("m"))
    met = materialize(join_groups(keyed, buckets.where("m > 1"), "key", "m"), "met")
    stars = materialize(met.where("rep <> low").select("low", "rep").distinct(), "stars")
    sized = facts.select(F.col("rep").alias("id"), "n_bytes")
    # A star is cut into units of about BLOCK_BYTES; its centre goes to each.
    leaves = stars.join(sized, F.col("rep") == F.col("id"))
    parts = leaves.groupBy("low").agg(F.ceil(F.greatest(F.sum("n_bytes") / BLOCK_BYTES, F.count("*") / BLOCK)).alias("parts"), F.count("*").alias("size"))
    leaves = join_groups(leaves.select("low", "rep", "n_bytes"), parts, "low", "size")
    leaves = materialize(leaves.select(F.xxhash64("low", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("unit"), F.lit(1).alias("side"), F.col("rep").alias("id"), "n_bytes", "low"), "leaves")
    centres = leaves.groupBy("unit", "low").agg(F.lit(0).alias("side")).join(sized, F.col("low") == F.col("id")).select("unit", "side", "id", "n_bytes")
    members = materialize(leaves.drop("low").unionByName(centres), "members")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    texts = texts.join(checked_broadcast(met.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
    texts = texts.groupBy("id", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text")).select("id", "text")
    confirmed = compared(texts, members, "sides", "star-links")
    of = materialize(components(confirmed), "star-components")

    of_rep = F.coalesce("component", "rep").alias("c")
    open_ = met.where("m > 2").join(of.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "m", "low", of_rep)
    open_ = materialize(open_, "open")
    several = open_.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same")).where("c0 <> c1")
    # Buckets of the same members (two near copies share many bands) are one.
    several = several.groupBy("size", "same").agg(F.min("key").alias("key"))
    rest = materialize(join_groups(open_, several.select("key", "size"), "key", "size"), "rest")
    links = confirmed if rest.isEmpty() else confirmed.unionByName(between(texts, rest, of, facts))
    found = materialize(components(links), "components")

    reps = copies.select("set_key", "rep", "n_copies").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    reps = reps.select("set_key", "n_copies", F.coalesce("component", "rep").alias("component_id"))
    narrow = signed.select("doc_id", "n_shingles", "set_key")
    linked = join_groups(narrow.where("n_shingles > 0 and doc_id is not null"), reps, "set_key", "n_copies")
    alone = narrow.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def keep_near(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: the smallest doc_id of each component."""
    dropped = near_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(checked_broadcast(dropped), "doc_id", "left_anti").select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read_table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
