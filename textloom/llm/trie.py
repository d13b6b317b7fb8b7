"""Conversation prefix trie: polynomial prefix fingerprints group candidates, whole turns verify them, sums roll up to all ancestors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import NON_WS_RE, checked_broadcast, join_groups, materialize, small_batches

#: Conversations of one family share the head of its first: those with the same number without its rest by FAMILY. The head
#: has crc32 mod HEADS turns; fixed values of the contract.
FAMILY, HEADS = 20, 4
#: Prime moduli and bases of the two fingerprints: products fit unsigned 64 bits, both together one long.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
#: Turns of a conversation that are scanned together; longer ones are scanned block by block.
BLOCK = 4096
#: A node's name while the trie is built: depth, fingerprint, and the label that splits equal fingerprints.
NODE = pa.struct([(c, pa.int64()) for c in ("depth", "fp", "label")])
#: Characters of role and text by which turns of one number are put in order; ids in one piece of a list of ends.
TIE, PIECE = 64, 4096


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, p, role, text) of rows (conv_id, turn, role, text): p counts from 0 in the order of turn, null first.

    Rows with equal turns are in the order of role and text by their first TIE characters, then of a hash of both; equal rows
    are turns each. Rows are dealt by range, and a row's own number is the last key, so that a conversation of any length,
    or one row repeated at will, spreads over tasks. Only counts of the conversations that a border cuts are carried over.
    """
    role, text = F.substring("role", 1, TIE), F.substring("text", 1, TIE)
    keys = ["conv_id", "turn", "_r", "_t", "_h", "_i"]
    rows = turns.withColumn("_r", role).withColumn("_t", text).withColumn("_h", F.xxhash64("role", "text")).withColumn("_i", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", F.spark_partition_id().alias("_part"), "role", "text")

    def number(batches):
        last, seen = None, 0
        for batch in batches:
            conv, at = batch.column("conv_id").to_numpy(), np.arange(batch.num_rows)
            new = np.ones(len(conv), bool)
            new[1:] = conv[1:] != conv[:-1]
            if len(conv):
                new[0] = conv[0] != last
                start = np.maximum.accumulate(np.where(new, at, -1))
                p = np.where(start >= 0, at - start, at + seen)
                last, seen = conv[-1], int(p[-1]) + 1
                yield batch.append_column("p", pa.array(p, pa.int64()))

    parts = materialize(ranges.mapInArrow(number, "conv_id long, _part int, role string, text string, p long"), "ranges")
    counts = parts.groupBy("conv_id", "_part").agg(F.count("*").alias("n"))
    cut = counts.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes over each border, so this table has at most two rows a partition.
    carried = counts.join(cut, "conv_id", "left_semi").select("conv_id", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return parts.join(F.broadcast(carried), ["conv_id", "_part"], "left").select("conv_id", (F.col("p") + F.coalesce("before", F.lit(0))).alias("p"), "role", "text")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, length, depth, role, text) of the rebuilt conversations, depth from 1, and (conv_id, length) of all of them.

    The first h turns come from the family's first conversation, the rest from the conversation itself; h by crc32 of its number.
    """
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    convs = convs.join(heads, "first", "left").withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = join_groups(placed, convs.select("conv_id", "n", "h", "taken", "length"), "conv_id", "n").where("p >= h")
    own = own.select("conv_id", "length", (F.col("p") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text")
    # A family has at most 39 conversations (those around 0), and only its first HEADS - 1 turns are copied.
    head = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("p") < HEADS - 1)).withColumnRenamed("conv_id", "first")
    head = head.join(convs.where("taken > 0").select("conv_id", "first", "taken", "length"), "first").where("p < taken")
    return own.unionByName(head.select("conv_id", "length", (F.col("p") + 1).alias("depth"), "role", "text")), convs.select("conv_id", "length")


def powers(base: int, at: np.ndarray, prime: int) -> np.ndarray:
    """base ** at modulo prime, element by element, by squaring."""
    out, square, left = np.ones(len(at), np.uint64), base % prime, at.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(prime), out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def fingerprinted(rows: DataFrame, primes=PRIMES, block: int = BLOCK) -> DataFrame:
    """rows with fp, the fingerprint of the first ``depth`` turns, and before, that of one turn less.

    A fingerprint is the sum of hash(turn i) * base ** i modulo a prime, for two primes. numpy scans the sorted rows of each
    block of a conversation; only the last fingerprints of the blocks of long conversations are then added up and carried on.
    """
    turn = [F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(p)).alias(f"t{k}") for k, p in enumerate(primes)]
    rows = rows.select("*", F.floor((F.col("depth") - 1) / block).cast("long").alias("block"), *turn)

    def scan(batches):
        last, sums = None, [0, 0]
        for batch in batches:
            conv, blocks, depth = (batch.column(c).to_numpy() for c in ("conv_id", "block", "depth"))
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (blocks[1:] != blocks[:-1])
            if len(conv):
                new[0] = (conv[0], blocks[0]) != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            columns = []
            for k, (prime, base) in enumerate(zip(primes, BASES)):
                term = batch.column(f"t{k}").to_numpy().astype(np.uint64) * powers(base, depth, prime) % np.uint64(prime)
                total = np.concatenate([[np.uint64(0)], np.cumsum(term)])
                upto = total[1:] - np.where(start >= 0, total[np.maximum(start, 0)], np.uint64(0))
                upto = (upto + np.where(start >= 0, np.uint64(0), np.uint64(sums[k]))) % np.uint64(prime)
                sums[k] = int(upto[-1]) if len(upto) else sums[k]
                columns += [upto.astype(np.int64), ((upto + np.uint64(prime) - term) % np.uint64(prime)).astype(np.int64)]
            last = (conv[-1], blocks[-1]) if len(conv) else last
            for name, c in zip(("f0", "b0", "f1", "b1"), columns):
                batch = batch.append_column(name, pa.array(c, pa.int64()))
            yield batch

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", f0 long, b0 long, f1 long, b1 long"
    scanned = materialize(rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "depth").mapInArrow(scan, schema), "scanned")
    ends = scanned.where((F.col("length") > block) & ((F.col("depth") % block == 0) | (F.col("depth") == F.col("length"))))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("conv_id", "block", *[F.coalesce(F.sum(f"f{k}").over(past), F.lit(0)).alias(f"c{k}") for k in (0, 1)])
    scanned = scanned.join(checked_broadcast(carry), ["conv_id", "block"], "left").fillna(0, ["c0", "c1"])
    both = lambda name: F.shiftleft((F.col(f"{name}0") + F.col("c0")) % primes[0], 31) + (F.col(f"{name}1") + F.col("c1")) % primes[1]
    return scanned.select("conv_id", "length", "depth", "block", "role", "text", both("f").alias("fp"), both("b").alias("before"))


def running(rows: DataFrame, columns: list[str], block: int = BLOCK, backwards: bool = False) -> DataFrame:
    """rows with each column replaced by its sum from the start of the conversation, or from here to its end: within blocks by a
    window, between blocks by their totals."""
    order = F.col("depth").desc() if backwards else F.col("depth")
    inside = Window.partitionBy("conv_id", "block").orderBy(order)
    past = Window.partitionBy("conv_id").orderBy(F.col("block").desc() if backwards else F.col("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where(F.col("length") > block).groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in columns])
    carry = totals.select("conv_id", "block", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_{c}") for c in columns])
    out = rows.withColumns({c: F.sum(c).over(inside) for c in columns}).join(checked_broadcast(carry), ["conv_id", "block"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop(*[f"_{c}" for c in columns])


def verified(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, length, depth, block, node, parent) and nodes (node, parent, conv_id, n_convs, words), exact.

    Rows with one depth and fingerprint are candidates for one node. Members whose turn and parent are equal are put together
    where they are read, then each kind is compared with the representative's, the smallest conversation's. What differs gets
    a mark that all its deeper turns carry on, and all is compared again until nothing differs; a mark is a hash, so chance
    puts no two kinds together for long.
    """
    # Marks are below 2^31, so the sum along a conversation does not overflow.
    rows, key, tries = rows.withColumn("mark", F.lit(0).cast("long")), ["depth", "fp", "label"], 0
    while True:
        tagged = rows.withColumn("label", F.col("mark"))
        if tries:
            tagged = materialize(running(tagged, ["label"], block), "labels")
        tagged = tagged.withColumn("up", F.col("label") - F.col("mark"))
        kind = [*key, "before", "up", "role", "text"]
        kinds = materialize(tagged.groupBy(*kind).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "kinds")
        clash = kinds.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).where("n > 1")
        other = kinds.join(clash, key).where("conv_id <> first")
        if not other.limit(1).count():
            break
        tries += 1
        other = other.select(*kind, (F.pmod(F.xxhash64(F.lit(tries), "before", "up", "role", "text"), F.lit((1 << 31) - 1)) + 1).alias("more"))
        rows = materialize(tagged.join(other, kind, "left").withColumn("mark", F.col("mark") + F.coalesce("more", F.lit(0))).drop("more", "label", "up"), "marked")
    node, parent = F.struct(*key).alias("node"), F.struct((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp"), F.col("up").alias("label")).alias("parent")
    words = F.regexp_count("text", F.lit(NON_WS_RE)).cast("long").alias("words")
    return tagged.select("conv_id", "length", "depth", "block", node), kinds.select(node, parent, "conv_id", "n_convs", words)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the hash of the numbers in order, comma-joined.

    Pieces of at most PIECE numbers are joined first, wherever they are; then a node's pieces go through its hash one after
    the other, so a node at which a third of all conversations end holds one piece at a time.
    """
    piece = F.floor(F.col("conv_id") / PIECE).alias("piece")
    pieces = ends.groupBy("node", piece).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        node, sha, done = None, None, []
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], NODE), pa.array([h for _, h in done], pa.string())], names=["node", "ends_sha256"])
        for batch in batches:
            done = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if n == node:
                    sha.update(b"," + ids.encode())
                    continue
                done += [(node, sha.hexdigest())] if sha else []
                node, sha = n, hashlib.sha256(ids.encode())
            yield as_batch()
        if sha:
            done = [(node, sha.hexdigest())]
            yield as_batch()

    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(digest, f"node {pieces.schema['node'].dataType.simpleString()}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, primes=PRIMES, block: int = BLOCK) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is named by its depth and its smallest member. A conversation is the smallest member of a run of nodes down to its
    last turn, so what is summed over subtrees is laid on those turns, summed from the end of each conversation, and
    added up over the members of every node: one pass for trees of any depth, and no node's members meet in one task.

    Null roles and texts are empty; rows without conv_id are of no conversation and go; null turns come first, and equal turns
    are in the order that ``positions`` states; repeated rows are turns each. Very long texts are compared whole, in
    one row each. An empty table has no root. Other columns are ignored, whatever their names.
    """
    small_batches(conversations.sparkSession)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    placed = materialize(positions(turns), "turns")
    rows, convs = rebuilt(placed)
    rows, nodes = verified(fingerprinted(rows, primes, block), block)
    rows = materialize(rows, "rows")
    root = F.struct(*[F.lit(0).cast(t).alias(c) for c, t in (("depth", "long"), ("fp", "long"), ("label", "long"))])
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(top.select(root.alias("node"), F.lit(None).cast(nodes.schema["parent"].dataType).alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words")))
    nodes = materialize(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = materialize(nodes.withColumn("depth", F.col("node.depth")), "valued")
    both = ["n_leaves", "saved_tokens"]
    laid = rows.join(nodes.select("conv_id", "depth", *both), ["conv_id", "depth"], "left").fillna(0, both)
    below = running(laid, both, block, backwards=True).groupBy("node").agg(*[F.sum(c).alias(c) for c in both])
    whole = nodes.agg(*[F.sum(c).alias(c) for c in both]).select(root.alias("node"), *both).where("n_leaves > 0")
    ends = rows.where("depth = length").select("node", "conv_id").unionByName(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    out = nodes.drop(*both).join(below.unionByName(whole), "node").join(hashed_ends(ends), "node", "left")
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    inner = join_groups(out.where("depth > 0"), parents, "parent", "siblings").drop("siblings")
    outer = out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return inner.unionByName(outer.select(*inner.columns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *both, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


#: The same rows from whole prefixes as lists of turns. crc32 is done by the bits of each digit.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), digits AS (
  SELECT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS d FROM (SELECT DISTINCT conv_id FROM turns)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(list_prepend(4294967295::BIGINT, d), lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) % 4 AS h
  FROM digits
), pieces AS (
  SELECT c.conv_id, 0 AS part, t.p, t.said FROM convs c JOIN turns t ON t.conv_id = c.first AND t.p < c.h
  UNION ALL SELECT c.conv_id, 1, t.p, t.said FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p >= c.h
), rebuilt AS (
  SELECT c.conv_id, coalesce(list(said ORDER BY part, p) FILTER (WHERE said IS NOT NULL), []) AS said FROM convs c LEFT JOIN pieces USING (conv_id) GROUP BY 1
), prefixes AS (
  SELECT conv_id, len(said) AS n, d, said[1:d] AS path FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2
), children AS (
  SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), valued AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM nodes n LEFT JOIN children USING (path)
), above AS (
  SELECT path[1:e] AS path, n_children, saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM valued)
), below AS (
  SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM valued v JOIN below b ON b.path = v.path LEFT JOIN nodes p ON v.d > 0 AND p.path = v.path[1:v.d - 1] AND p.d = v.d - 1
"""
