"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import WS, checked_broadcast, fresh, join_groups, materialize

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64


def normalised(text="text"):
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), WS, "")


def _own_text(text="text"):
    """Tells apart the rows of one doc_id by their texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, kept), one row a document: its group of equal normalised texts.

    The longest original text stays, then the smallest doc_id, then (rows of one doc_id) any one row. Three refinements: rows whose length is shared, of these
    the rows whose prefix hash is shared too, and only for those is the whole text read again and hashed. Lengths and
    prefix hashes travel as narrow rows; counts are pre-aggregated before each shuffle, and groups with over a thousandth
    of the rows are joined by broadcast.

    Null or blank texts are equal to each other (empty). Rows that repeat a doc_id are members each of its own, of which
    one row at most stays; a null doc_id is a member that stays only if no other does. A very long text is hashed where it
    is read, and only its hash moves. An empty table gives an empty result. Other columns are ignored.
    """
    return _groups(docs, prefix).drop("own", "text_sha256")


def hashed_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """exact_groups with text_sha256, the hash of the row's own normalised text. Each text is hashed once: where it may have
    copies by the refinement, else when the row is given out; nothing is joined by doc_id, which may be null or repeat."""
    return _groups(docs, prefix, True).drop("own")


def _groups(docs: DataFrame, prefix: int = PREFIX, all_hashes: bool = False) -> DataFrame:
    """exact_groups with own, the hash of the row's text, and text_sha256, both for all rows that may have copies;
    ``all_hashes``: text_sha256 for every row, which costs a read of the other texts."""
    norm = normalised()
    docs = docs.select("doc_id", "text")
    narrow = materialize(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, prefix)).alias("p")), "exact-narrow")
    lengths = narrow.groupBy("n").count().where("count > 1").select("n")
    by_length = narrow.join(checked_broadcast(lengths), "n", "left_semi")
    prefixes = by_length.groupBy("n", "p").count().where("count > 1").select("n", "p")
    survivors = narrow.join(checked_broadcast(prefixes), ["n", "p"], "left_semi").select("doc_id").distinct()
    full = docs.withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(checked_broadcast(survivors.select(F.coalesce("doc_id", F.lit(-1)).alias("d"))), "d", "left_semi")
    full = materialize(full.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(norm, 256).alias("h"), _own_text().alias("own"), F.monotonically_increasing_id().alias("at")), "exact-full")
    best = F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), "at")
    groups = full.groupBy("h").agg(F.max(best).alias("best"), F.count("*").alias("group_size")).select("h", (-F.col("best.minus_id")).alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size")
    grouped = join_groups(full, groups, "h", "group_size").select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "own", F.col("h").alias("text_sha256"))
    ids = survivors.select(F.coalesce("doc_id", F.lit(-1)).alias("d"))
    alone = (docs if all_hashes else narrow).withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(checked_broadcast(ids) if all_hashes else ids, "d", "left_anti")
    digest = F.sha2(norm, 256) if all_hashes else F.lit(None).cast("string")
    return grouped.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("own"), digest.alias("text_sha256")))


def keep_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. A row goes by its doc_id and text, so other texts of its doc_id stay;
    of rows with the kept doc_id and text any one stays, pre-aggregated, as they may be many."""
    key, own, row = fresh(docs, "key"), fresh(docs, "own"), fresh(docs, "row")
    rows = _groups(docs).where("own is not null").groupBy(F.col("doc_id").alias(key), F.col("own").alias(own)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = materialize(rows.where("n > 1 or not kept"), "exact-touched")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (_own_text() == F.col(own))
    out = docs.join(checked_broadcast(rows.select(key, own)), same, "left_anti")
    repeated = rows.where("kept").select(key, own)
    if repeated.isEmpty():
        return out
    one = docs.join(checked_broadcast(repeated), same).groupBy(key, own).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return out.unionByName(one.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed_groups(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
