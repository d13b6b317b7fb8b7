"""Quality rules by cross-document line frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import WS, WS_RE, checked_broadcast, materialize

#: A line is boilerplate of its host if over MIN_DOCS of the host's different texts hold it, and over MIN_SHARE of them.
MIN_DOCS = 20
MIN_SHARE = 0.01
#: A document is depleted if its lines that stay hold less than this share of its words.
MIN_LEFT = 0.3
#: Words of a window of the repetition rule.
WINDOW = 5


def _shifted(a, by: int):
    return F.slice(a, F.lit(1 + by), F.greatest(F.size(a) - by, F.lit(0)))


def repeat_words(words):
    """Words in windows of 5 words that the array holds twice or more, the first included.

    Windows are 64-bit hashes built by zipping shifted arrays, so the work grows with the words; only where a window
    repeats are (hash, position) pairs sorted to find which words the repeats cover.
    """
    h = F.transform(words, lambda w: F.xxhash64(w))
    win = h
    for k in range(1, WINDOW):
        win = F.zip_with(win, _shifted(h, k), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.slice(win, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))


def with_base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, host, text) with the base counts and the lines that hold a word, hashed after normalisation."""
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("text", text)
    d = d.select("doc_id", "host", "text", F.filter(F.split("text", WS_RE), lambda w: w != "").alias("words"))
    d = d.select("doc_id", "host", "text", F.size("words").cast("long").alias("n_words"), repeat_words(F.col("words")).alias("win"))
    d = d.withColumn("rep", F.size("win") > F.size(F.array_distinct("win")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)
    d = d.select(
        "doc_id", "host", "n_words", "win", "rep", lines.alias("lines"), F.xxhash64("text").alias("text_hash"),
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    # Where windows repeat: pairs in order of (hash, position); neighbours of equal hash are repeats.
    pairs = F.when(F.col("rep"), F.array_sort(F.zip_with("win", F.sequence(F.lit(1), F.greatest(F.size("win"), F.lit(1))), lambda h, p: F.struct(h.alias("h"), p.alias("p")))))
    d = d.withColumn("pairs", pairs)
    twins = F.zip_with("pairs", _shifted(F.col("pairs"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("at", F.when(F.col("rep"), F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))))
    gaps = F.zip_with("at", _shifted(F.col("at"), 1), lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), b - a)))
    d = d.withColumn("gaps", gaps)
    return d.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "text_hash",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate("gaps", F.lit(0), lambda s, g: s + g), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(F.lower(F.trim(F.regexp_replace(F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")), " {2,}", " ")))).alias("line"), (F.size(F.split(F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")), " +"))).alias("w"))).alias("lines"),
    )


def judged(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row a document: the base counts, n_removed_words (words of removed lines), base_failed and kept.

    A line is lower-cased, its blanks collapsed, and hashed to 64 bits. Its frequency is the number of different texts of
    the host that hold it, so exact copies count once. Lines above both limits go; a document with under ``min_left`` of
    its words left is depleted. Counts are pre-aggregated by (host, line), so neither a hot host nor a common line meets
    in one task, and texts are read once and never shuffled.

    A very long text is one row of one task, and only hashes of its lines move. Equal counts are no ties: limits are
    exceeded or not. A null text has no words and fails the base; a null host is a host of its own; rows that repeat a doc_id are judged
    each; an empty table gives an empty result. Other columns are ignored.
    """
    base = with_base(docs.select("doc_id", F.col(host).alias("host"), "text"))
    base = materialize(base, "quality")
    lines = base.select("doc_id", "host", "text_hash", F.explode("lines").alias("x")).select("doc_id", "host", "text_hash", "x.line", "x.w")
    seen = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    hosts = base.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    common = seen.join(checked_broadcast(hosts.withColumnRenamed("host", "of")), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > min_share * F.col("texts")).select("host", "line")
    common = checked_broadcast(materialize(common, "common-lines"))
    hit = lines.alias("l").join(common.alias("c"), (F.col("l.line") == F.col("c.line")) & F.col("l.host").eqNullSafe(F.col("c.host")), "left_semi")
    # A row is known by its id, host and text; rows alike in all three lose the same lines, so their sums are shared out.
    row = ["doc_id", "host", "text_hash"]
    named = lambda p: [F.col(c).alias(p + c) for c in row]
    alike = lambda p, q: F.col(p + "doc_id").eqNullSafe(F.col(q + "doc_id")) & F.col(p + "host").eqNullSafe(F.col(q + "host")) & (F.col(p + "text_hash") == F.col(q + "text_hash"))
    removed = hit.groupBy(*named("r_")).agg(F.sum("w").alias("gone"), F.count("*").alias("n_gone"))
    twins = base.groupBy(*named("t_")).agg(F.count("*").alias("same")).where("same > 1")
    same = F.coalesce("same", F.lit(1))
    removed = removed.join(twins, alike("r_", "t_"), "left").select("r_doc_id", "r_host", "r_text_hash", (F.col("gone") / same).cast("long").alias("n_removed_words"), (F.col("n_gone") / same).cast("long").alias("n_removed_lines"))
    out = base.drop("lines").join(removed, alike("", "r_"), "left").fillna(0, ["n_removed_words", "n_removed_lines"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed_words")) < min_left * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source host, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM d),
p AS (SELECT doc_id, unnest(ws) word, generate_subscripts(ws, 1) p FROM w),
g AS (SELECT doc_id, p, CASE WHEN count(*) OVER f = 5 THEN string_agg(word, ' ') OVER f END win FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) c FROM g WHERE win IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) n FROM r, range(5) s(k) GROUP BY 1),
l AS (SELECT doc_id, host, t, x.line raw, trim(regexp_replace(lower(x.line), '[\x20\x09\x0B\x0C\x0D]+', ' ', 'g')) line
      FROM (SELECT doc_id, host, t, unnest(list_transform(string_split(t, chr(10)), lambda y: {'line': y})) x FROM d) WHERE regexp_matches(x.line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) n FROM l GROUP BY 1),
f AS (SELECT host, line, count(DISTINCT t) n FROM l GROUP BY 1, 2),
h AS (SELECT host, count(DISTINCT t) texts FROM d GROUP BY 1),
c AS (SELECT f.host, f.line FROM f JOIN h ON f.host IS NOT DISTINCT FROM h.host WHERE n > 20 AND n > 0.01 * texts),
gone AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) n, count(*) k FROM l JOIN c ON l.line = c.line AND l.host IS NOT DISTINCT FROM c.host GROUP BY 1),
o AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(dup.n, 0)::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words,
             coalesce(gone.k, 0)::BIGINT n_removed_lines, coalesce(gone.n, 0)::BIGINT n_removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM o
"""
