import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that the operators use inside.
CLASH = ("id", "n", "g", "h", "p", "d", "key", "keys", "rep", "row", "rows", "line", "lines", "words", "win", "block", "bucket", "shard", "slot", "source_no", "size", "copies", "turn", "component", "host", "_id", "bands", "kept")
WORDS = "the of and river stone quiet morning walks under bright lamps seven old bridges carry trains toward a northern harbor where ships wait for rain".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and copies."""
    long = prose(1, 30_000)
    passage = prose(2, 80)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, "one two three", "en", None, 13), (5, "one  two\nthree", "fr", "b", 14), (6, long, "en", "a", len(long)),
        (7, long.replace("river3 ", "", 1), "en", "a", 0), (8, prose(3, 60) + " " + passage, "de", "b", 1), (9, passage + "\n" + prose(4, 60), "es", "b", 1), (10, "a\na\na\nb b b b b b b b b b b b", "en", "c", 5),
        (11, "héllo wörld — ünï ÀÉ mail x.y@z.org +49 (30) 1234567 4111 1111 1111 1111 10.0.0.255 300.1.1.1", "de", "c", 5), (12, "!!! 123 ***", "en", "c", 5), (13, "same same", "en", "a", 9), (14, "same same", "en", "a", 9),
        (15, prose(5, 40), "en", "hot", 1), (15, prose(5, 40), "en", "hot", 1), (None, prose(6, 20), "en", "a", 2), (17, "𝔘nicode \U0001f600 text\x1cwith\x85odd marks", "en", "a", 2),
    ]
    return rows + [(100 + i, prose(50 + i % 30, 30 + i % 7), ("en", "de", "fr")[i % 3], "hot" if i % 3 else "b", i) for i in range(60)]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(None).cast("string").alias(c) if i % 2 else F.lit(7).alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def table(documents):
    """The smallest documents table as {doc_id: row}."""
    return {r.doc_id: r for r in documents.collect()}
