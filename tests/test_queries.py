"""Each query of the reference's operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from textloom.plans import registry
from textloom.plans.registry import ORACLE_SQL, QUERIES, selected, selected_sql

TABLES = ("documents", "labels", "embeddings", "pages", "conversations")


def rows(frame, columns):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE_SQL:
        assert len(got) > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_selected_features(spark, sf):
    """No list stops at 2,000 terms, bigrams are in, and small limits choose the terms that the SQL chooses."""
    terms = {r.term for r in QUERIES["v3_selected_tfidf"](spark, sf).select("term").distinct().collect()}
    assert len(terms) > 2000 and any(" " in t for t in terms)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT DISTINCT term FROM ({selected_sql(500, 100)})").fetchall()
    assert {r.term for r in selected(spark, sf, 500, 100).select("term").distinct().collect()} == {t for (t,) in want}


def test_split_vectors_are_written_once(spark, sf):
    """Passes over the vectors read files; no pass joins or splits anew."""
    for part in registry.vector_splits(spark, sf):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
