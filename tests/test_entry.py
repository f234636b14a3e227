"""Driver contract: entry() runs; every oracle has a query; cheap oracles agree at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "link", "title", "content", "email", "creationTime", "lastUpdateTime",
                          "types", "ancestorTitles", "ancestorLinks", "totalScore"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["entity_triples", "ancestor_closure", "inferred_types", "mention_links",
                                  "event_props", "html_table_rows", "snapshot_counts"])
def test_oracle_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    s = E.queries()[name](spark, sf).toPandas()
    d = con.execute(E.oracle_sql()[name]).fetchdf()
    assert rows(s) == rows(d)
