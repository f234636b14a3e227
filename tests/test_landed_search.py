"""The whole chain from landed responses to results, with all searches, against SQL on the smallest tables."""

import duckdb
from pyspark.sql import functions as F

from trellis.plans import catalog


def test_landed_search_equals_the_chain_in_sql(spark, sf):
    con = duckdb.connect()
    con.execute("SET memory_limit='4GB'")
    con.execute("SET max_temp_directory_size='4GB'")
    for t in "region nation customer supplier part orders lineitem events documents benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(catalog.landed_search_sql())
    names = [d[0] for d in want.description]
    rows = sorted((tuple(str(x) for x in r) for r in want.fetchall()))
    got = catalog.landed_search(spark, sf).select(*names).collect()
    assert len(rows) > 500 and sorted(tuple(str(x) for x in r) for r in got) == rows


def test_no_comment_of_a_listed_page_is_left_out(spark, sf):
    from trellis.plans import fixtures
    joined = fixtures.load(spark, sf, "orders").join(fixtures.load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    whole = joined.join(fixtures.load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).count()
    assert catalog.raw_unified(spark, sf).where(F.col("label") == "comments").count() == whole
    assert {r["label"]: r["n"] for r in catalog.snapshot_counts(spark, sf).collect()}["comments"] == whole
