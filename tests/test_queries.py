"""The registered queries; ``check_oracles.py`` compares all of them at any scale."""

import duckdb
import pytest
from check_oracles import TABLES, compare

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["run_all_metrics", "api_counts", "pivot_compat", "and_or_search", "union_by_key", "stream_minus",
          "release_date", "export_csv", "class_apis", "remove_apis", "query_for", "upsert"]


def test_every_query_has_an_oracle():
    from driftline.plans import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ok, text = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, text


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
