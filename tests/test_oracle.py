"""Oracle parity: every registered query against its DuckDB SQL at sf0.001
(the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from lithos.plans.queries import QUERIES
from tests.oracle_harness import compare, duck

# the training-data queries have their own tests
SQL = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(NAMES) == set(SQL)


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL])
def test_query_matches_oracle(spark, con, sf_dir, name):
    ok, msg = compare(spark, con, sf_dir, name, E.queries()[name], SQL[name])
    assert ok, msg


def test_list_files_rows(spark, sf_dir):
    from lithos.sources import list_files

    rows = list_files(spark, sf_dir, "*.parquet", True).collect()
    assert sorted(r["name"] for r in rows) == sorted(f"{t}.parquet" for t in
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
    assert all(r["size_bytes"] > 0 and r["relative_path"] == r["name"] for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["pos", "x", "y", "z", "event_type"]
    assert df.count() > 0
