"""Every query with SQL equals DuckDB's answer on the small tables."""

import os

import duckdb
import pytest

from sedgewren.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = all_queries.queries(), all_queries.oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    expected = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == expected


@pytest.mark.parametrize("name", ["preprocess_full", "synthetic_posts", "full_report", "forest_scores", "extra_trees_scores", "gbt_early_scores", "names_redacted", "community_classifier"])
def test_runs(spark, name):
    QUERIES[name](spark, SF).count()


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and "flagship" in ORACLES
