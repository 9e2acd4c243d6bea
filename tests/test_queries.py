"""Every named query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database

SMALL = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "course_id", "score", "rank", "similarity_score"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
