import pytest
from helpers import DATA, same
from wavespan.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_known_split(spark):
    from wavespan.plans.queries import all_split

    n = {r["split"]: r["count"] for r in all_split(spark, "/root/testdata/sf0.01").groupBy("split").count().collect()}
    assert n == {"train": 23164, "validate": 2578, "discard": 25313}
