import math

import duckdb
import pytest

import __spark_entry__ as entry
from ladderworks.plans import narratives

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(narratives.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation supplier orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    left, right = sorted(map(tuple, got.select(*names).collect())), sorted(want.select(*names).fetchall())
    assert len(left) == len(right) > 10
    for a, b in zip(left, right, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)), (a, b)


def test_a_short_history_counts_whole(spark):
    rows = spark.createDataFrame([(199001 + i, 1, 1500.0 + i) for i in range(20)], "week int, pid int, rating double")
    assert narratives.warmed(rows).where("warm").count() == 20
    more = spark.createDataFrame([(i, 1, 1.0) for i in range(60)], "week int, pid int, rating double")
    assert sorted(r.week for r in narratives.warmed(more).where("warm").collect()) == list(range(52, 60))
