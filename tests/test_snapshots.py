import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ladderworks.sources import relational, snapshots

SF = "/root/testdata/sf0.001"


def weeks(spark, n, value):
    return spark.range(n).select((F.lit(199001) + 100 * (F.col("id") % 5) + F.col("id") % 50).cast("int").alias("week"), F.lit(value).alias("v"), (F.lit(1990) + F.col("id") % 5).cast("int").alias("year"))


def test_a_reader_sees_the_old_or_the_new_table_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.publish(spark, [weeks(spark, 100, "old")], root, ["year"]) == 1
    before = snapshots.read(spark, root)

    def chunks():
        yield weeks(spark, 60, "new")
        assert {(r.v, r["count"]) for r in snapshots.read(spark, root).groupBy("v").count().collect()} == {("old", 100)}  # half loaded
        yield weeks(spark, 70, "new")

    assert snapshots.publish(spark, chunks(), root, ["year"]) == 2
    assert before.count() == 100 and {r.v for r in before.collect()} == {"old"}  # planned before, read after
    assert {(r.v, r["count"]) for r in snapshots.read(spark, root).groupBy("v").count().collect()} == {("new", 130)}
    assert snapshots.read(spark, root, 1).count() == 100


def test_failed_and_empty_loads_change_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        snapshots.read(spark, root)
    snapshots.publish(spark, [weeks(spark, 10, "a").limit(0), weeks(spark, 10, "a")], root)

    def broken():
        yield weeks(spark, 5, "b")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        snapshots.publish(spark, broken(), root)
    with pytest.raises(ValueError):
        snapshots.publish(spark, [], root)
    assert snapshots.read(spark, root).count() == 10 and [p.name for p in (tmp_path / "t").iterdir()] == ["v-0000000001"]


def test_a_number_that_is_taken_is_passed_over(spark, tmp_path):
    root = str(tmp_path / "t")

    def slow():
        yield weeks(spark, 5, "late")
        snapshots.publish(spark, [weeks(spark, 7, "other")], root)

    assert snapshots.publish(spark, slow(), root) == 2
    folder = snapshots._Folder(spark, root)
    weeks(spark, 1, "x").write.parquet(f"{root}/.load-x")
    assert not folder.rename(f"{root}/.load-x", 2) and folder.rename(f"{root}/.load-x", 3)
    assert snapshots.expire(spark, root, 2) == [2, 3] and snapshots.expire(spark, root, 0) == [3]


def test_predicates_prune_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.publish(spark, [weeks(spark, 100, "a")], root, ["year"])
    found = snapshots.since(snapshots.read(spark, root), 199310, 1990)
    assert found.count() == weeks(spark, 100, "a").where("week >= 199310 AND year >= 1990").count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "1993" in plan.split("PartitionFilters")[1].split("]")[0]


def test_relational_scan_and_load(spark):
    url = "jdbc:derby:memory:weeks;create=true"
    rows = weeks(spark, 100, "a").union(spark.createDataFrame([(None, "n", None), (180001, "low", 1800), (209901, "high", 2099)], "week int, v string, year int"))
    relational.replace(rows, url, "weekly", batch=7)
    split = relational.year_predicates('"week"', 1990, 1994)
    found = relational.scan(spark, url, "weekly", split)
    assert found.rdd.getNumPartitions() == 5
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    recent = found.where("week >= 199310").select("v")
    assert "PushedFilters: [*IsNotNull(week)" in recent._jdf.queryExecution().executedPlan().toString()
    assert recent.count() == rows.where("week >= 199310").count()
    relational.append(rows.limit(3), url, "weekly")
    assert relational.scan(spark, url, "weekly").count() == 106
    relational.replace(rows.limit(4), url, "weekly")
    assert relational.scan(spark, url, "weekly").count() == 4
    assert relational.year_predicates("w", 1990, 1990) == ["1 = 1"]


@pytest.mark.parametrize("name", ["SRC11_recent_weeks", "SRC12_whole_table"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation supplier orders lineitem".split():
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want.select(*sorted(want.columns)).fetchall())
