import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladderworks.functions import labels, scoring
from ladderworks.operators import connectivity, ratings
from ladderworks.operators.ratings import Engine
from ladderworks.sources.fixtures import season_files
from ladderworks.streaming.matches import merge_slices, rate_stream
from test_ratings import MATCH, season
from test_search import same


def rows_of(spark, path):
    return sorted((r.id, r.v, r.year) for r in spark.read.parquet(path).collect())


def test_newest_row_wins_and_keys_move(spark, tmp_path):
    path, kind = str(tmp_path / "t"), "id int, v int, at int, year int"
    put = lambda rows: merge_slices(spark.createDataFrame(rows, kind), path, ["id"], "year", "at")
    put([(1, 10, 1, 2020), (1, 11, 3, 2020), (1, 12, 2, 2020), (2, 20, 1, 2021), (3, 30, 5, 2021)])
    assert rows_of(spark, path) == [(1, 11, 2020), (2, 20, 2021), (3, 30, 2021)]
    put([(2, 21, 2, 2022), (3, 29, 4, 2021)])  # 2 moves; this row of 3 is older than the table's
    assert rows_of(spark, path) == [(1, 11, 2020), (2, 21, 2022), (3, 30, 2021)]
    again = [(1, 13, 9, 2022), (1, 13, 9, 2022)]
    put(again)  # its old slice has no rows left
    put(again)
    assert rows_of(spark, path) == [(1, 13, 2022), (2, 21, 2022), (3, 30, 2021)]


def test_late_matches_give_the_states_of_a_full_run(spark, tmp_path):
    weeks = [202001, 202003, 202004, 202008, 202011, 202012]
    matches, engine = season(11, weeks), Engine(decay=4.0, grace=1, reseed_after=6)
    late = [m for m in matches if m[5] == 202004][:3] + [(900, 1, 77, 2, 0, 202003)]
    files = [[m for m in matches if m[5] <= 202008 and m not in late], [m for m in matches if m[5] > 202008], late]
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for part in files:
        spark.createDataFrame(part, MATCH).coalesce(1).write.mode("append").parquet(source)
        rate_stream(spark.readStream.schema(MATCH).parquet(source), path, str(tmp_path / "cp"), engine).awaitTermination()
    got = {(r.week, r.pid): (r.mu, r.phi, r.sigma, r.seen) for r in spark.read.parquet(f"{path}/states").collect()}
    whole = ratings.weekly_states(spark.createDataFrame([m for part in files for m in part], MATCH), engine)
    want = {(r.week, r.pid): (r.mu, r.phi, r.sigma, r.seen) for r in whole.collect()}
    assert same(got, want) and (202003, 77) in got


def test_season_files_with_quotes_and_short_rows(spark, tmp_path):
    texts = {"italy/9900/I1.csv": 'Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nI1,28/08/99,"Milan, AC",Roma,2,1,H,extra\n\nI1,29/08/99,Lazio\n,,,,,,\n', "spain/0102/S.csv": "﻿Season,Date,Home,Away,HG,AG,Res\n2001/2002,01/09/2001,Home,Date,x,1,A\n", "x/y/notes.csv": "a note, no matches\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sorted((r.country, r.season, r.home_team, r.away_team, r.home_goals, r.away_goals) for r in season_files(spark, str(tmp_path)).collect())
    assert got == [("italy", "9900", "Milan, AC", "Roma", 2, 1), ("spain", "2001/2002", "Home", "Date", None, 1)]


def test_settings_and_forms(spark):
    for wrong in ({"damping": 1.0}, {"steps": 0}, {"heat_half": 0.0}, {"heat_cross": 0.0}, {"volume_trust_mode": "x"}):
        with pytest.raises(ValueError):
            connectivity.Settings(**wrong)
    one = spark.range(1).select(scoring.saturating(F.lit(24.0), 24.0).alias("a"), scoring.saturating(F.lit(24.0), 24.0, "exp").alias("b"), labels.season_label(F.lit("2024-2025"), "fbref").alias("c")).first()
    assert (one.a, one.c) == (0.5, "2024/2025") and one.b == pytest.approx(0.6321205588)


def test_anchors(spark):
    weekly = spark.createDataFrame([(202509, 2, 1300.0, "G"), (202510, 1, 1600.0, "S"), (202510, 2, 1400.0, None), (202510, 3, 1500.0, "S")], "week int, pid bigint, rating double, country_name string")
    matches = spark.createDataFrame([(1, 1, 2, 1, 0, 202510, dt.date(2025, 3, 5))], MATCH + ", match_date date")
    of = lambda **k: {(r.week, r.pid): r.anchor for r in connectivity.anchors(weekly, matches, **k).collect()}
    assert of()[202510, 1] == 1500 and of(fixed=1234.0)[202509, 2] == 1234
    assert of(mode="domestic") == {(202509, 2): 1300, (202510, 1): 1550, (202510, 2): 1500, (202510, 3): 1550}
    recent = connectivity.anchors(weekly, matches, "oppo_recent_mean")
    assert {(r.week, r.pid): (r.anchor, r.used) for r in recent.collect()} == {(202509, 2): (1300, 0), (202510, 1): (1300, 1), (202510, 2): (1500, 1), (202510, 3): (1500, 0)}
    with pytest.raises(ValueError):
        connectivity.anchors(weekly, mode="other")
