import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ladderworks.functions import names, scoring, weeks
from ladderworks.operators import connectivity, ratings, upsert
from ladderworks.operators.asof import asof_before
from ladderworks.sources.fixtures import load, require, season_files

MATCH = "result_id bigint, match_date date, home_club_id bigint, away_club_id bigint, home_team_goals int, away_team_goals int, league_code string, yyyyww int"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_weeks(spark):
    r = one(spark, weeks.week_sunday(F.lit(202053)), weeks.week_sunday(F.lit(200531)), weeks.packed_week(F.lit(dt.date(2021, 1, 1))), weeks.packed_week(F.lit(dt.date(2021, 1, 1)), clip=False), weeks.parse_date(F.lit("02/08/97")), weeks.parse_date(F.lit("2005-07-01")), weeks.parse_date(F.lit("junk")), weeks.weeks_between(F.lit(202510), F.lit(202501)))
    assert list(r) == [dt.date(2021, 1, 3), dt.date(2005, 8, 7), 202052, 202053, dt.date(1997, 8, 2), dt.date(2005, 7, 1), None, 0]


def test_scales(spark):
    r = one(spark, *[scoring.rank_to_rating(F.lit(k)) for k in (1, 100, 2500)], scoring.saturating(F.lit(5.0), 10), scoring.saturating(F.lit(50.0), 10))
    assert [round(x, 2) for x in r[:3]] == [3000.0, 2263.17, 1748.15]
    assert r[3:] == pytest.approx((1 / 3, 5 / 6))


def test_names(spark):
    same = [("FC Bayern München", "Bayern Munich"), ("Man City", "Manchester City"), ("Paris Saint Germain", "Paris SG")]
    for a, b in same:
        x, y = one(spark, names.canonical_name(F.lit(a)), names.canonical_name(F.lit(b)))
        assert x == y
    assert one(spark, names.canonical_name(F.lit("Queens Park Rangers")))[0] != one(spark, names.canonical_name(F.lit("Rangers")))[0]
    assert [r[0] for r in spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>").select(names.oxford_list(F.col("x"))).collect()] == ["a", "a and b", "a, b, and c"]


def test_worked_rating_example(spark):
    unit = lambda r: (r - 1500) / scoring.SCALE
    state = spark.createDataFrame([(1, 0.0, 200 / scoring.SCALE, 0.06, 0), *[(k, unit(r), d / scoring.SCALE, 0.06, 0) for k, r, d in ((2, 1400, 30), (3, 1550, 100), (4, 1700, 300))]], "pid bigint, mu double, phi double, sigma double, absent int")
    played = spark.createDataFrame([(1, None, 1, 2, 1, 0, "D", 202510), (2, None, 1, 3, 0, 1, "D", 202510), (3, None, 4, 1, 1, 0, "D", 202510)], MATCH)
    calm = state.withColumn("phi", F.sqrt(F.col("phi") ** 2))
    r = next(x for x in ratings.rate_period(calm, played).collect() if x.pid == 1)
    assert 1500 + scoring.SCALE * r.mu == pytest.approx(1474.6659, abs=1e-3)
    assert scoring.SCALE * r.phi == pytest.approx(167.3970, abs=1e-3)
    assert r.sigma == pytest.approx(0.05999710, abs=1e-7)


def test_three_games(spark):
    played = spark.createDataFrame([(1, None, 1, 2, 1, 0, "D", 202510), (2, None, 3, 4, 1, 1, "D", 202510)], MATCH)
    out = {r.pid: (r.rating, r.sigma) for r in ratings.rate_periods(played, "yyyyww").collect()}
    assert out[1][0] > 1500 > out[2][0] and out[3][0] == pytest.approx(1500) and out[1][0] - 1500 == pytest.approx(1500 - out[2][0])


def test_asof_is_strict(spark):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 5), (None, 7)], "k int, t int")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 9, 0.5), (2, 5, 3.0)], "k int, s int, v double")
    got = sorted(((r.k, r.t, r.v) for r in asof_before(left, right, "k", "t", "s", ["v"]).collect()), key=str)
    assert got == sorted([(1, 10, 0.5), (1, 11, 1.0), (2, 5, None), (None, 7, None)], key=str)


def test_diffusion_on_a_line(spark):
    day = lambda d: dt.date(2025, 3, d)
    rows = [(1, day(1), 3, 4, 0, 0, "D", 202509), (2, day(2), 2, 3, 0, 0, "D", 202509), (3, day(3), 1, 2, 0, 0, "D", 202510)]
    clubs = spark.createDataFrame([(1, "England"), (2, "England"), (3, "England"), (4, "Germany")], "club_id bigint, country_name string")
    edges = connectivity.directed(connectivity.weighted_fixtures(spark.createDataFrame(rows, MATCH), clubs))
    weekly = spark.createDataFrame([(202510, 1, 1600.0, 60.0), (202510, 2, 1590.0, 60.0), (202510, 3, 1580.0, 60.0), (202510, 4, 1500.0, 60.0)], "week int, pid bigint, rating double, rd double")
    got = {r.pid: (r.seed, r.comparability) for r in connectivity.diffuse(weekly, edges, connectivity.Settings(weeks=520, steps=10)).collect()}
    want = {1: (0.00426743, 0.01146528), 2: (0.00849858, 0.02494040), 3: (0.03846154, 0.03134892), 4: (0.03448276, 0.01795570)}
    for pid, values in want.items():
        assert got[pid] == pytest.approx(values, abs=1e-7)
    adjusted = connectivity.adjust(weekly, edges).collect()
    assert all(r.adjusted <= r.rating + 1e-9 and math.isfinite(r.adjusted) and r.total_rd >= r.rd for r in adjusted)


def test_diffusion_keeps_no_edge_for_each_week(spark, monkeypatch):
    """What is kept between steps is no longer than vertices and blocks of weeks, however many weeks a window has."""
    first = dt.date(2023, 1, 1)
    rows = [(k, first + dt.timedelta(days=k % 700), k % 9 + 1, k % 7 + 11, 0, 0, "D", 202301) for k in range(600)]
    clubs = spark.createDataFrame([(k, "England" if k % 2 else "Spain") for k in range(1, 20)], "club_id bigint, country_name string")
    edges = connectivity.directed(connectivity.weighted_fixtures(spark.createDataFrame(rows, MATCH), clubs))
    weekly = spark.createDataFrame([(y * 100 + w, k) for y in (2023, 2024) for w in range(1, 53) for k in (1, 12, 40)], "week int, pid bigint")
    sizes, whole = [], connectivity.kept
    monkeypatch.setattr(connectivity, "kept", lambda frame: (sizes.append((out := whole(frame)).count()), out)[1])
    few = connectivity.diffuse(weekly, edges, connectivity.Settings(weeks=60, steps=3))
    assert max(sizes) <= edges.count()
    got = {(r.week, r.pid): (r.seed, r.comparability) for r in few.collect()}
    monkeypatch.setattr(connectivity, "BLOCK", 7)
    monkeypatch.setattr(connectivity, "EDGES", 300)
    many = {(r.week, r.pid): (r.seed, r.comparability) for r in connectivity.diffuse(weekly, edges, connectivity.Settings(weeks=60, steps=3)).collect()}
    assert got.keys() == many.keys() and got[202310, 40] == (0.0, 0.0)
    assert all(many[k] == pytest.approx(v) for k, v in got.items())


def test_competition_labels(spark):
    rows = spark.createDataFrame([("SC0",), ("AUT",), ("UCL",), ("SCOTTISH_CUP",), ("FRIENDLY_X",)], "c string").select(connectivity.community_suffix(F.col("c")), connectivity.match_weight(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("domestic", 1.0), ("domestic", 1.0), ("UCL", 1.0), ("cup", 1.0), ("friendly", 0.05)]


def test_upsert_and_closure(spark):
    main = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, j string, v string")
    staged = spark.createDataFrame([(1, None, "new"), (3, "y", "c")], "k int, j string, v string")
    assert sorted((r.k, r.v) for r in upsert.upsert(main, staged, ["k", "j"]).collect()) == [(1, "new"), (2, "b"), (3, "c")]
    chain = spark.createDataFrame([(3, 2), (2, 1), (5, 5), (7, 8), (8, 7)], "old bigint, new bigint")
    got = {r.old: r.new for r in upsert.closed_map(chain).collect()}
    assert got[3] == 1 and got[2] == 1 and 5 not in got


def test_slices_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.replace_slices(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int"), path, "year")
    upsert.replace_slices(spark.createDataFrame([(9, 2021)], "v int, year int"), path, "year")
    assert sorted((r.v, r.year) for r in spark.read.parquet(path).collect()) == [(1, 2020), (9, 2021)]


def test_season_files(spark, tmp_path):
    for folder, text in (("scotland/9798", "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,\nSC0,02/08/97,A,B,1,2,A,\n,,,,,,,\n"), ("greece/0001", "Div,Date,HT,AT,FTHG,FTAG,FTR\nG1,03/09/00,C,D,0,0,D\n")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "X.csv").write_text(text)
    got = sorted((r.country, r.season, str(r.match_date), r.home_team, r.home_goals) for r in season_files(spark, str(tmp_path)).collect())
    assert got == [("greece", "0001", "2000-09-03", "C", 0), ("scotland", "9798", "1997-08-02", "A", 1)]


def test_loader_contract(spark):
    with pytest.raises(ValueError):
        load(spark, "x.xlsx")
    with pytest.raises(ValueError):
        require(spark.range(1), ["week"])


def test_stream_refreshes_slices(spark, tmp_path):
    from ladderworks.streaming.matches import refresh_slices

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "id int, v int, year int"
    for batch in ([(1, 1, 2020), (2, 1, 2021)], [(2, 5, 2021), (3, 1, 2021)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        refresh_slices(spark.readStream.schema(schema).parquet(source), table, ["id"], "year", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(table).collect()) == [(1, 1), (2, 5), (3, 1)]


def test_queries_run(spark):
    import __spark_entry__ as e

    have, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(have)
    assert e.entry(spark).count() > 0


SMALL = "/root/testdata/sf0.001"


def recent(spark):
    """Fixtures of sf0.001 with weights and communities, as plain rows, and the last day of every week with ratings."""
    from ladderworks.sources.fixtures import clubs, fixtures

    f = fixtures(spark, SMALL)
    edges = connectivity.directed(connectivity.weighted_fixtures(f, clubs(spark, SMALL))).collect()
    weekly = ratings.running_strength(f).collect()
    return edges, weekly, {w: dt.date.fromisocalendar(w // 100, w % 100, 7) for w in {r.week for r in weekly}}


def test_diffusion_covers_every_week(spark):
    from ladderworks.plans import catalog

    edges, weekly, ends = recent(spark)
    got = {(r.week, r.pid): (r.seed, r.comparability) for r in catalog.hd_diffusion(spark, SMALL).collect()}
    want = {}
    for week, stop in ends.items():
        weight, heat = {}, {}
        for e in edges:
            if stop - dt.timedelta(728) < e.match_date <= stop:
                weight.setdefault(e.pid, {}).setdefault(e.opponent, 0.0)
                weight[e.pid][e.opponent] += e.weight
                heat[e.pid] = heat.get(e.pid, 0.0) + e.weight * (1 if e.cross else 0.12)
        seed = {p: heat.get(p, 0) / (heat.get(p, 0) + 28) for p in {r.pid for r in weekly if r.week == week} | set(heat)}
        x = seed
        for _ in range(6):
            flow = {p: 0.0 if p in heat else x[p] for p in seed}
            for p, to in weight.items():
                for q, w in to.items():
                    flow[q] += x[p] * w / sum(to.values())
            x = {p: max(0, min(1, 0.88 * flow[p] + 0.12 * seed[p])) for p in seed}
        want |= {(week, p): (seed[p], x[p]) for p in seed}
    assert set(got) == set(want) and len(ends) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_adjusted_ratings_cover_every_week(spark):
    from ladderworks.plans import catalog

    edges, weekly, ends = recent(spark)
    got = {(r.week, r.pid): r for r in catalog.gc_adjust(spark, SMALL).collect()}
    assert set(got) == {(r.week, r.pid) for r in weekly} and len(ends) > 100
    for r in weekly:
        mine = [e for e in edges if e.pid == r.pid and ends[r.week] - dt.timedelta(728) < e.match_date <= ends[r.week]]
        masses = {}
        for e in mine:
            masses[e.other] = masses.get(e.other, 0) + e.weight
        volume = sum(masses.values())
        h = -sum(m / volume * math.log(m / volume) for m in masses.values()) / math.log(len(masses)) if len(masses) > 1 else 0.0
        a = got[r.week, r.pid]
        assert (a.volume, a.h_norm, a.direct) == pytest.approx((volume, h, 0.05 + 0.95 * h * min(1, volume / (volume + 24))), abs=2e-5)
        assert a.opponents == len({e.opponent for e in mine}) and a.adjusted <= r.rating + 1e-5


def test_weekly_ratings_follow_each_other(spark, monkeypatch):
    from ladderworks.plans import catalog
    from ladderworks.sources.fixtures import fixtures

    weeks_of = [r[0] for r in fixtures(spark, SMALL).select("yyyyww").distinct().orderBy("yyyyww").limit(4).collect()]
    few = fixtures(spark, SMALL).where(F.col("yyyyww").isin(weeks_of)).cache()
    monkeypatch.setattr(catalog, "fixtures", lambda s, d: few)
    got = {(r.period, r.pid): (r.rating, r.rd) for r in catalog.queries()["RAT18_weekly_ratings"](spark, SMALL).collect()}
    assert sorted({w for w, _ in got}) == weeks_of
    state = spark.createDataFrame([], "pid bigint, mu double, phi double, sigma double, absent int")
    for w in weeks_of:
        rows = ratings.rate_period(state, few.where(F.col("yyyyww") == w)).collect()
        assert {p for k, p in got if k == w} == {r.pid for r in rows}
        assert all(got[w, r.pid] == pytest.approx((1500 + scoring.SCALE * r.mu, scoring.SCALE * r.phi)) for r in rows)
        state = spark.createDataFrame(rows, state.schema)
