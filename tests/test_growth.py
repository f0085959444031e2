"""Work that must not grow faster than the input: shuffles and rows of plans."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from ladderworks.operators import connectivity, ratings, search, week_steps
from test_ratings import MATCH, Engine, season

EDGE = "match_date date, weight double, pid bigint, opponent bigint, own string, other string, cross boolean"
WEEKS = [201801, 202001, 202005, 202030]


def edges(spark):
    days = [date(2015, 1, 5) + timedelta(11 * k) for k in range(190)]
    rows = [(d, 1.0 if k % 5 else 0.05, a, b, f"{'ABC'[a % 3]}|x", f"{'ABC'[b % 3]}|x", a % 3 != b % 3) for k, d in enumerate(days) for a, b in ((k % 7, (k * 3 + 1) % 7), ((k * 3 + 1) % 7, k % 7)) if a != b]
    return spark.createDataFrame(rows, EDGE)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def weeks_of(spark, weeks):
    return spark.createDataFrame([(w,) for w in weeks], "week int")


def test_windows_of_players_are_shuffled_once(spark):
    """Days, events and running sums each had a shuffle of their own: twelve before. Now two, and two for the join by week and player."""
    assert plan(connectivity.direct_connectivity(edges(spark), weeks_of(spark, WEEKS))).count("Exchange hashpartitioning(") <= 4


def test_one_week_reads_its_window_alone(spark):
    """Levels of all days were made, whatever the weeks asked for; values stay those of a run over all weeks."""
    e, s = edges(spark), connectivity.Settings()
    alone = connectivity._levels(e, ["pid", "own"], s, connectivity.Calendar.of(weeks_of(spark, [202030])))
    assert [r.day for r in alone.select("day").distinct().collect()] == [date(2020, 7, 26)]
    inside = e.where("match_date > DATE '2018-07-29' AND match_date <= DATE '2020-07-26'").groupBy("pid", "own").agg(F.sum("weight"), F.count("*"))
    assert sorted((r[0], r[1], round(r.m, 9), r.n) for r in alone.collect()) == sorted((r[0], r[1], round(r[2], 9), r[3]) for r in inside.collect())
    for f in (connectivity.direct_connectivity, connectivity.primary_community, connectivity.community_connectivity):
        rounded = lambda frame: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect())
        assert rounded(f(e, weeks_of(spark, [202030]))) == rounded(f(e, weeks_of(spark, WEEKS)).where("week = 202030"))
    assert connectivity.direct_connectivity(e, weeks_of(spark, [])).collect() == []


def test_trials_meet_matches_after_the_last_shuffle_of_these(spark):
    """A row for each trial and side went through a shuffle by match."""
    matches = spark.createDataFrame([(1, 202005, "UCL", 1, 2, 1500.0, 1600.0, 1.0), (2, 202030, "D3", 2, 3, 1600.0, 1400.0, 0.5)], "result_id bigint, yyyyww int, league_code string, home_club_id bigint, away_club_id bigint, home_pre double, away_pre double, actual double")
    parts = spark.createDataFrame([(202001, 2, 1700.0, 60.0, 10.0, 0.5, 4.0, 0.3, 1500.0, 1550.0)], "week int, pid bigint, " + ", ".join(f"{c} double" for c in search.PARTS))
    found = search.connectivity_search(matches, parts, search.sampled_settings(3))
    assert "hashpartitioning(trial#" in plan(found) and not any("trial#" in x and "result_id#" in x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x)
    rows = {r.trial: r for r in found.collect()}
    assert set(rows) == {1, 2, 3} and all(r.n == 2 and r.continental_mae is not None for r in rows.values())


def test_packed_weeks_pass_between_buckets(spark, monkeypatch):
    """Few rows are shuffled, whatever the number of players; several buckets give what one does."""
    matches = spark.createDataFrame(season(8, [202001, 202002, 202004, 202010, 202015]), MATCH)
    values = lambda: sorted((r.config, r.week, r.pid, round(r.mu, 9), round(r.phi, 9), r.seen, r.start_mu and round(r.start_mu, 9)) for r in ratings.rated_weeks(matches, [Engine(), ratings.COUNTRY], chain=2).collect())
    one = values()
    monkeypatch.setattr(ratings, "BUCKET", 5)
    assert values() == one and len(one) > 40
    rows = [(0, k, 0, 0.1, 0.2, 0.3, 0.0) for k in range(1000)]
    columns = dict(zip(("config", "pid", "week", "x", "y", "z", "start"), map(np.array, zip(*rows, strict=True)), strict=True))
    start = week_steps.rows_of_table([(0, week_steps.STATE, 0, week_steps.packed(week_steps.STATE, columns))])
    settings = {f: np.array([float(getattr(Engine(), f))]) for f in Engine.__dataclass_fields__}
    assert week_steps.Bucket(start, settings, 1).table().num_rows == 1


def test_what_matches_read_is_a_row_a_player(spark):
    """Every configuration had a row of its own for each side, and all met the matches."""
    matches = spark.createDataFrame(season(9, [202001, 202003, 202009]), MATCH)
    engines = [Engine(), Engine(rd=300.0), ratings.COUNTRY]
    got = {(r.week, r.pid): r for r in ratings.start_values(matches, engines, chain=2).collect()}
    want = [r for r in ratings.rated_weeks(matches, engines).collect() if r.start_mu is not None]
    assert len(want) == 3 * len(got) and all(abs(got[r.week, r.pid].start_mu[r.config] - r.start_mu) < 1e-9 and abs(got[r.week, r.pid].start_phi[r.config] - r.start_phi) < 1e-9 for r in want)


def test_tasks_of_fixtures_grow_with_the_lines(spark, monkeypatch):
    """A larger table made larger tasks, not more of them, and was shuffled twice."""
    from ladderworks.sources import fixtures

    path = "/root/testdata/sf0.001"
    before = sorted(map(str, fixtures.fixtures(spark, path).collect()))
    monkeypatch.setattr(fixtures, "ROWS", 500)
    found = fixtures.fixtures(spark, path)
    assert sorted(map(str, found.collect())) == before and "hashpartitioning(l_orderkey" in plan(found) and "REPARTITION_BY_NUM" in plan(found)
    assert fixtures.dealt(fixtures.table(spark, path, "lineitem"), "l_orderkey").rdd.getNumPartitions() > 4


def test_latest_week_makes_no_other_weeks(spark, monkeypatch):
    """Queries of the latest week made, shuffled and kept the ratings of all weeks, and the matches of all years with communities."""
    from ladderworks.operators.asof import snapshot
    from ladderworks.plans import attached, common, history
    from ladderworks.sources.fixtures import clubs, fixtures

    path = "/root/testdata/sf0.001"
    weekly, all_edges = common.layer(spark, path)
    now, edges, final = common.layer_now(spark, path)
    values = lambda frame: sorted(map(str, frame.collect()))
    assert values(now) == values(snapshot(weekly).select("week", "pid", "rating", "rd")) and now.count() > 0
    assert values(final) == values(history.serving.latest(weekly).select("pid", "week", "rating", "rd"))
    assert 0 < edges.count() < all_edges.count()
    sums = plan(ratings.final_strength(fixtures(spark, path)))
    assert "Window" not in sums and "hashpartitioning(yyyyww" not in sums
    assert connectivity.within(connectivity.weighted_fixtures(fixtures(spark, path), clubs(spark, path)), weeks_of(spark, [])).count() == 0

    def refused(*args, **more):
        raise AssertionError("ratings of all weeks")

    want = values(connectivity.adjust(snapshot(weekly), all_edges).select("pid", "opponents", "community", *[F.round(c, 9) for c in ("trust", "adjusted")]))
    assert values(connectivity.adjust(now, edges).select("pid", "opponents", "community", *[F.round(c, 9) for c in ("trust", "adjusted")])) == want
    monkeypatch.setattr(ratings, "running_strength", refused)
    for query in (history.deciles, history.diagnostics, history.communities_now, history.high_low, history.reasonableness, history.power_scores, attached.with_connectivity):
        assert query(spark, path).count() > 0


def test_primary_communities_are_summed_up_by_hash(spark):
    """The weeks of all of a player's communities were sorted. Of equal weights the first in order wins, and none comes first of all."""
    assert "SortAggregate" not in plan(connectivity.primary_community(edges(spark), weeks_of(spark, WEEKS)))
    day = date(2020, 7, 20)
    rows = [(day, 1.0, 1, 9, "B|x", "Z", False), (day, 0.5, 1, 9, "A|x", "Z", False), (day, 0.5, 1, 8, "A|x", "Z", False), (day, 1.0, 2, 9, "B|x", "Z", False), (day, 0.999999, 2, 9, "A|x", "Z", False), (day, 1.0, 3, 9, None, "Z", False), (day, 1.0, 3, 9, "A|x", "Z", False)]
    for weeks in ([202030], [202030, 202031]):
        found = connectivity.primary_community(spark.createDataFrame(rows, EDGE), weeks_of(spark, weeks)).where("week = 202030")
        assert {r.pid: r.community for r in found.collect()} == {1: "A|x", 2: "B|x", 3: None}


def test_scores_are_summed_up_where_a_player_is_told(spark, monkeypatch):
    """What matches read was carried through the chain, stored and joined to them twice. Matches without a score or a side, too."""
    rows = [*season(11, [202001, 202003, 202009]), (90, 1, 2, None, 1, 202003), (91, 1, 77, None, 1, 202003), (92, None, 2, 1, 1, 202003), (93, 1, 2, None, 1, 202050)]
    matches, engines = spark.createDataFrame(rows, MATCH), [Engine(), Engine(rd=300.0), ratings.COUNTRY]
    values = lambda frame: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.select("config", "yyyyww", *week_steps.SUMS).collect())
    p = search.engine_predictions(matches, engines)
    want = values(p.groupBy("config", "yyyyww").agg(*search.evaluate.sums(F.col("p"), F.col("actual"))))
    assert len(want) == 9 and any(r[2] > r[3] for r in want)
    monkeypatch.setattr(ratings, "BUCKET", 5)
    monkeypatch.setattr(ratings, "predicted", None)
    found = search.engine_scores(matches, engines)
    assert values(found) == want and "Join" not in plan(found)
    scores = lambda frame: sorted(map(str, search.held_out(frame).select("config", "weeks", "n", F.round("log_loss", 9)).collect()))
    assert scores(found) == scores(p)


def test_each_bucket_has_a_task(spark):
    """Of eight buckets three shared a task, and three tasks had none."""
    for count in (1, 8, 12, 100):
        names = ratings.bucket_names(spark, count)
        frame = spark.createDataFrame([(n,) for n in names], "bucket int").repartition(count, "bucket")
        assert len({*names}) == count and frame.select(F.spark_partition_id()).distinct().count() == count


def test_diffusion_shuffles_blocks_once(spark, monkeypatch):
    """Edges and states were shuffled anew for each step, and kept after each."""
    e, weekly = edges(spark), spark.createDataFrame([(w, k) for w in WEEKS for k in range(7)], "week int, pid bigint")
    plans, whole, s = [], connectivity.kept, connectivity.Settings(steps=4)
    monkeypatch.setattr(connectivity, "kept", lambda frame: (out := whole(frame), plans.append(plan(frame)))[0])
    values = lambda: {(r.week, r.pid): (round(r.seed, 9), round(r.comparability, 9)) for r in connectivity.diffuse(weekly, e, s).collect()}
    one = values()
    assert len(plans) == 1 and sum("pythonUDF" in x or "begin" in x or "Exchange hashpartitioning(part" in x for x in plans[0].splitlines() if "Reused" not in x) > 0
    assert plans[0].count("ReusedExchange") >= s.steps
    monkeypatch.setattr(connectivity, "EDGES", 50)
    assert values() == one and len(one) >= 28


def test_search_makes_no_more_than_its_parts(spark, monkeypatch):
    """Numbers of opponents and adjusted ratings were made that nothing reads; earlier ratings were looked up twice, matches were put
    together by sorts, and formulas evaluated for each match and trial in turn."""
    from ladderworks.plans import common, trials

    path, seen, refused = "/root/testdata/sf0.001", [], lambda *a, **k: (_ for _ in ()).throw(AssertionError("not needed"))
    weekly, e = common.layer(spark, path)
    s, rows = connectivity.Settings(), lambda frame: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in frame.collect())
    own = ["week", "pid", "rating", "rd", "community", "volume", "h_norm"]
    assert rows(connectivity.parts(weekly, e).select(*own)) == rows(connectivity.adjust(weekly, e).select(*own))
    outer = connectivity.community_connectivity(e, weekly, s).selectExpr("week", "community", "external", f"(community_connectivity - {s.community_floor}) / {1 - s.community_floor} * (external + {s.half_life}) / external AS community_norm")
    assert rows(connectivity.parts(weekly, e).where("external IS NOT NULL").select(*outer.columns).distinct()) == rows(outer.join(connectivity.parts(weekly, e).select("week", "community").distinct(), ["week", "community"]))
    for name in ("_opponents", "adjust"):
        monkeypatch.setattr(connectivity, name, refused)
    monkeypatch.setattr(trials.serving, "predictions", refused)
    search_of = search.connectivity_search
    monkeypatch.setattr(search, "connectivity_search", lambda *a: (seen.append(search_of(*a)), seen[0])[1])
    assert trials.connectivity_trials(spark, path).count() == 20 and "SortAggregate" not in plan(seen[0]) and "NestedLoop" not in plan(seen[0])
