import random

import pytest
from pyspark.sql import functions as F

from ladderworks.operators import ratings, search
from ladderworks.operators.segments import penalised_segments
from test_ratings import MATCH, Engine, season

WEEKS = [202001, 202002, 202004, 202005, 202007, 202010, 202011, 202012]


def same(got, want):
    return set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_pass_rates_as_separate_runs(spark):
    frame = spark.createDataFrame(season(5, WEEKS), MATCH)
    engines = search.configurations({"rd": [200.0, 300.0], "tau": [0.3, 0.8], "decay": [0.0, 3.0]}, Engine(grace=1))
    assert len(engines) == 8 and len(search.configurations(search.GRID)) == 27
    whole = {(r.config, r.week, r.pid): (r.mu, r.phi, r.sigma, r.seen) for r in ratings.rated_weeks(frame, engines, chain=3).collect()}
    for c in (0, 5, 7):
        alone = {(c, r.week, r.pid): (r.mu, r.phi, r.sigma, r.seen) for r in ratings.weekly_states(frame, engines[c]).collect()}
        assert same(alone, {k: v for k, v in whole.items() if k[0] == c})


def test_scores_of_held_out_weeks(spark):
    frame = spark.createDataFrame(season(6, WEEKS), MATCH)
    engines = [Engine(), Engine(rd=350.0, tau=0.8)]
    p = search.engine_predictions(frame, engines)
    rows = p.collect()
    assert len(rows) == 2 * frame.count() and all(r.p == 0.5 for r in rows if r.yyyyww == WEEKS[0])
    held = {r.config: r for r in search.held_out(p).collect()}
    for c in (0, 1):
        own = [r for r in rows if r.config == c and r.yyyyww in WEEKS[5:]]
        assert (held[c].weeks, held[c].n) == (3, len(own)) and held[c].brier == pytest.approx(sum((r.p - r.actual) ** 2 for r in own) / len(own))
    rolled = {r.config: r for r in search.rolling_origin(p, train=3, step=2).collect()}
    parts = [[r for r in rows if r.config == 1 and r.yyyyww in WEEKS[k : k + 2]] for k in (3, 5, 7)]
    parts = [x for x in parts if x]
    assert rolled[1].splits == len(parts) and rolled[1].brier == pytest.approx(sum(sum((r.p - r.actual) ** 2 for r in x) / len(x) for x in parts) / len(parts))
    best = search.ranked(search.held_out(p), engines).collect()
    assert sum(r.is_best for r in best) == 1 and {r.tau for r in best} == {0.5, 0.8}


def plain_cuts(values, least=6, jump=2):
    """Every admissible place in turn, all earlier ones tried."""
    n, mean = len(values), sum(values) / len(values)
    pen = max(5 * sum((v - mean) ** 2 for v in values) / n, 80)
    s, q = [0.0], [0.0]
    for v in values:
        s.append(s[-1] + v - mean)
        q.append(q[-1] + (v - mean) ** 2)
    error = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    best = {0: (0.0, [0])}
    for b in [k for k in range(least, n, jump)] + [n]:
        tried = [(best[t][0] + error(t, b) + pen, t) for t in best if t <= b - least]
        if tried:
            f, t = min(tried)
            best[b] = (f, best[t][1] + [b])
    return best[n][1]


def test_penalised_segments_against_a_plain_programme(spark):
    r = random.Random(7)
    series = {}
    for k in range(200):
        level, out = 1500.0, []
        for _ in range(r.randint(30, 90)):
            if r.random() < 0.06:
                level += r.choice([-1, 1]) * r.uniform(5, 80)
            out.append(round(level + r.gauss(0, r.choice([1, 6])), 3))
        series[k] = out
    frame = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "pid int, week int, rating double").repartition(4)
    got = {}
    for x in penalised_segments(frame, "pid", "week", "rating").collect():
        got[x.pid, x.segment] = (x.start, x.end, x.n, x.mean)
    want = {}
    for k, vs in series.items():
        if len(vs) >= 36:
            cuts = plain_cuts(vs)[:9]
            want |= {(k, j): (a, b - 1, b - a, sum(vs[a:b]) / (b - a)) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1)}
    assert same(got, want) and any(j > 3 for _, j in want)


def test_elite_weeks(spark):
    p = spark.createDataFrame([(5, 1, 2, 0.7, 1.0), (5, 3, 4, 0.4, 0.5), (5, 1, 9, 0.6, 0.0)], "yyyyww int, home_club_id bigint, away_club_id bigint, p double, actual double")
    before = spark.createDataFrame([(5, k, 1500.0 + 10 * k) for k in range(1, 5)], "week int, pid bigint, rating double")
    ranks = spark.createDataFrame([(5, k, k) for k in range(1, 5)], "week int, pid bigint, rank bigint")
    r = search.elite_weeks(p, before, ranks, top=1).collect()
    assert [(x.week, x.n) for x in r] == [(5, 2)] and r[0].model_brier == pytest.approx((0.09 + 0.01) / 2)  # 4 is the best, 1 the first
    assert r[0].rank_accuracy == 1.0 and search.elite_weeks(p.where(F.lit(False)), before, ranks).collect() == []
