import math
import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from ladderworks.operators import ratings, upsert
from ladderworks.operators.ratings import COUNTRY, SCALE, Engine

MATCH = "result_id bigint, home_club_id bigint, away_club_id bigint, home_team_goals int, away_team_goals int, yyyyww int"


def sunday(w):
    return date.fromisocalendar(w // 100, w % 100, 7)


def between(a, b):
    return max(0, (sunday(b) - sunday(a)).days // 7)


def g(phi):
    return 1 / math.sqrt(1 + 3 * phi * phi / math.pi**2)


def root(sigma, phi, v, delta, tau):
    """The volatility equation by halving, to full precision."""
    a = math.log(sigma * sigma)

    def f(x):
        e = math.exp(x)
        return e * (delta * delta - phi * phi - v - e) / (2 * (phi * phi + v + e) ** 2) - (x - a) / tau**2

    low, high = a - 60, a + 60
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return math.exp(low / 2)


def fold(matches, e, calendar=()):
    """The engine week by week in plain Python: {(week, pid): (mu, phi, sigma, seen)}."""
    state, out, before = {}, {}, None
    for week in sorted({m[5] for m in matches} | set(calendar)):
        own = [m for m in matches if m[5] == week]
        elapsed = between(before, week) if before else 0
        before = week
        if not own:
            continue
        players = {p for m in own for p in m[1:3]}
        for p in players:
            if p not in state or (e.reseed_after and between(state[p][3], week) >= e.reseed_after):
                state[p] = (0.0, e.rd / SCALE, e.sigma, week)
            mu, phi, sigma, seen = state[p]
            state[p] = (mu, math.sqrt(phi**2 + between(seen, week) * (sigma**2 + e.drift**2)), sigma, seen)
        for p in set(state) - players:
            mu, phi, sigma, seen = state[p]
            now = between(seen, week)
            lost = max(0, now - e.grace) - max(0, now - elapsed - e.grace)
            state[p] = (mu - e.decay / SCALE * lost, phi, sigma, seen)
        pre = dict(state)
        games = defaultdict(list)
        for _, a, b, x, y, _ in own:
            s = 1.0 if x > y else 0.0 if x < y else 0.5
            games[a].append((b, s))
            games[b].append((a, 1 - s))
        for p, played in games.items():
            mu, phi, sigma, _ = pre[p]
            info = surprise = 0.0
            for o, s in played:
                w, lead = g(pre[o][1]), SCALE * (pre[o][0] - mu)
                chance = 1 / (1 + math.exp(-w * (mu - pre[o][0])))
                part = w * (s - chance)
                info += w * w * chance * (1 - chance) * (1 / (1 + math.exp(-lead / e.info_scale)) if e.info_scale else 1)
                if e.upset_max and e.upset_k and part > 0:
                    part *= e.upset_max / (1 + (e.upset_max - 1) * math.exp(-e.upset_k * lead))
                surprise += part
            info, surprise = info / math.sqrt(len(played)), surprise / math.sqrt(len(played))
            new = min(e.max_sigma, root(sigma, phi, 1 / info, surprise / info, e.tau))
            phi = 1 / math.sqrt(1 / (phi**2 + new**2) + info)
            state[p] = (mu + phi * phi * surprise, phi, new, week)
        out |= {(week, p): s for p, s in state.items()}
    return out


def season(seed, weeks, players=9):
    r = random.Random(seed)
    return [(k, *r.sample(range(1, players + 1), 2), r.randint(0, 3), r.randint(0, 3), r.choice(weeks)) for k in range(40)]


ENGINES = [Engine(), COUNTRY, Engine(decay=3.0, grace=2, reseed_after=9, drift=0.02), Engine(upset_max=1.8, upset_k=0.01, info_scale=120.0, tau=0.3)]


@pytest.mark.parametrize("e", ENGINES)
def test_weeks_against_a_plain_fold(spark, e):
    weeks = [202049, 202052, 202101, 202106, 202120]
    matches = [m for m in season(len(str(e)), weeks) if not (m[5] in (202052, 202106) and 3 in m[1:3])]
    empty = [202103, 202110]
    got = {(r.week, r.pid): (r.mu, r.phi, r.sigma, r.seen) for r in ratings.weekly_states(spark.createDataFrame(matches, MATCH), e, calendar=empty).collect()}
    want = fold(matches, e, empty)
    assert set(got) == set(want)
    assert all(got[k][:3] == pytest.approx(want[k][:3], abs=2e-6) and got[k][3] == want[k][3] for k in want)


def test_worked_weeks(spark):
    rows = [(1, 1, 2, 1, 0, 202510), (2, 3, 4, 1, 1, 202510), (3, 3, 1, 2, 0, 202511)]
    e = Engine(rd=350.0, tau=0.4)
    got = {(r.week, r.pid): r for r in ratings.ratings_of(ratings.weekly_states(spark.createDataFrame(rows, MATCH), e), e).collect()}
    want = {(202510, 1): (1662.3109, 290.3190, 0.05999979), (202510, 2): (1337.6891, 290.3190, 0.05999979), (202510, 3): (1500, 290.3190, 0.05999934), (202511, 1): (1484.3619, 251.3983, 0.06000017), (202511, 3): (1677.9490, 251.3983, 0.05999971), (202511, 4): (1500, 290.3190, 0.05999934)}
    for key, (rating, rd, sigma) in want.items():
        assert (got[key].rating, got[key].rd) == pytest.approx((rating, rd), abs=1e-3) and got[key].sigma == pytest.approx(sigma, abs=1e-7)


def test_seeds_and_two_phases(spark):
    matches = season(3, [202001, 202004, 202010, 202015])
    frame = spark.createDataFrame(matches, MATCH)
    seeds = spark.createDataFrame([(1, 1800.0), (2, 1300.0), (99, 2000.0)], "pid bigint, rating double")
    first = ratings.weekly_states(frame.where("yyyyww = 202001"), seeds=seeds).collect()
    plain = {k[1]: v for k, v in fold([m for m in matches if m[5] == 202001], Engine()).items()}
    assert any(abs(r.mu - plain[r.pid][0]) > 0.5 for r in first) and 99 not in {r.pid for r in first}
    whole = fold(matches, Engine())
    later = {(r.week, r.pid): r.mu for r in ratings.two_phases(frame, 202010).collect()}
    assert set(w for w, _ in later) == {202010, 202015} and all(later[k] == pytest.approx(whole[k][0], abs=2e-6) for k in later)
    grouped = ratings.by_group(frame.withColumn("country", F.when(F.col("home_club_id") < 5, "A").otherwise("B")), "country", ratings.weekly_states, ["A", "B"])
    assert {r.country for r in grouped.select("country").distinct().collect()} == {"A", "B"}
    assert ratings.weekly_states(frame.limit(0)).collect() == []


@pytest.mark.parametrize("size", [2, 3, 4, 7])
def test_remaps_in_cycles_end_at_the_smallest(spark, size):
    ring = [(10 + k, 10 + (k + 1) % size) for k in range(size)]
    pairs = spark.createDataFrame([*ring, (50, 12 if size > 2 else 11), (60, 50), (1, 2), (2, 3), (7, 7), (8, None)], "old bigint, new bigint")
    got = {r.old: r.new for r in upsert.closed_map(pairs).collect()}
    assert got == {10 + k: 10 for k in range(1, size)} | {50: 10, 60: 10, 1: 3, 2: 3}


def test_long_remap(spark):
    pairs = spark.range(1, 200).selectExpr("id AS old", "id - 1 AS new")
    assert {r.new for r in upsert.closed_map(pairs).collect()} == {0}
    assert upsert.closed_map(pairs.limit(0)).collect() == []
