"""Queries that run the engine in earnest, try settings, compare with an external ranking and cut series by a penalty."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderworks.operators import connectivity, ratings, search
from ladderworks.functions.scoring import score
from ladderworks.operators.keeping import kept, stored
from ladderworks.operators.segments import penalised_segments
from ladderworks.plans import serving
from ladderworks.plans.common import layer_of, rounded, sql, weekly
from ladderworks.sources.fixtures import clubs, fixtures

_TRIALS = 20


def _run(engine):
    def query(s, d):
        return ratings.ratings_of(ratings.weekly_states(fixtures(s, d), engine), engine).withColumnRenamed("week", "period")

    return query


continent, country = _run(ratings.CONTINENT), _run(ratings.COUNTRY)


def holdout(s, d):
    """The engine's defaults and the settings of its two kinds of runs, scored on the last weeks."""
    engines = [ratings.Engine(), ratings.CONTINENT, ratings.COUNTRY]
    return rounded(search.held_out(search.engine_scores(fixtures(s, d), engines)), 6)


def rolling(s, d):
    engines = [ratings.Engine(), ratings.CONTINENT, ratings.COUNTRY]
    return rounded(search.rolling_origin(search.engine_scores(fixtures(s, d), engines)), 6)


def grid(s, d):
    """All 27 settings of the grid in one pass over the weeks."""
    engines = search.configurations(search.GRID)
    return rounded(search.ranked(search.held_out(search.engine_scores(fixtures(s, d), engines)), engines), 6)


def connectivity_trials(s, d):
    """Settings of the connectivity layer tried on fixed ratings (the stand-in)."""
    f = stored(fixtures(s, d))
    w, edges = layer_of(f, clubs(s, d))
    # Parts have a row wherever ratings have, so a side without earlier ones has no rating before the match either.
    matches = f.select("result_id", "yyyyww", "league_code", "home_club_id", "away_club_id", score(F.col("home_team_goals"), F.col("away_team_goals")).alias("actual"))
    found = search.connectivity_search(matches, connectivity.parts(w, edges), search.sampled_settings(_TRIALS))
    out = rounded(found, 6)
    return out.withColumn("is_best", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mae", "trial")) == 1)  # one row a trial


def elite(s, d):
    """The stand-in against a ranking by goals so far, both as they were before the week, over matches of the best 20 of either."""
    f = kept(fixtures(s, d))
    strength = kept(ratings.running_strength(f))
    goals = ratings.both_sides(f, ["yyyyww"]).groupBy(F.col("yyyyww").alias("week"), "pid").agg(F.sum(F.col("goals") - F.col("conceded")).alias("lead"))
    so_far = goals.withColumn("lead", F.sum("lead").over(Window.partitionBy("pid").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)))
    before = serving.known_before(strength.join(so_far, ["week", "pid"]), ["rating", "lead"])
    # A place is one more than the clubs of a greater lead: they are counted by lead, so few rows are sorted for a week.
    levels = before.groupBy("week", "lead").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("week").orderBy(F.desc("lead")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = before.select("week", "pid", "lead").join(levels.select("week", "lead", (F.coalesce(above, F.lit(0)) + 1).alias("rank")), ["week", "lead"]).select("week", "pid", "rank")
    p = serving.predictions(f, strength).withColumnRenamed("expected", "p")
    return rounded(search.elite_weeks(p, before.select("week", "pid", F.round("rating", 6).alias("rating")), ranks, 20))


def penalised(s, d):
    return rounded(penalised_segments(weekly(s, d).withColumn("rating", F.round("rating", 6)), "pid", "week", "rating"), 4)


QUERIES = {
    "RAT18_continent": continent, "RAT18_country": country, "EV02_holdout": holdout, "EV03_engine_rolling": rolling, "EV04_engine_grid": grid, "EV09_connectivity_search": connectivity_trials, "EV10_elite": elite, "TS04_penalised_segments": penalised,
}


def oracle_sql() -> dict[str, str]:
    table = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"{v!r}::DOUBLE" for v in t.values()) + ")" for t in search.sampled_settings(_TRIALS))
    return {
        "EV09_connectivity_search": sql("fcbsepg", f""", tr(trial, {', '.join(search.RANGES)}) AS (VALUES {table}),
cn AS (SELECT week, own AS community, sum(m) AS external, CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-15)) / ln(count(*)) ELSE 0 END AS community_norm FROM cp GROUP BY ALL),
pa AS (SELECT j.week, pid, rating, rd, volume, h_norm, external, community_norm, avg(rating) OVER (PARTITION BY j.week) AS all_mean, avg(rating) OVER (PARTITION BY j.week, j.community) AS own_mean FROM j LEFT JOIN cn ON j.week = cn.week AND j.community = cn.community),
sd AS (SELECT result_id, yyyyww, league_code, actual, home_club_id AS pid, home_pre AS pre, 1 AS sign FROM p UNION ALL SELECT result_id, yyyyww, league_code, actual, away_club_id, away_pre, -1 FROM p),
mt AS (SELECT sd.*, pa.week, rating, rd, volume, h_norm, external, community_norm, all_mean, own_mean FROM sd ASOF LEFT JOIN pa ON sd.pid = pa.pid AND sd.yyyyww > pa.week),
t0 AS (SELECT mt.*, tr.*, coalesce(volume / (volume + half_life), 0) AS vt2 FROM mt CROSS JOIN tr),
t1 AS (SELECT *, greatest(direct_floor, least(1, blend * (direct_floor + (1 - direct_floor) * coalesce(h_norm, 0) * vt2) + (1 - blend) * (community_floor + (1 - community_floor) * coalesce(community_norm * external / (external + half_life), 0)))) AS eff FROM t0),
t2 AS (SELECT *, sqrt(rd * rd + pow(rd_scale * pow(1 - eff, rd_power), 2)) AS total FROM t1),
t3 AS (SELECT *, greatest(trust_floor, least(1, trust_floor + (1 - trust_floor) * eff * vt2 / (1 + total / trust_rd))) AS share, baseline_blend * all_mean + (1 - baseline_blend) * own_mean AS base FROM t2),
t4 AS (SELECT trial, result_id, league_code, actual, sum(sign * coalesce(CASE WHEN week IS NULL THEN NULL WHEN rating <= base THEN rating ELSE base + share * (rating - base) END, pre)) AS gap FROM t3 GROUP BY ALL),
t5 AS (SELECT trial, league_code, abs(1 / (1 + pow(10.0::DOUBLE, -gap / 400)) - actual) AS error FROM t4),
t6 AS (SELECT trial, count(*) AS n, round(avg(error), 6) AS mae, round(avg(error) FILTER (WHERE league_code = 'UCL'), 6) AS continental_mae FROM t5 GROUP BY trial)
SELECT *, row_number() OVER (ORDER BY mae, trial) = 1 AS is_best FROM t6"""),
        "EV10_elite": sql("fbsp", """, gl AS (SELECT week, pid, sum(lead) OVER (PARTITION BY pid ORDER BY week) AS lead FROM (SELECT yyyyww AS week, pid, sum(goals - conceded) AS lead FROM b GROUP BY ALL)),
hl AS (SELECT s.pid, round(rating, 6) AS rating, lead, s.week AS since, coalesce(lead(s.week) OVER (PARTITION BY s.pid ORDER BY s.week), 999999) AS stop FROM s JOIN gl USING (week, pid)),
kb AS (SELECT k.week, pid, rating, rank() OVER (PARTITION BY k.week ORDER BY hl.lead DESC) AS rank, row_number() OVER (PARTITION BY k.week ORDER BY rating DESC, pid) AS place FROM (SELECT DISTINCT week FROM s) k JOIN hl ON k.week > since AND k.week <= stop),
ft AS (SELECT week, CASE WHEN count(*) >= 10 THEN regr_intercept(rating, ln(rank)) ELSE 3000 END AS a0, CASE WHEN count(*) >= 10 THEN regr_slope(rating, ln(rank)) ELSE -160 END AS b0 FROM kb GROUP BY week),
mm AS (SELECT p.yyyyww AS week, p.expected, p.actual, h.rank AS hr, a.rank AS ar FROM p JOIN kb h ON h.week = p.yyyyww AND h.pid = p.home_club_id JOIN kb a ON a.week = p.yyyyww AND a.pid = p.away_club_id WHERE h.rank <= 20 OR h.place <= 20 OR a.rank <= 20 OR a.place <= 20),
qq AS (SELECT mm.*, 1 / (1 + exp(-(b0 * (ln(hr) - ln(ar)) / 173.7178::DOUBLE) / sqrt(1 + 3 * pow(250 / 173.7178::DOUBLE, 2) / pow(pi(), 2)))) AS q FROM mm JOIN ft USING (week))
SELECT week, count(*) AS n, round(avg(-(actual * ln(expected) + (1 - actual) * ln(1 - expected))), 5) AS model_log_loss, round(avg(pow(expected - actual, 2)), 5) AS model_brier, round(avg(CASE WHEN actual <> 0.5 THEN ((expected >= 0.5) = (actual = 1))::INT END), 5) AS model_accuracy,
  round(avg(-(actual * ln(q) + (1 - actual) * ln(1 - q))), 5) AS rank_log_loss, round(avg(pow(q - actual, 2)), 5) AS rank_brier, round(avg(CASE WHEN actual <> 0.5 THEN ((q >= 0.5) = (actual = 1))::INT END), 5) AS rank_accuracy FROM qq GROUP BY week"""),
    }
