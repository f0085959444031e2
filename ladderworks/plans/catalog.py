"""Every query by name over the star-schema tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderworks.functions import names, scoring, weeks
from ladderworks.operators import connectivity, evaluate, ratings, upsert
from ladderworks.plans import attached, history, narratives, resolution, scalars, serving, stored, tables, trials
from ladderworks.plans.common import layer as _layer
from ladderworks.plans.common import r as _r
from ladderworks.plans.common import rounded as _rounded
from ladderworks.plans.common import sql as _sql
from ladderworks.plans.common import weekly as _weekly
from ladderworks.sources.fixtures import clubs, fixtures, table
from ladderworks.streaming import matches as streams

Query = Callable[[SparkSession, str], DataFrame]


def src_fixtures(s, d):
    return fixtures(s, d)


def prj_results(s, d):
    h, a = F.col("home_team_goals"), F.col("away_team_goals")
    rows = fixtures(s, d).join(clubs(s, d).select(F.col("club_id").alias("home_club_id"), "country_name"), "home_club_id", "left")
    return rows.select("result_id", scoring.score(h, a).alias("home_score"), scoring.letter(h, a).alias("result"), F.coalesce(F.nullif(F.trim("league_code"), F.lit("")), "country_name").alias("competition"), F.concat_ws("_", F.date_format("match_date", "yyyyMMdd"), "home_club_id", "away_club_id").alias("event_id"))


def dt_weeks(s, d):
    w = F.col("yyyyww")
    rows = fixtures(s, d).select("match_date", "yyyyww").distinct()
    year, number = weeks.split_week(w)
    return rows.select("match_date", "yyyyww", year.alias("year"), number.alias("number"), weeks.week_sunday(w).alias("sunday"), weeks.week_monday(w).alias("monday"), weeks.weeks_between(w, F.lit(200001)).alias("weeks_to_2000"), weeks.season_of(F.col("match_date")).alias("season"))


def str_names(s, d):
    return table(s, d, "part").select("p_partkey", names.normal_name(F.concat(F.lit(" FC "), F.initcap("p_name"), F.lit(" & Sons' SC"))).alias("key"))


def jsn_props(s, d):
    rows = table(s, d, "events").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("without"))


def mth_ranks(s, d):
    r = F.col("s_suppkey")
    return _rounded(table(s, d, "supplier").select("s_suppkey", scoring.rank_to_rating(r).alias("seed"), scoring.elo_expected(r.cast("double")).alias("expected"), scoring.saturating(r.cast("double"), 24.0).alias("trust"), scoring.g(r / 100.0).alias("g")))


def agg_country_weeks(s, d):
    return _rounded(serving.country_weeks(_weekly(s, d)))


def q_country_summaries(s, d):
    return _rounded(serving.country_summaries(_weekly(s, d)))


def q_countries(s, d):
    return _weekly(s, d).select(F.lower("country_name").alias("country")).where("country <> 'international'").distinct()


def win_ladder(s, d):
    return _rounded(serving.ladder(_weekly(s, d)))


def win_movement(s, d):
    return _rounded(serving.movement(_weekly(s, d)))


def top_snapshot(s, d):
    return _rounded(serving.top_snapshot(_weekly(s, d), 20, 5).select("pid", "club_name", "week", "rating", "rd"))


def top_by_country(s, d):
    return _rounded(serving.top_by_country(_weekly(s, d)))


def q_top_series(s, d):
    return _rounded(serving.top_series(_weekly(s, d)))


def flt_active(s, d):
    return serving.active_clubs(fixtures(s, d), [1996, 1997], 5)


def agg_pairs(s, d):
    a, b = F.col("home_club_id"), F.col("away_club_id")
    w = connectivity.match_weight(F.col("league_code"))
    return _rounded(fixtures(s, d).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(w).alias("weight"), F.count("*").alias("n")))


def asof_ratings(s, d):
    f = fixtures(s, d)
    return _rounded(serving.prior_ratings(f, ratings.running_strength(f)))


def snapshot_before(s, d):
    f = fixtures(s, d)
    return _rounded(serving.snapshot_changes(ratings.running_strength(f), f))


def ev_metrics(s, d):
    f = fixtures(s, d)
    rows = serving.predictions(f, ratings.running_strength(f))
    return _rounded(rows.groupBy("league_code").agg(*evaluate.metrics(F.col("expected"), F.col("actual"))))


def ev_calibration(s, d):
    f = fixtures(s, d)
    return _rounded(evaluate.calibration(serving.predictions(f, ratings.running_strength(f)).withColumn("expected", F.round("expected", 9)), "expected", "actual"))


def ev_spearman(s, d):
    return _rounded(evaluate.spearman(_weekly(s, d).withColumns({"rating": F.round("rating", 6), "rd": F.round("rd", 6)}), "country_name", "rating", "rd"))


def q_upsets(s, d):
    f = fixtures(s, d)
    return _rounded(serving.biggest_upsets(serving.predictions(f, ratings.running_strength(f))))


def q_club_matches(s, d):
    return serving.club_matches(fixtures(s, d), clubs(s, d))


def agg_presence(s, d):
    return _rounded(serving.top_presence(_weekly(s, d)))


def agg_extremes(s, d):
    return _rounded(serving.club_extremes(_weekly(s, d)))


def q_map(s, d):
    return _rounded(serving.map_layer(serving.country_summaries(_weekly(s, d))))


def ts_split(s, d):
    return _rounded(evaluate.best_split(_weekly(s, d).withColumn("rating", F.round("rating", 6)), "pid", "week", "rating"), 3)


def ts_trend(s, d):
    return _rounded(evaluate.trend(_weekly(s, d), "pid", "week", "rating"))


def ded_first(s, d):
    return upsert.keep_first(fixtures(s, d), ["match_date", "home_club_id"], [F.desc("home_team_goals"), F.col("result_id")]).select("result_id", "match_date", "home_club_id")


def ups_merge(s, d):
    f = fixtures(s, d).select("match_date", "home_club_id", "away_club_id", "home_team_goals", "away_team_goals")
    keys = ["match_date", "home_club_id", "away_club_id"]
    staged = upsert.keep_first(f.where("match_date >= DATE '1998-01-01'"), keys, [F.col("home_team_goals"), F.col("away_team_goals")])
    return upsert.upsert(f, staged.withColumn("home_team_goals", F.col("home_team_goals") + 1), keys)


def er_closure(s, d):
    """Clubs remapped to the smallest opponent they met, followed to the end."""
    f = fixtures(s, d)
    met = ratings.both_sides(f, []).where("opponent < pid").groupBy(F.col("pid").alias("old")).agg(F.max("opponent").alias("new"))
    return upsert.closed_map(met)


def gc_fixtures(s, d):
    return connectivity.weighted_fixtures(fixtures(s, d), clubs(s, d)).select("result_id", "home_community", "away_community", "weight", "continental")


def gc_adjust(s, d):
    weekly, edges = _layer(s, d)
    return _rounded(connectivity.adjust(weekly, edges).select("week", "pid", "community", "volume", "opponents", "h_norm", "direct", "community_connectivity", "effective", "total_rd", "trust", "baseline", "adjusted"))


def hd_diffusion(s, d):
    weekly, edges = _layer(s, d)
    return _rounded(connectivity.diffuse(weekly, edges), 7)


def rat_sums(s, d):
    return _rounded(ratings.period_sums(fixtures(s, d)))


def rat_years(s, d):
    f = fixtures(s, d).withColumn("year", F.floor(F.col("yyyyww") / 100).cast("int"))
    return ratings.rate_periods(f, "year")


def rat_weeks(s, d):
    """The engine by its own period, the week: the state of every entity after each."""
    return ratings.ratings_of(ratings.weekly_states(fixtures(s, d))).withColumnRenamed("week", "period")


def rat_changes(s, d):
    f = fixtures(s, d)
    return ratings.match_changes(f, ratings.running_strength(f), 3)


def rat_field(s, d):
    """Strength of the field before each week: of the ratings (stand-in) that the matches of the week read."""
    f = fixtures(s, d)
    event = F.concat_ws("_", F.date_format("match_date", "yyyyMMdd"), "home_club_id", "away_club_id")
    before = serving.known_before(ratings.running_strength(f), ["rating", "rd"])
    return _rounded(ratings.field_strength(f.withColumn("event_id", event), before), 4)


def stm_weeks(s, d):
    return _rounded(streams.weekly_tallies(table(s, d, "events").select("ts", F.col("event_type").alias("kind"), "value")), 4)


def stm_spells(s, d):
    return streams.spells(table(s, d, "events").select("ts", F.col("user_id").alias("entity")))


_NAMES: dict[str, Query] = {
    "Q04_country_summaries": q_country_summaries, "SRC_fixtures": src_fixtures, "PRJ05_results": prj_results, "DT01_weeks": dt_weeks, "STR01_names": str_names, "JSN01_props": jsn_props, "MTH05_scales": mth_ranks,
    "AGG01_country_weeks": agg_country_weeks, "Q01_countries": q_countries, "WIN01_ladder": win_ladder, "WIN04_movement": win_movement, "TOP01_snapshot": top_snapshot, "TOP06_by_country": top_by_country, "Q07_top_series": q_top_series,
    "FLT08_active_clubs": flt_active, "AGG06_pairs": agg_pairs, "J08_asof_ratings": asof_ratings, "J10_snapshot_before": snapshot_before, "AGG14_metrics": ev_metrics, "AGG16_calibration": ev_calibration, "AGG20_spearman": ev_spearman,
    "Q10_biggest_upsets": q_upsets, "Q08_club_matches": q_club_matches, "AGG21_presence": agg_presence, "AGG22_extremes": agg_extremes, "Q18_map_layer": q_map, "TS02_best_split": ts_split, "AGG25_trend": ts_trend,
    "DED01_keep_first": ded_first, "UPS_merge": ups_merge, "ER06_closure": er_closure, "GC03_weighted_fixtures": gc_fixtures, "GC15_adjusted": gc_adjust, "HD07_diffusion": hd_diffusion, "RAT11_period_sums": rat_sums, "RAT18_yearly_ratings": rat_years, "RAT18_weekly_ratings": rat_weeks,
    "RAT22_match_changes": rat_changes, "AGG26_field_strength": rat_field, "STM02_weekly_tallies": stm_weeks, "STM04_spells": stm_spells,
}


_MORE = (scalars, tables, history, resolution, trials, attached, stored, narratives)


def queries() -> dict[str, Query]:
    return _NAMES | {k: q for module in _MORE for k, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return _oracles() | {k: q for module in _MORE for k, q in module.oracle_sql().items()}


def _oracles() -> dict[str, str]:
    g = "(1 / sqrt(1 + 3 * pow(250 / 173.7178::DOUBLE, 2) / pow(pi(), 2)))"
    return {
        "SRC_fixtures": _sql("f", "SELECT * FROM f"),
        "PRJ05_results": _sql("fc", "SELECT result_id, CASE WHEN home_team_goals > away_team_goals THEN 1.0 WHEN home_team_goals < away_team_goals THEN 0.0 ELSE 0.5 END::DOUBLE AS home_score, CASE WHEN home_team_goals > away_team_goals THEN 'H' WHEN home_team_goals < away_team_goals THEN 'A' ELSE 'D' END AS result, coalesce(nullif(trim(league_code), ''), country_name) AS competition, strftime(match_date, '%Y%m%d') || '_' || home_club_id || '_' || away_club_id AS event_id FROM f LEFT JOIN c ON club_id = home_club_id"),
        "DT01_weeks": _sql("f", ", d AS (SELECT DISTINCT match_date, yyyyww, (date_trunc('week', make_date(yyyyww // 100, 1, 4))::DATE + ((yyyyww % 100 - 1) * 7 + 6)::INT)::DATE AS sunday FROM f) SELECT match_date, yyyyww, (yyyyww // 100)::INT AS year, (yyyyww % 100)::INT AS number, sunday, (sunday - 6)::DATE AS monday, greatest(0, (DATE '2000-01-09' - sunday) // 7)::INT AS weeks_to_2000, (year(match_date) - (month(match_date) < 7)::INT)::INT AS season FROM d"),
        "STR01_names": "SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(lower(p_name) || ' and sons', '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS key FROM part",
        "JSN01_props": "SELECT event_type, count(*) AS n, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, count(*) FILTER (WHERE props::JSON->>'k' IS NULL) AS without FROM events GROUP BY event_type",
        "MTH05_scales": "SELECT s_suppkey, round(greatest(400, 3000 - 160 * ln(greatest(1, least(s_suppkey, 4000)))), 5) AS seed, round(1 / (1 + pow(10.0::DOUBLE, -s_suppkey / 400)), 5) AS expected, round(s_suppkey / (s_suppkey + 24.0::DOUBLE), 5) AS trust, round(1 / sqrt(1 + 3 * pow(s_suppkey / 100, 2) / pow(pi(), 2)), 5) AS g FROM supplier",
        "AGG01_country_weeks": _sql("fcbsw", "SELECT country_name, week, round(avg(rating), 5) AS mean_rating, round(max(rating), 5) AS max_rating, round(min(rating), 5) AS min_rating, count(DISTINCT pid) AS clubs FROM w GROUP BY ALL"),
        "Q01_countries": _sql("fcbsw", "SELECT DISTINCT lower(country_name) AS country FROM w WHERE lower(country_name) <> 'international'"),
        "Q04_country_summaries": _sql("fcbswl", "SELECT country_name, round(avg(rating), 5) AS mean_rating, round(max(rating), 5) AS max_rating, count(*) AS clubs, first(club_name ORDER BY rating DESC, pid) AS top_club FROM l GROUP BY ALL"),
        "WIN01_ladder": _sql("fcbsw", f"SELECT week, pid, country_name, {_r('rating')}, row_number() OVER (PARTITION BY week ORDER BY rating DESC, pid) AS place, row_number() OVER (PARTITION BY week, country_name ORDER BY rating DESC, pid) AS domestic_place FROM w"),
        "WIN04_movement": _sql("fbs", "SELECT week, pid, round(rating, 5) AS rating, round(coalesce(rating - lag(rating) OVER o, 0), 5) AS change, round(coalesce(rating / lag(rating) OVER o - 1, 0), 5) AS change_share FROM s WINDOW o AS (PARTITION BY pid ORDER BY week)"),
        "TOP01_snapshot": _sql("fcbswl", f"SELECT pid, club_name, week, {_r('rating', 'rd')} FROM l ORDER BY l.rating DESC, pid LIMIT 20 OFFSET 5"),
        "TOP06_by_country": _sql("fcbswl", f"SELECT country_name, row_number() OVER o AS place, pid, club_name, {_r('rating')} FROM l WINDOW o AS (PARTITION BY country_name ORDER BY l.rating DESC, pid) QUALIFY row_number() OVER o <= 5"),
        "Q07_top_series": _sql("fcbswl", f"SELECT country_name, pid, week, {_r('rating')} FROM w WHERE pid IN (SELECT pid FROM l QUALIFY row_number() OVER (PARTITION BY country_name ORDER BY rating DESC, pid) <= 3)"),
        "FLT08_active_clubs": _sql("fb", "SELECT pid, count(*) FILTER (WHERE yyyyww // 100 = 1996) AS y1996, count(*) FILTER (WHERE yyyyww // 100 = 1997) AS y1997 FROM bs GROUP BY pid HAVING y1996 > 5 AND y1997 > 5"),
        "AGG06_pairs": _sql("f", "SELECT least(home_club_id, away_club_id) AS a, greatest(home_club_id, away_club_id) AS b, round(sum(CASE WHEN contains(league_code, 'FRIENDLY') THEN 0.05::DOUBLE ELSE 1 END), 5) AS weight, count(*) AS n FROM f GROUP BY ALL"),
        "J08_asof_ratings": _sql("fbsp", f"SELECT result_id, yyyyww, pid, opponent, score, {_r('pre_rating', 'pre_rd')} FROM pr"),
        "J10_snapshot_before": _sql("fbs", ", k AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT week FROM s)) SELECT result_id, yyyyww, before, round(coalesce(h.rating, 1500), 5) AS home_before, round(coalesce(a.rating, 1500), 5) AS away_before FROM f LEFT JOIN k ON yyyyww = k.week LEFT JOIN s h ON h.week = before AND h.pid = home_club_id LEFT JOIN s a ON a.week = before AND a.pid = away_club_id"),
        "AGG14_metrics": _sql("fbsp", "SELECT league_code, count(*) AS n, round(avg(-(actual * ln(expected) + (1 - actual) * ln(1 - expected))), 5) AS log_loss, round(avg(pow(expected - actual, 2)), 5) AS brier, round(avg(CASE WHEN actual <> 0.5 THEN ((expected >= 0.5) = (actual = 1))::INT END), 5) AS accuracy, round(avg(abs(expected - actual)), 5) AS mae, round(sqrt(avg(pow(expected - actual, 2))), 5) AS rmse FROM p GROUP BY ALL"),
        "AGG16_calibration": _sql("fbsp", "SELECT round(floor(round(expected, 9) / 0.05::DOUBLE) * 0.05::DOUBLE, 5) AS bin, count(*) AS n, round(avg(round(expected, 9)), 5) AS mean_predicted, round(avg(actual), 5) AS mean_actual, round(avg((actual = 1)::INT), 5) AS win, round(avg((actual = 0.5)::INT), 5) AS draw, round(avg((actual = 0)::INT), 5) AS loss, round(avg(actual) - avg(round(expected, 9)), 5) AS gap, count(*) < 30 AS small FROM p GROUP BY 1"),
        "AGG20_spearman": _sql("fcbsw", ", q AS (SELECT country_name, round(rating, 6) AS x, round(rd, 6) AS y FROM w), k AS (SELECT country_name, rank() OVER (PARTITION BY country_name ORDER BY x) + (count(*) OVER (PARTITION BY country_name, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY country_name ORDER BY y) + (count(*) OVER (PARTITION BY country_name, y) - 1) / 2 AS ry FROM q) SELECT country_name, count(*) AS n, round(corr(rx, ry), 5) AS rho FROM k GROUP BY ALL"),
        "Q10_biggest_upsets": _sql("fbsp", ", u AS (SELECT result_id, yyyyww, abs(actual - expected) AS upset, unnest([home_club_id, away_club_id]) AS pid FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(upset, 9) DESC, result_id) AS place FROM u) SELECT pid, place, result_id, yyyyww, round(upset, 5) AS upset FROM o WHERE place <= 3"),
        "Q08_club_matches": _sql("fcb", ", o AS (SELECT *, goals - conceded AS margin, row_number() OVER (PARTITION BY pid ORDER BY goals - conceded DESC, result_id) AS best, row_number() OVER (PARTITION BY pid ORDER BY goals - conceded, result_id) AS worst FROM b) SELECT pid, result_id, match_date, club_name AS opponent_name, at_home, goals, conceded, margin, best <= 3 AS is_best FROM o LEFT JOIN c ON opponent = club_id WHERE best <= 3 OR worst <= 3"),
        "AGG21_presence": _sql("fcbsw", ", o AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY rating DESC, pid) AS place FROM w), k AS (SELECT country_name, week, count(*) FILTER (WHERE place <= 10) AS held FROM o GROUP BY ALL), z AS (SELECT country_name, week, coalesce(held, 0) AS held FROM (SELECT DISTINCT week FROM w) CROSS JOIN (SELECT DISTINCT country_name FROM w) LEFT JOIN k USING (country_name, week)) SELECT country_name, round(avg(held), 5) AS mean_held, arg_max(held, week) AS latest_held, max(held) AS most_held, round(avg((held > 0)::INT), 5) AS share_of_weeks FROM z GROUP BY ALL"),
        "AGG22_extremes": _sql("fcbsw", ", o AS (SELECT *, coalesce(rating - lag(rating) OVER (PARTITION BY pid ORDER BY week), 0) AS change, row_number() OVER (PARTITION BY week, country_name ORDER BY rating DESC, pid) AS place FROM w) SELECT country_name, pid, round(max(rating), 5) AS peak, round(avg(rating), 5) AS mean_rating, round(max(change), 5) AS best_rise, count(*) FILTER (WHERE place = 1) AS weeks_first FROM o GROUP BY ALL"),
        "Q18_map_layer": _sql("fcbswl", ", k AS (SELECT country_name, max(rating) AS heat FROM l GROUP BY ALL) SELECT country_name, round(heat, 5) AS heat, round(CASE WHEN max(heat) OVER () > min(heat) OVER () THEN 12 + 16 * (heat - min(heat) OVER ()) / (max(heat) OVER () - min(heat) OVER ()) ELSE 16 END, 5) AS marker FROM k"),
        "TS02_best_split": _sql("fbs", ", k AS (SELECT pid, row_number() OVER o AS i, count(*) OVER q AS n, sum(v) OVER o AS a, sum(v * v) OVER o AS b, sum(v) OVER q AS ta, sum(v * v) OVER q AS tb FROM (SELECT pid, week, round(rating, 6) AS v FROM s) WINDOW o AS (PARTITION BY pid ORDER BY week), q AS (PARTITION BY pid)), z AS (SELECT *, b - a * a / i + (tb - b) - (ta - a) * (ta - a) / (n - i) AS cost FROM k WHERE i >= 8 AND n - i > 8) SELECT pid, n, i AS split, round(tb - ta * ta / n - cost, 3) AS gain FROM z QUALIFY row_number() OVER (PARTITION BY pid ORDER BY round(cost, 6), i) = 1"),
        "AGG25_trend": _sql("fbs", ", k AS (SELECT pid, row_number() OVER o - 1 AS i, rating AS v, rating - lag(rating) OVER o AS step FROM s WINDOW o AS (PARTITION BY pid ORDER BY week)) SELECT pid, count(*) AS n, round(regr_slope(v, i) * 52, 5) AS slope, round(stddev_pop(step), 5) AS volatility FROM k GROUP BY ALL"),
        "DED01_keep_first": _sql("f", "SELECT result_id, match_date, home_club_id FROM f QUALIFY row_number() OVER (PARTITION BY match_date, home_club_id ORDER BY home_team_goals DESC, result_id) = 1"),
        "UPS_merge": _sql("f", ", t AS (SELECT match_date, home_club_id, away_club_id, home_team_goals + 1 AS home_team_goals, away_team_goals FROM f WHERE match_date >= DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY match_date, home_club_id, away_club_id ORDER BY home_team_goals, away_team_goals) = 1) SELECT match_date, home_club_id, away_club_id, home_team_goals, away_team_goals FROM f WHERE match_date < DATE '1998-01-01' UNION ALL SELECT * FROM t"),
        "ER06_closure": "WITH RECURSIVE " + _sql("fb", ", m AS (SELECT pid AS old, max(opponent) AS new FROM b WHERE opponent < pid GROUP BY ALL), r AS (SELECT old, new FROM m UNION ALL SELECT r.old, m.new FROM r JOIN m ON r.new = m.old) SELECT old, min(new) AS new FROM r GROUP BY old")[5:],
        "GC03_weighted_fixtures": _sql("fcbse", "SELECT result_id, home_community, away_community, weight, suffix = 'UCL' AS continental FROM g1"),
        "GC15_adjusted": _sql("fcbseg", f"""SELECT week, pid, community, opponents, {_r('volume', 'h_norm', 'direct', 'community_connectivity', 'effective', 'total_rd', 'trust', 'baseline', 'adjusted')} FROM adj"""),
        "HD07_diffusion": _sql("fcbsed", """SELECT week, pid, round(seed, 7) AS seed, round(x, 7) AS comparability FROM x6"""),
        "RAT11_period_sums": _sql("fb", f"SELECT pid, count(*) AS games, round(sum({g} * {g} * 0.25), 5) AS information, round(sum({g} * (score - 0.5)), 5) AS surprise FROM bs GROUP BY pid"),
        "AGG26_field_strength": _sql("fbs", """, h AS (SELECT pid, rating, rd, week AS since, coalesce(lead(week) OVER (PARTITION BY pid ORDER BY week), 999999) AS stop FROM s),
kn AS (SELECT k.week, pid, rating, rating * least(1, 250 / rd) AS part FROM (SELECT DISTINCT week FROM s) k JOIN h ON k.week > since AND k.week <= stop),
kr AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY part DESC, pid) - 1 AS r FROM kn),
nm AS (SELECT week, 1000 / sum(part * exp(-(r * r) / 5000.0::DOUBLE)) AS factor FROM kr WHERE r < 150 GROUP BY ALL),
ev AS (SELECT DISTINCT yyyyww AS week, strftime(match_date, '%Y%m%d') || '_' || home_club_id || '_' || away_club_id AS event_id, unnest([home_club_id, away_club_id]) AS pid FROM f),
er AS (SELECT ev.week, event_id, rating, part, row_number() OVER (PARTITION BY ev.week, event_id ORDER BY part DESC, pid) - 1 AS r FROM ev JOIN kn USING (week, pid))
SELECT week, event_id, count(*) AS entities, round(sum(rating), 4) AS total, round(avg(rating), 4) AS mean, round(sum(part * exp(-(r * r) / 5000.0::DOUBLE)), 4) AS decayed, round(sum(part * exp(-(r * r) / 5000.0::DOUBLE)) * any_value(factor), 4) AS normalised FROM er JOIN nm USING (week) GROUP BY ALL"""),
        "RAT22_match_changes": _sql("fbs", """, k AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT week FROM s)),
m AS (SELECT result_id, yyyyww, coalesce(h0.rating, 1500) AS hp, coalesce(h1.rating, h0.rating, 1500) AS hq, coalesce(h0.rd, 350) AS hdp, coalesce(h1.rd, h0.rd, 350) AS hdq, coalesce(a0.rating, 1500) AS ap, coalesce(a1.rating, a0.rating, 1500) AS aq, coalesce(a0.rd, 350) AS adp, coalesce(a1.rd, a0.rd, 350) AS adq
  FROM f LEFT JOIN k ON yyyyww = k.week LEFT JOIN s h0 ON h0.week = before AND h0.pid = home_club_id LEFT JOIN s a0 ON a0.week = before AND a0.pid = away_club_id LEFT JOIN s h1 ON h1.week = yyyyww AND h1.pid = home_club_id LEFT JOIN s a1 ON a1.week = yyyyww AND a1.pid = away_club_id)
SELECT result_id, yyyyww, round(hp, 3) AS home_pre, round(hq, 3) AS home_post, round(hq - hp, 3) AS home_change, round(hdp, 3) AS home_pre_rd, round(hdq, 3) AS home_post_rd, round(ap, 3) AS away_pre, round(aq, 3) AS away_post, round(aq - ap, 3) AS away_change, round(adp, 3) AS away_pre_rd, round(adq, 3) AS away_post_rd FROM m"""),
        "STM02_weekly_tallies": "SELECT date_trunc('week', ts)::TIMESTAMP AS week_start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
        "STM04_spells": "WITH o AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR, true)::INT AS fresh FROM events), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS spell FROM o) SELECT user_id AS entity, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, count(*) AS n FROM k GROUP BY user_id, spell",
    }
