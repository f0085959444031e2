"""Queries over the weekly history: ranks, extremes, connectivity's outputs, anchors, evaluation, segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderworks.functions.scoring import elo_expected
from ladderworks.functions.weeks import week_monday
from ladderworks.operators import connectivity, evaluate, ratings
from ladderworks.operators.asof import asof_before, snapshot
from ladderworks.operators.keeping import kept
from ladderworks.operators.segments import segments, typical_step
from ladderworks.plans import serving
from ladderworks.plans.common import layer, layer_now, layer_of, rounded, sql, weekly
from ladderworks.sources.fixtures import clubs, fixtures

#: Weights of the deviation and of missing connectivity in the power score.
POWER_RD, POWER_CONNECTIVITY = 0.28, 0.15


def filled(s, d):
    """Countries' weekly means over every week there is; gaps take the last value before, else the first after."""
    means = serving.country_weeks(weekly(s, d)).select("country_name", "week", "mean_rating")
    calendar = means.agg(F.array_sort(F.collect_set("week")).alias("weeks"))  # one row: a calendar
    spine = means.select("country_name").distinct().crossJoin(F.broadcast(calendar)).select("country_name", F.explode("weeks").alias("week"))
    w = Window.partitionBy("country_name").orderBy("week")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    value = F.coalesce(F.last("mean_rating", ignorenulls=True).over(back), F.first("mean_rating", ignorenulls=True).over(ahead))
    return rounded(spine.join(means, ["country_name", "week"], "left").select("country_name", "week", value.alias("mean_rating")))


def mean_ranks(s, d):
    n = fixtures(s, d).groupBy(F.col("home_club_id").alias("pid"), "league_code").agg(F.count("*").alias("n"))
    rank = F.rank().over(Window.partitionBy("league_code").orderBy("n")) + (F.count("*").over(Window.partitionBy("league_code", "n")) - 1) / 2
    return n.select("league_code", "pid", "n", rank.cast("double").alias("mean_rank"))


def previous_weeks(s, d):
    spine = weekly(s, d).select("week").distinct()  # a calendar: one row a week
    return spine.select("week", F.lag("week").over(Window.orderBy("week")).alias("before"))


def client_ladder(s, d):
    rows = serving.latest(weekly(s, d)).withColumn("rating", F.when(F.col("pid") % 7 > 0, F.round("rating", 1)))
    place = F.row_number().over(Window.partitionBy("country_name").orderBy(F.desc_nulls_last("rating"), F.lower("club_name"), "pid"))
    return rows.select("country_name", place.alias("place"), "pid", "rating")


def ranks_by_week(s, d):
    """Places in the country's own ladder with those over all, by week."""
    w = weekly(s, d)
    order = [F.desc("rating"), F.col("pid")]
    own = w.select("week", "pid", F.row_number().over(Window.partitionBy("week", "country_name").orderBy(*order)).alias("own_place"))
    over_all = w.select("week", "pid", F.row_number().over(Window.partitionBy("week").orderBy(*order)).alias("place"))
    return own.join(over_all, ["week", "pid"], "left")


def predicted_results(s, d):
    """Predictions with results by week and sides; a pair that meets twice in a week has every combination."""
    f = fixtures(s, d)
    keys = ["yyyyww", "home_club_id", "away_club_id"]
    p = serving.predictions(f, ratings.running_strength(f)).select(*keys, "expected")
    return rounded(p.join(f.select(*keys, "result_id", "home_team_goals", "away_team_goals"), keys).select("result_id", "expected", "home_team_goals", "away_team_goals"))


def activity(s, d):
    return serving.activity(fixtures(s, d))


def modal_moves(s, d):
    """The direction that a country's clubs moved in most often; of equals the first by name."""
    moved = serving.movement(weekly(s, d)).join(clubs(s, d).select(F.col("club_id").alias("pid"), "country_name"), "pid")
    kind = F.when(F.round("change", 6) > 0, "rose").when(F.round("change", 6) < 0, "fell").otherwise("held")
    n = moved.groupBy("country_name", kind.alias("direction")).agg(F.count("*").alias("n"))
    return n.groupBy("country_name").agg(F.min_by("direction", F.struct(-F.col("n"), "direction")).alias("direction"), F.max("n").alias("n"))


def rank_shares(s, d):
    rows = serving.ladder(weekly(s, d))
    share = lambda c, k: F.avg((F.col(c) <= k).cast("double"))
    return rounded(rows.groupBy("pid").agg(F.avg("domestic_place").alias("mean_place"), F.min("domestic_place").alias("best_place"), F.min("place").alias("best_over_all"), share("domestic_place", 1).alias("first"), share("domestic_place", 3).alias("top3"), share("place", 10).alias("top10")))


def median_leader(s, d):
    leaders = serving.latest(weekly(s, d)).groupBy("country_name").agg(F.max("rating").alias("best"))
    return rounded(leaders.agg(F.median("best").alias("median"), F.count("*").alias("countries")))


def movers(s, d):
    """Per country the five greatest rises and falls of the clubs' last weeks."""
    m = serving.movement(weekly(s, d)).groupBy("pid").agg(F.max_by("change", "week").alias("change"))
    m = m.join(clubs(s, d).select(F.col("club_id").alias("pid"), "country_name"), "pid").withColumn("change", F.round("change", 5))
    w = Window.partitionBy("country_name")
    m = m.withColumns({"rise": F.row_number().over(w.orderBy(F.desc("change"), "pid")), "fall": F.row_number().over(w.orderBy("change", "pid"))})
    return m.where("rise <= 5 OR fall <= 5").select("country_name", "pid", "change", "rise", "fall")


def swings(s, d):
    """Per club the three matches after which both sides' ratings moved most together."""
    f = fixtures(s, d)
    c = ratings.match_changes(f, ratings.running_strength(f), 3).withColumn("swing", F.round(F.abs("home_change") + F.abs("away_change"), 3))
    rows = c.join(f.select("result_id", "home_club_id", "away_club_id"), "result_id").select("result_id", "swing", F.explode(F.array("home_club_id", "away_club_id")).alias("pid"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("swing"), "result_id"))
    return rows.withColumn("place", place).where("place <= 3").select("pid", "place", "result_id", "swing")


def top_union(s, d):
    """By week: clubs among the ten best by rating or the ten surest by deviation."""
    w = weekly(s, d).withColumn("rd", F.round("rd", 6))
    by = Window.partitionBy("week")
    w = w.withColumns({"by_rating": F.row_number().over(by.orderBy(F.desc("rating"), "pid")), "by_rd": F.row_number().over(by.orderBy("rd", "pid"))})
    return w.where("by_rating <= 10 OR by_rd <= 10").select("week", "pid", (F.col("by_rating") <= 10).alias("is_top"), (F.col("by_rd") <= 10).alias("is_sure"))


def _adjusted_now(s, d):
    """The connectivity layer's rows of the latest week, kept, as they are read more than once; no other week is computed."""
    now, edges, _ = layer_now(s, d)
    return kept(connectivity.adjust(now, edges, opponents=False))


def power_scores(s, d):
    """Three scores of the latest week: the adjusted rating, less the deviation, less missing connectivity too."""
    a = _adjusted_now(s, d)
    less = F.col("adjusted") - POWER_RD * F.greatest(F.lit(0.0), F.col("total_rd"))
    lack = POWER_CONNECTIVITY * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("effective"))))
    return rounded(a.select("pid", F.col("adjusted").alias("rating_only"), less.alias("rating_rd"), (less - lack).alias("rating_rd_connectivity")))


def community_weeks(s, d):
    """Every community with outside matches in a week's window, with means of its rated members; null where it has none."""
    w, edges = layer(s, d)
    means = connectivity.adjust(w, edges, opponents=False).groupBy("week", "community").agg(F.avg("rating").alias("raw_mean"), F.avg("adjusted").alias("adjusted_mean"), F.avg("baseline").alias("baseline_mean"))
    known = connectivity.community_connectivity(edges, w)
    return rounded(known.join(F.broadcast(means), ["week", "community"], "left").select("week", "community", "external", "community_connectivity", "raw_mean", "adjusted_mean", "baseline_mean"))


def diagnostics(s, d):
    """Six lists of fifteen over the latest week."""
    a = _adjusted_now(s, d).select("pid", *[F.round(c, 6).alias(c) for c in ("effective", "rating", "trust", "adjusted")])
    a = a.withColumn("delta", F.round(F.col("adjusted") - F.col("rating"), 6))
    orders = {
        "most_connected": [F.desc("effective")], "least_connected": [F.col("effective")], "high_rating_low_trust": [F.desc("rating"), F.col("trust")],
        "most_lowered": [F.col("delta")], "least_lowered": [F.desc("delta")], "best_adjusted": [F.desc("adjusted")],
    }
    out = None
    for name, order in orders.items():
        part = a.orderBy(*order, "pid").limit(15).select(F.lit(name).alias("list"), "pid")
        out = part if out is None else out.unionByName(part)
    return out


def reasonableness(s, d):
    """How adjustments of the latest week go with connectivity and trust: means, spread, rank correlations."""
    a = _adjusted_now(s, d).select("week", *[F.round(c, 6).alias(c) for c in ("effective", "trust")], F.round(F.col("adjusted") - F.col("rating"), 6).alias("delta"))
    sums = a.groupBy("week").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("spread"), F.avg("effective").alias("mean_effective"), F.avg("trust").alias("mean_trust"))
    rho = lambda c: evaluate.spearman(a, "week", c, "delta").select("week", F.col("rho").alias(f"rho_{c}"))
    return rounded(sums.join(rho("effective"), "week").join(rho("trust"), "week"), 4)


def deciles(s, d):
    """Tenths of the latest week by connectivity, cut at interpolated quantiles, with means of each."""
    a = _adjusted_now(s, d).withColumn("effective", F.round("effective", 6))
    edges = a.agg(F.percentile("effective", F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("edges"))  # one row; the week's entities
    a = a.crossJoin(F.broadcast(edges)).withColumn("decile", 1 + F.size(F.filter("edges", lambda e: F.round(e, 6) < F.col("effective"))))
    return rounded(a.groupBy("decile").agg(F.count("*").alias("n"), F.avg("effective").alias("mean_effective"), F.avg(F.col("adjusted") - F.col("rating")).alias("mean_delta"), F.avg("trust").alias("mean_trust")))


def communities_now(s, d):
    a = _adjusted_now(s, d).withColumn("community", F.nullif("community", F.lit("")))
    return rounded(a.groupBy("community").agg(F.count("pid").alias("n"), F.avg("rating").alias("mean_rating"), F.avg("adjusted").alias("mean_adjusted"), F.avg(F.col("adjusted") - F.col("rating")).alias("mean_delta"), F.avg("effective").alias("mean_effective"), F.avg("trust").alias("mean_trust")))


def high_low(s, d):
    """Entities of the latest week in the best tenth by rating and the last quarter by trust."""
    a = _adjusted_now(s, d).select("pid", F.round("rating", 6).alias("rating"), F.round("trust", 6).alias("trust"))
    q = a.agg(F.percentile("rating", F.lit(0.9)).alias("high"), F.percentile("trust", F.lit(0.25)).alias("low"))  # one row
    return rounded(a.crossJoin(F.broadcast(q)).where("rating >= round(high, 6) AND trust <= round(low, 6)").select("pid", "rating", "trust"))


def recent_opponents(s, d, last=10):
    """Per club and week: mean rating before the match of its last ``last`` opponents, those without one left out."""
    f = fixtures(s, d)
    sides = ratings.both_sides(f, ["result_id", "yyyyww", "match_date"])
    known = asof_before(sides, ratings.running_strength(f).select(F.col("pid").alias("opponent"), "week", "rating"), "opponent", "yyyyww", "week", ["rating"])
    w = Window.partitionBy("pid").orderBy("yyyyww", "match_date", "result_id").rowsBetween(-(last - 1), 0)
    rows = known.select("pid", "yyyyww", F.struct("match_date", "result_id").alias("at"), F.avg("rating").over(w).alias("mean"), F.count("*").over(w).alias("used"))
    return rounded(rows.groupBy("pid", F.col("yyyyww").alias("week")).agg(F.max_by("mean", "at").alias("mean_opponent"), F.max_by("used", "at").alias("used")))


def anchored(s, d):
    """The latest week's ratings, lowered towards the mean of all or of the country by what diffusion found comparable."""
    w, edges = layer(s, d)
    now = snapshot(w)
    rows = now.join(connectivity.diffuse(now, edges), ["week", "pid"]).join(clubs(s, d).select(F.col("club_id").alias("pid"), "country_name"), "pid", "left")
    everyone = F.broadcast(rows.groupBy("week").agg(F.avg("rating").alias("all_mean")))
    own = rows.groupBy("week", "country_name").agg(F.avg("rating").alias("own_mean"))
    rows = rows.join(everyone, "week").join(own, ["week", "country_name"], "left")
    low = lambda a: F.when(F.col("rating") <= F.col(a), F.col("rating")).otherwise(F.col(a) + F.col("comparability") * (F.col("rating") - F.col(a)))
    return rounded(rows.select("pid", "all_mean", F.coalesce("own_mean", "all_mean").alias("own_mean"), low("all_mean").alias("by_all"), low("own_mean").alias("by_own")))


def anchor_modes(s, d):
    """Every week's anchors by all modes: of all, of the country, and of the last ten opponents with how many there were."""
    w, f = weekly(s, d).select("week", "pid", "rating", "country_name"), fixtures(s, d)
    rows = connectivity.anchors(w).select("week", "pid", F.col("anchor").alias("by_all"))
    own = connectivity.anchors(w, mode="domestic").select("week", "pid", F.col("anchor").alias("by_country"))
    last = connectivity.anchors(w, f, "oppo_recent_mean").select("week", "pid", F.col("anchor").alias("by_opponents"), "used")
    return rounded(rows.join(own, ["week", "pid"]).join(last, ["week", "pid"]))


def _scored(s, d):
    f = fixtures(s, d)
    return serving.predictions(f, ratings.running_strength(f))


def _placed_weeks(p):
    """Weeks numbered from 0, and how many there are: a calendar."""
    spine = p.select("yyyyww").distinct().withColumn("i", F.row_number().over(Window.orderBy("yyyyww")) - 1)
    return F.broadcast(spine.withColumn("weeks", F.count("*").over(Window.partitionBy(F.lit(1)))))


def rolling(s, d, shares=(0.5, 0.6, 0.7, 0.8)):
    """Scores of the weeks after each origin, one pass for all origins; the split is at least 1 and leaves a week."""
    p = _scored(s, d)
    p = p.join(_placed_weeks(p), "yyyyww").withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    split = F.greatest(F.lit(1), F.least(F.col("weeks") - 1, F.floor(F.col("weeks") * F.col("share"))))
    return rounded(p.where(F.col("i") >= split).groupBy("share").agg(F.count_distinct("yyyyww").alias("test_weeks"), *evaluate.metrics(F.col("expected"), F.col("actual"))).select("share", "test_weeks", "n", "log_loss", "brier", "accuracy"))


def grid(s, d, widths=(200.0, 300.0, 400.0, 500.0, 600.0)):
    """Log loss for several widths of the expectation in one pass, and which is least."""
    p = _scored(s, d).withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    e = elo_expected((F.col("home_pre") - F.col("away_pre")) * 400.0 / F.col("width"))
    t = p.groupBy("width").agg(*evaluate.metrics(e, F.col("actual"))).select("width", "n", F.round("log_loss", 7).alias("log_loss"))
    return t.withColumn("is_best", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("log_loss", "width")) == 1)  # one row a trial


def head_to_head(s, d):
    """Ratings before the match against adjusted ones, over all matches and the continental ones; the better by absolute error.

    A side without an adjusted rating before the match has its raw one.
    """
    f = kept(fixtures(s, d))
    w, edges = layer_of(f, clubs(s, d))
    adjusted = connectivity.adjust(w, edges).select("pid", "week", "adjusted")
    p = kept(serving.predictions(f, w))
    side = lambda x: F.struct(F.lit(x).alias("side"), F.col(f"{x}_club_id").alias("pid"), F.col(f"{x}_pre").alias("pre"))
    sides = p.select("result_id", "yyyyww", F.inline(F.array(side("home"), side("away"))))
    known = asof_before(sides, adjusted, "pid", "yyyyww", "week", ["adjusted"])
    value = F.coalesce("adjusted", "pre")
    gap = known.groupBy("result_id").agg(F.sum(F.when(F.col("side") == "home", value).otherwise(-value)).alias("gap"))
    rows = p.join(gap, "result_id").withColumn("other", elo_expected(F.col("gap")))
    rows = rows.withColumn("scope", F.explode(F.when(F.col("league_code") == "UCL", F.array(F.lit("all"), F.lit("continental"))).otherwise(F.array(F.lit("all")))))
    error = lambda e, f: F.round(f(F.col(e) - F.col("actual")), 6)
    mae, rmse = lambda x: F.avg(F.abs(x)), lambda x: F.sqrt(F.avg(x * x))
    t = rows.groupBy("scope").agg(F.count("*").alias("n"), error("expected", mae).alias("raw_mae"), error("other", mae).alias("adjusted_mae"), error("expected", rmse).alias("raw_rmse"), error("other", rmse).alias("adjusted_rmse"))
    return t.withColumn("better", F.when(F.col("adjusted_mae") < F.col("raw_mae"), "adjusted").otherwise("raw"))


def calibration_report(s, d):
    """One row: predictions, mean gap and the mean absolute gap of the bins, weighted by their size."""
    bins = evaluate.calibration(_scored(s, d).withColumn("expected", F.round("expected", 9)), "expected", "actual")
    n = F.sum("n")
    return rounded(bins.agg(n.alias("n"), F.count("*").alias("bins"), (F.sum(F.abs("gap") * F.col("n")) / n).alias("calibration_error"), F.max(F.abs("gap")).alias("widest_gap"), F.count_if("small").alias("small_bins")))


def regimes(s, d):
    return rounded(segments(weekly(s, d).withColumn("rating", F.round("rating", 6)), "pid", "week", "rating"), 4)


def regime_steps(s, d):
    return rounded(typical_step(segments(weekly(s, d).withColumn("rating", F.round("rating", 6)), "pid", "week", "rating"), "pid"), 4)


def teams(s, d):
    return weekly(s, d).select(F.lower("country_name").alias("country"), "pid", "club_name").distinct()


def timeseries(s, d):
    w = serving.movement(weekly(s, d))
    return rounded(w.select("pid", "week", week_monday(F.col("week")).alias("monday"), F.round("rating", 1).alias("rating"), F.round("change", 1).alias("change")), 1)


def identity(s, d):
    w = weekly(s, d)
    return w.groupBy("pid", "club_name", "country_name").agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"), F.count("*").alias("weeks"))


def search(s, d):
    """Clubs whose name holds a text, within a country, with their places over all: places come before the filter."""
    rows = serving.latest(weekly(s, d)).select("pid", "club_name", "country_name", F.round("rating", 5).alias("rating"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("rating"), "pid"))  # one row a club
    return rows.withColumn("place", place).where(F.contains(F.lower("club_name"), F.lit("0007")) & (F.lower("country_name") == "nation_7"))


def rated_countries(s, d):
    return rounded(weekly(s, d).groupBy("country_name").agg(F.max("rating").alias("peak"), F.avg("rating").alias("mean"), F.count_distinct("pid").alias("clubs"), F.count_distinct("week").alias("weeks")))


QUERIES = {
    "WIN06_filled": filled, "WIN10_mean_ranks": mean_ranks, "WIN12_previous_weeks": previous_weeks, "WIN13_client_ladder": client_ladder, "J17_ranks_by_week": ranks_by_week, "J05_predicted_results": predicted_results,
    "AGG04_activity": activity, "AGG23_modal_moves": modal_moves, "AGG24_rank_shares": rank_shares, "AGG29_median_leader": median_leader, "TOP03_movers": movers, "TOP04_swings": swings, "TOP07_top_union": top_union,
    "GC14_power_scores": power_scores, "GC16_community_weeks": community_weeks, "GC17_diagnostics": diagnostics, "GC19_reasonableness": reasonableness, "AGG17_deciles": deciles, "AGG18_communities": communities_now,
    "FLT18_high_low": high_low, "HD03_recent_opponents": recent_opponents, "HD09_anchor_modes": anchor_modes, "HD10_anchored": anchored, "EV03_rolling": rolling, "EV04_grid": grid, "EV12_head_to_head": head_to_head, "EV11_calibration_report": calibration_report,
    "TS03_regimes": regimes, "TS05_regime_steps": regime_steps, "Q02_teams": teams, "Q05_timeseries": timeseries, "Q09_identity": identity, "Q15_search": search, "Q17_rated_countries": rated_countries,
}

_SNAP = ", sn AS (SELECT *, round(adjusted - rating, 6) AS delta FROM adj WHERE week = (SELECT max(week) FROM adj))"


def _list(name: str, order: str) -> str:
    return f"(SELECT '{name}' AS list, pid FROM sr ORDER BY {order}, pid LIMIT 15)"


def oracle_sql() -> dict[str, str]:
    ranks = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2 AS r_{0}"
    lists = " UNION ALL ".join(_list(n, o) for n, o in (("most_connected", "effective DESC"), ("least_connected", "effective"), ("high_rating_low_trust", "rating DESC, trust"), ("most_lowered", "delta"), ("least_lowered", "delta DESC"), ("best_adjusted", "adjusted DESC")))
    low = "CASE WHEN rating <= {0} THEN rating ELSE {0} + x * (rating - {0}) END"
    return {
        "WIN06_filled": sql("fcbsw", ", v AS (SELECT country_name, week, avg(rating) AS m FROM w GROUP BY ALL), z AS (SELECT * FROM (SELECT DISTINCT country_name FROM v) CROSS JOIN (SELECT DISTINCT week FROM v) LEFT JOIN v USING (country_name, week)) SELECT country_name, week, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY country_name ORDER BY week ROWS UNBOUNDED PRECEDING), first_value(m IGNORE NULLS) OVER (PARTITION BY country_name ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS mean_rating FROM z"),
        "WIN10_mean_ranks": sql("f", ", v AS (SELECT home_club_id AS pid, league_code, count(*) AS n FROM f GROUP BY ALL) SELECT league_code, pid, n, (rank() OVER (PARTITION BY league_code ORDER BY n) + (count(*) OVER (PARTITION BY league_code, n) - 1) / 2)::DOUBLE AS mean_rank FROM v"),
        "WIN12_previous_weeks": sql("f", "SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT yyyyww AS week FROM f)"),
        "WIN13_client_ladder": sql("fcbswl", ", v AS (SELECT country_name, pid, club_name, CASE WHEN pid % 7 > 0 THEN round(rating, 1) END AS rating FROM l) SELECT country_name, row_number() OVER (PARTITION BY country_name ORDER BY rating DESC NULLS LAST, lower(club_name), pid) AS place, pid, rating FROM v"),
        "J17_ranks_by_week": sql("fcbsw", "SELECT week, pid, row_number() OVER (PARTITION BY week, country_name ORDER BY rating DESC, pid) AS own_place, row_number() OVER (PARTITION BY week ORDER BY rating DESC, pid) AS place FROM w"),
        "J05_predicted_results": sql("fbsp", "SELECT f.result_id, round(expected, 5) AS expected, f.home_team_goals, f.away_team_goals FROM p JOIN f USING (yyyyww, home_club_id, away_club_id)"),
        "AGG04_activity": sql("fb", "SELECT pid, (yyyyww // 100)::INT AS year, count(*) AS matches FROM b GROUP BY ALL"),
        "AGG23_modal_moves": sql("fcbsw", ", v AS (SELECT country_name, round(coalesce(rating - lag(rating) OVER (PARTITION BY pid ORDER BY week), 0), 6) AS x FROM w), n AS (SELECT country_name, CASE WHEN x > 0 THEN 'rose' WHEN x < 0 THEN 'fell' ELSE 'held' END AS direction, count(*) AS n FROM v GROUP BY ALL) SELECT country_name, first(direction ORDER BY n DESC, direction) AS direction, max(n) AS n FROM n GROUP BY ALL"),
        "AGG24_rank_shares": sql("fcbsw", ", v AS (SELECT pid, row_number() OVER (PARTITION BY week, country_name ORDER BY rating DESC, pid) AS o, row_number() OVER (PARTITION BY week ORDER BY rating DESC, pid) AS a FROM w) SELECT pid, round(avg(o), 5) AS mean_place, min(o) AS best_place, min(a) AS best_over_all, round(avg((o <= 1)::INT), 5) AS first, round(avg((o <= 3)::INT), 5) AS top3, round(avg((a <= 10)::INT), 5) AS top10 FROM v GROUP BY ALL"),
        "AGG29_median_leader": sql("fcbswl", "SELECT round(median(best), 5) AS median, count(*) AS countries FROM (SELECT country_name, max(rating) AS best FROM l GROUP BY ALL)"),
        "TOP03_movers": sql("fcbsw", ", v AS (SELECT pid, country_name, week, round(coalesce(rating - lag(rating) OVER (PARTITION BY pid ORDER BY week), 0), 5) AS change FROM w), z AS (SELECT pid, country_name, arg_max(change, week) AS change FROM v GROUP BY ALL) SELECT country_name, pid, change, row_number() OVER (PARTITION BY country_name ORDER BY change DESC, pid) AS rise, row_number() OVER (PARTITION BY country_name ORDER BY change, pid) AS fall FROM z QUALIFY rise <= 5 OR fall <= 5"),
        "TOP04_swings": sql("fbs", ", kk AS (SELECT week, lag(week) OVER (ORDER BY week) AS before FROM (SELECT DISTINCT week FROM s)), v AS (SELECT result_id, home_club_id, away_club_id, round(abs(round(coalesce(h1.rating, h0.rating, 1500) - coalesce(h0.rating, 1500), 3)) + abs(round(coalesce(a1.rating, a0.rating, 1500) - coalesce(a0.rating, 1500), 3)), 3) AS swing FROM f LEFT JOIN kk ON yyyyww = kk.week LEFT JOIN s h0 ON h0.week = before AND h0.pid = home_club_id LEFT JOIN s a0 ON a0.week = before AND a0.pid = away_club_id LEFT JOIN s h1 ON h1.week = yyyyww AND h1.pid = home_club_id LEFT JOIN s a1 ON a1.week = yyyyww AND a1.pid = away_club_id), z AS (SELECT result_id, swing, unnest([home_club_id, away_club_id]) AS pid FROM v) SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY swing DESC, result_id) AS place, result_id, swing FROM z QUALIFY place <= 3"),
        "TOP07_top_union": sql("fbs", ", v AS (SELECT week, pid, row_number() OVER (PARTITION BY week ORDER BY rating DESC, pid) AS a, row_number() OVER (PARTITION BY week ORDER BY round(rd, 6), pid) AS o FROM s) SELECT week, pid, a <= 10 AS is_top, o <= 10 AS is_sure FROM v WHERE a <= 10 OR o <= 10"),
        "GC14_power_scores": sql("fcbseg", _SNAP + " SELECT pid, round(adjusted, 5) AS rating_only, round(adjusted - 0.28::DOUBLE * total_rd, 5) AS rating_rd, round(adjusted - 0.28::DOUBLE * total_rd - 0.15::DOUBLE * (1 - effective), 5) AS rating_rd_connectivity FROM sn"),
        "GC16_community_weeks": sql("fcbseg", ", ex AS (SELECT week, own AS community, sum(m) AS external FROM cm GROUP BY ALL), mn AS (SELECT week, community, avg(rating) AS a, avg(adjusted) AS b, avg(baseline) AS c FROM adj GROUP BY ALL) SELECT week, community, round(external, 5) AS external, round(cc.community_connectivity, 5) AS community_connectivity, round(a, 5) AS raw_mean, round(b, 5) AS adjusted_mean, round(c, 5) AS baseline_mean FROM ex JOIN cc USING (week, community) LEFT JOIN mn USING (week, community)"),
        "GC17_diagnostics": sql("fcbseg", _SNAP + ", sr AS (SELECT pid, round(effective, 6) AS effective, round(rating, 6) AS rating, round(trust, 6) AS trust, round(adjusted, 6) AS adjusted, round(round(adjusted, 6) - round(rating, 6), 6) AS delta FROM sn) " + lists),
        "GC19_reasonableness": sql("fcbseg", _SNAP + f", sq AS (SELECT week, delta, round(effective, 6) AS effective, round(trust, 6) AS trust FROM sn), rk AS (SELECT *, {', '.join(ranks.format(c) for c in ('delta', 'effective', 'trust'))} FROM sq) SELECT week, count(*) AS n, round(avg(delta), 4) AS mean_delta, round(stddev_pop(delta), 4) AS spread, round(avg(effective), 4) AS mean_effective, round(avg(trust), 4) AS mean_trust, round(corr(r_effective, r_delta), 4) AS rho_effective, round(corr(r_trust, r_delta), 4) AS rho_trust FROM rk GROUP BY week"),
        "AGG17_deciles": sql("fcbseg", _SNAP + ", ed AS (SELECT quantile_cont(round(effective, 6), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM sn), dc AS (SELECT *, 1 + len(list_filter(edges, lambda q: round(q, 6) < round(effective, 6))) AS decile FROM sn CROSS JOIN ed) SELECT decile, count(*) AS n, round(avg(round(effective, 6)), 5) AS mean_effective, round(avg(adjusted - rating), 5) AS mean_delta, round(avg(trust), 5) AS mean_trust FROM dc GROUP BY decile"),
        "AGG18_communities": sql("fcbseg", _SNAP + " SELECT nullif(community, '') AS community, count(*) AS n, round(avg(rating), 5) AS mean_rating, round(avg(adjusted), 5) AS mean_adjusted, round(avg(adjusted - rating), 5) AS mean_delta, round(avg(effective), 5) AS mean_effective, round(avg(trust), 5) AS mean_trust FROM sn GROUP BY 1"),
        "FLT18_high_low": sql("fcbseg", _SNAP + ", q9 AS (SELECT quantile_cont(round(rating, 6), 0.9) AS high, quantile_cont(round(trust, 6), 0.25) AS low FROM sn) SELECT pid, round(rating, 5) AS rating, round(trust, 5) AS trust FROM sn CROSS JOIN q9 WHERE round(sn.rating, 6) >= round(high, 6) AND round(sn.trust, 6) <= round(low, 6)"),
        "HD03_recent_opponents": sql("fbs", ", o AS (SELECT b.pid, b.yyyyww, b.match_date, b.result_id, s.rating FROM b ASOF LEFT JOIN s ON b.opponent = s.pid AND b.yyyyww > s.week), v AS (SELECT pid, yyyyww, match_date, result_id, avg(rating) OVER q AS m, count(*) OVER q AS used FROM o WINDOW q AS (PARTITION BY pid ORDER BY yyyyww, match_date, result_id ROWS 9 PRECEDING)) SELECT pid, yyyyww AS week, round(m, 5) AS mean_opponent, used FROM v QUALIFY row_number() OVER (PARTITION BY pid, yyyyww ORDER BY match_date DESC, result_id DESC) = 1"),
        "HD09_anchor_modes": sql("fcbsw", """, o AS (SELECT b.pid, b.match_date, b.result_id, s.rating FROM b ASOF LEFT JOIN s ON b.opponent = s.pid AND b.yyyyww > s.week),
v AS (SELECT pid, match_date, result_id, avg(rating) OVER q AS m, count(*) OVER q AS used FROM o WINDOW q AS (PARTITION BY pid ORDER BY match_date, result_id ROWS 9 PRECEDING)),
k2 AS (SELECT pid, match_date, m, used FROM v QUALIFY row_number() OVER (PARTITION BY pid, match_date ORDER BY result_id DESC) = 1),
ww AS (SELECT w.*, date_trunc('week', make_date(week // 100, 1, 4))::DATE + ((week % 100 - 1) * 7 + 7)::INT AS until, avg(rating) OVER (PARTITION BY week) AS a, avg(rating) OVER (PARTITION BY week, country_name) AS c FROM w)
SELECT week, ww.pid, round(a, 5) AS by_all, round(CASE WHEN country_name IS NULL THEN a ELSE c END, 5) AS by_country, round(coalesce(m, a), 5) AS by_opponents, coalesce(used, 0) AS used FROM ww ASOF LEFT JOIN k2 ON ww.pid = k2.pid AND ww.until > k2.match_date"""),
        "HD10_anchored": sql("fcbsed", f", nw AS (SELECT s.pid, s.rating, x, country_name FROM s JOIN x6 USING (week, pid) LEFT JOIN c ON club_id = s.pid WHERE week = (SELECT max(week) FROM s)), aw AS (SELECT *, avg(rating) OVER () AS all_mean, avg(rating) OVER (PARTITION BY country_name) AS own_mean FROM nw) SELECT pid, round(all_mean, 5) AS all_mean, round(own_mean, 5) AS own_mean, round({low.format('aw.all_mean')}, 5) AS by_all, round({low.format('aw.own_mean')}, 5) AS by_own FROM aw"),
        "EV03_rolling": sql("fbsp", ", v AS (SELECT yyyyww, row_number() OVER (ORDER BY yyyyww) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT yyyyww FROM p)), t AS (SELECT p.*, share, i, n FROM p JOIN v USING (yyyyww) CROSS JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8])::DOUBLE AS share)) SELECT share, count(DISTINCT yyyyww) AS test_weeks, count(*) AS n, round(avg(-(actual * ln(expected) + (1 - actual) * ln(1 - expected))), 5) AS log_loss, round(avg(pow(expected - actual, 2)), 5) AS brier, round(avg(CASE WHEN actual <> 0.5 THEN ((expected >= 0.5) = (actual = 1))::INT END), 5) AS accuracy FROM t WHERE i >= greatest(1, least(t.n - 1, floor(t.n * share))) GROUP BY share"),
        "EV04_grid": sql("fbsp", ", v AS (SELECT width, actual, 1 / (1 + pow(10.0::DOUBLE, -(home_pre - away_pre) / width)) AS e FROM p CROSS JOIN (SELECT unnest([200, 300, 400, 500, 600])::DOUBLE AS width)), t AS (SELECT width, count(*) AS n, round(avg(-(actual * ln(e) + (1 - actual) * ln(1 - e))), 7) AS log_loss FROM v GROUP BY width) SELECT *, row_number() OVER (ORDER BY log_loss, width) = 1 AS is_best FROM t"),
        "EV12_head_to_head": sql("fcbsepg", """, sd AS (SELECT result_id, yyyyww, home_club_id AS pid, home_pre AS pre, 1 AS sign FROM p UNION ALL SELECT result_id, yyyyww, away_club_id, away_pre, -1 FROM p),
av AS (SELECT result_id, sum(sign * coalesce(adjusted, pre)) AS gap FROM sd ASOF LEFT JOIN adj ON sd.pid = adj.pid AND sd.yyyyww > adj.week GROUP BY ALL),
hh AS (SELECT p.*, 1 / (1 + pow(10.0::DOUBLE, -gap / 400)) AS other, unnest(CASE WHEN league_code = 'UCL' THEN ['all', 'continental'] ELSE ['all'] END) AS scope FROM p JOIN av USING (result_id)),
hs AS (SELECT scope, count(*) AS n, round(avg(abs(expected - actual)), 6) AS raw_mae, round(avg(abs(other - actual)), 6) AS adjusted_mae, round(sqrt(avg(pow(expected - actual, 2))), 6) AS raw_rmse, round(sqrt(avg(pow(other - actual, 2))), 6) AS adjusted_rmse FROM hh GROUP BY scope)
SELECT *, CASE WHEN adjusted_mae < raw_mae THEN 'adjusted' ELSE 'raw' END AS better FROM hs"""),
        "EV11_calibration_report": sql("fbsp", ", v AS (SELECT round(floor(round(expected, 9) / 0.05::DOUBLE) * 0.05::DOUBLE, 6) AS bin, count(*) AS n, avg(actual) - avg(round(expected, 9)) AS gap FROM p GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*) AS bins, round(sum(abs(gap) * n) / sum(n), 5) AS calibration_error, round(max(abs(gap)), 5) AS widest_gap, count(*) FILTER (n < 30) AS small_bins FROM v"),
        "Q02_teams": sql("fcbsw", "SELECT DISTINCT lower(country_name) AS country, pid, club_name FROM w"),
        "Q05_timeseries": sql("fbs", "SELECT pid, week, (date_trunc('week', make_date(week // 100, 1, 4))::DATE + ((week % 100 - 1) * 7)::INT)::DATE AS monday, round(rating, 1) AS rating, round(coalesce(rating - lag(rating) OVER (PARTITION BY pid ORDER BY week), 0), 1) AS change FROM s"),
        "Q09_identity": sql("fcbsw", "SELECT pid, club_name, country_name, min(week) AS first_week, max(week) AS last_week, count(*) AS weeks FROM w GROUP BY ALL"),
        "Q15_search": sql("fcbswl", ", v AS (SELECT pid, club_name, country_name, round(rating, 5) AS rating FROM l), z AS (SELECT *, row_number() OVER (ORDER BY rating DESC, pid) AS place FROM v) SELECT * FROM z WHERE contains(lower(club_name), '0007') AND lower(country_name) = 'nation_7'"),
        "Q17_rated_countries": sql("fcbsw", "SELECT country_name, round(max(rating), 5) AS peak, round(avg(rating), 5) AS mean, count(DISTINCT pid) AS clubs, count(DISTINCT week) AS weeks FROM w GROUP BY ALL"),
    }
