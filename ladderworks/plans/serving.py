"""Queries over the weekly history: ladders, snapshots, series, club pages, narratives' facts.

``weekly`` has week, pid, rating, rd and the club's club_name, country_name; ``matches`` are fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.functions.scoring import elo_expected, score
from ladderworks.operators.asof import asof_before, snapshot
from ladderworks.operators.ratings import both_sides


def named(weekly: DataFrame, clubs: DataFrame) -> DataFrame:
    """Names and countries of clubs; an unknown club is called Club_<id>."""
    own = clubs.select(F.col("club_id").alias("pid"), "club_name", "country_name")
    return weekly.join(own, "pid", "left").withColumn("club_name", F.coalesce("club_name", F.concat(F.lit("Club_"), F.col("pid").cast("string"))))


def ladder(weekly: DataFrame) -> DataFrame:
    """Places by week, over all and within the country; ties by id."""
    order = [F.desc("rating"), F.col("pid")]
    return weekly.select("week", "pid", "country_name", "rating", F.row_number().over(Window.partitionBy("week").orderBy(*order)).alias("place"), F.row_number().over(Window.partitionBy("week", "country_name").orderBy(*order)).alias("domestic_place"))


def movement(weekly: DataFrame) -> DataFrame:
    """Change and relative change of the rating since the club's previous week; 0 in its first."""
    before = F.lag("rating").over(Window.partitionBy("pid").orderBy("week"))
    return weekly.select("week", "pid", "rating", F.coalesce(F.col("rating") - before, F.lit(0.0)).alias("change"), F.coalesce(F.col("rating") / before - 1, F.lit(0.0)).alias("change_share"))


def latest(weekly: DataFrame) -> DataFrame:
    """Each club's last row."""
    return weekly.groupBy("pid").agg(F.max_by(F.struct(*[c for c in weekly.columns if c != "pid"]), "week").alias("r")).select("pid", "r.*")


def top_snapshot(weekly: DataFrame, n: int = 20, offset: int = 0) -> DataFrame:
    return latest(weekly).orderBy(F.desc("rating"), "pid").offset(offset).limit(n)


def top_by_country(weekly: DataFrame, n: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("country_name").orderBy(F.desc("rating"), "pid"))
    return latest(weekly).withColumn("place", place).where(F.col("place") <= n).select("country_name", "place", "pid", "club_name", "rating")


def country_weeks(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("country_name", "week").agg(F.avg("rating").alias("mean_rating"), F.max("rating").alias("max_rating"), F.min("rating").alias("min_rating"), F.countDistinct("pid").alias("clubs"))


def country_summaries(weekly: DataFrame) -> DataFrame:
    """Per country: mean and best rating of the clubs' last rows, their number and the best club (ties by id)."""
    return latest(weekly).groupBy("country_name").agg(F.avg("rating").alias("mean_rating"), F.max("rating").alias("max_rating"), F.count("*").alias("clubs"), F.max_by("club_name", F.struct("rating", -F.col("pid"))).alias("top_club"))


def top_series(weekly: DataFrame, n: int = 3) -> DataFrame:
    """Whole series of each country's best clubs of today."""
    return weekly.join(top_by_country(weekly, n).select("pid"), "pid", "left_semi").select("country_name", "pid", "week", "rating")


def activity(matches: DataFrame) -> DataFrame:
    """Matches of a club by calendar year of the packed week."""
    return both_sides(matches, ["yyyyww"]).groupBy("pid", F.floor(F.col("yyyyww") / 100).cast("int").alias("year")).agg(F.count("*").alias("matches"))


def active_clubs(matches: DataFrame, years: list[int], more_than: int) -> DataFrame:
    """Clubs with more than so many matches in each of the years, a column for each."""
    table = activity(matches).groupBy("pid").pivot("year", years).agg(F.sum("matches")).na.fill(0)
    for y in years:
        table = table.where(F.col(str(y)) > more_than)
    return table.select("pid", *[F.col(str(y)).alias(f"y{y}") for y in years])


def prior_ratings(matches: DataFrame, weekly: DataFrame) -> DataFrame:
    """Each side of a match with its last rating of an earlier week; 1500 and 350 before the first."""
    sides = both_sides(matches, ["result_id", "yyyyww"]).select("result_id", "yyyyww", "pid", "opponent", "score")
    found = asof_before(sides, weekly.select("pid", "week", "rating", "rd"), "pid", "yyyyww", "week", ["rating", "rd"])
    return found.select("result_id", "yyyyww", "pid", "opponent", "score", F.coalesce("rating", F.lit(1500.0)).alias("pre_rating"), F.coalesce("rd", F.lit(350.0)).alias("pre_rd"))


def predictions(matches: DataFrame, weekly: DataFrame) -> DataFrame:
    """Expectation of the home side from both sides' earlier ratings, the result, and by how much they differ."""
    prior = prior_ratings(matches, weekly).select("result_id", "pid", F.col("pre_rating"))
    both = prior.groupBy("result_id").agg(F.collect_list(F.struct("pid", "pre_rating")).alias("_sides"))  # two of a match
    pre = lambda x: F.filter("_sides", lambda v: v["pid"] == F.col(f"{x}_club_id"))[0]["pre_rating"]
    rows = matches.join(both, "result_id").select(*matches.columns, pre("home").alias("home_pre"), pre("away").alias("away_pre"))
    rows = rows.withColumns({"expected": elo_expected(F.col("home_pre") - F.col("away_pre")), "actual": score(F.col("home_team_goals"), F.col("away_team_goals"))})
    return rows.select("result_id", "yyyyww", "league_code", "home_club_id", "away_club_id", "home_pre", "away_pre", "expected", "actual", F.abs(F.col("actual") - F.col("expected")).alias("upset"))


def known_before(weekly: DataFrame, columns: list[str]) -> DataFrame:
    """(week, pid, ...): every club's last row before each week, for all weeks after its first.

    A row lasts from the week after its own to the club's next one. Weeks are numbered by the calendar, so a row lists the
    numbers that it lasts for and meets the weeks by an equi-join.
    """
    spine = weekly.select("week").distinct().withColumn("_i", F.row_number().over(Window.orderBy("week")))  # one row a week
    last = F.broadcast(spine.agg(F.max("_i").alias("_last")))
    rows = weekly.select("week", "pid", *columns).join(F.broadcast(spine), "week").crossJoin(last)
    stop = F.coalesce(F.lead("_i").over(Window.partitionBy("pid").orderBy("_i")), F.col("_last"))
    held = rows.withColumn("_stop", stop).where(F.col("_stop") > F.col("_i")).withColumn("_i", F.explode(F.sequence(F.col("_i") + 1, F.col("_stop"))))
    return held.drop("week").join(F.broadcast(spine), "_i").select("week", "pid", *columns)


def snapshot_changes(weekly: DataFrame, matches: DataFrame) -> DataFrame:
    """Ratings of both sides in the snapshot week before the match's, where a snapshot has only clubs of that week.

    The calendar of weeks is small: one row a week."""
    spine = weekly.select("week").distinct()
    before = spine.select(F.col("week").alias("yyyyww"), F.lag("week").over(Window.orderBy("week")).alias("before"))
    rows = matches.join(F.broadcast(before), "yyyyww", "left")
    for x in ("home", "away"):
        own = weekly.select(F.col("week").alias("before"), F.col("pid").alias(f"{x}_club_id"), F.col("rating").alias(f"{x}_before"))
        rows = rows.join(own, ["before", f"{x}_club_id"], "left")
    return rows.select("result_id", "yyyyww", "before", F.coalesce("home_before", F.lit(1500.0)).alias("home_before"), F.coalesce("away_before", F.lit(1500.0)).alias("away_before"))


def club_matches(matches: DataFrame, clubs: DataFrame, top: int = 3) -> DataFrame:
    """Per club its widest wins and heaviest defeats, ``top`` of each."""
    rows = both_sides(matches, ["result_id", "match_date"]).withColumn("margin", F.col("goals") - F.col("conceded"))
    w = Window.partitionBy("pid")
    best, worst = F.row_number().over(w.orderBy(F.desc("margin"), "result_id")), F.row_number().over(w.orderBy("margin", "result_id"))
    rows = rows.withColumns({"best": best, "worst": worst}).where((F.col("best") <= top) | (F.col("worst") <= top))
    names = clubs.select(F.col("club_id").alias("opponent"), F.col("club_name").alias("opponent_name"))
    return rows.join(names, "opponent", "left").select("pid", "result_id", "match_date", "opponent_name", "at_home", "goals", "conceded", "margin", (F.col("best") <= top).alias("is_best"))


def biggest_upsets(predicted: DataFrame, top: int = 3) -> DataFrame:
    """Per club the matches whose result differed most from the expectation."""
    rows = predicted.select("result_id", "yyyyww", "upset", "expected", "actual", F.explode(F.array("home_club_id", "away_club_id")).alias("pid"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc(F.round("upset", 9)), "result_id"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("pid", "place", "result_id", "yyyyww", "upset")


def top_presence(weekly: DataFrame, top: int = 10) -> DataFrame:
    """Per country: how many of the top places it held on average, lately and at most, over every week there is."""
    held = ladder(weekly).groupBy("country_name", "week").agg(F.sum((F.col("place") <= top).cast("long")).alias("held"))
    spine = weekly.select("week").distinct().crossJoin(F.broadcast(weekly.select("country_name").distinct()))  # countries by weeks: calendars
    dense = spine.join(held, ["country_name", "week"], "left").na.fill(0, ["held"])
    return dense.groupBy("country_name").agg(F.avg("held").alias("mean_held"), F.max_by("held", "week").alias("latest_held"), F.max("held").alias("most_held"), F.avg((F.col("held") > 0).cast("double")).alias("share_of_weeks"))


def club_extremes(weekly: DataFrame) -> DataFrame:
    """Per club: peak, mean, best rise from one week to the next, weeks as the country's first."""
    rows = movement(weekly).join(ladder(weekly).select("week", "pid", "country_name", "domestic_place"), ["week", "pid"])
    return rows.groupBy("country_name", "pid").agg(F.max("rating").alias("peak"), F.avg("rating").alias("mean_rating"), F.max("change").alias("best_rise"), F.sum((F.col("domestic_place") == 1).cast("long")).alias("weeks_first"))


def map_layer(summaries: DataFrame) -> DataFrame:
    """Countries with a heat (best rating, else mean, else 1500) scaled to marker sizes 12 to 28; 16 where all are equal."""
    heat = F.coalesce("max_rating", "mean_rating", F.lit(1500.0))
    low, high = (f("heat").over(Window.partitionBy(F.lit(1))) for f in (F.min, F.max))  # one row a country
    rows = summaries.select("country_name", heat.alias("heat"))
    return rows.select("country_name", "heat", F.when(high > low, 12 + 16 * (F.col("heat") - low) / (high - low)).otherwise(16.0).alias("marker"))


def current(weekly: DataFrame) -> DataFrame:
    return snapshot(weekly)
