"""Facts of clubs' and countries' histories and the sentences that they make, for all clubs and countries in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.plans.common import rounded, sql, weekly

#: Ladder sizes of the shares, the weeks a ladder warms up, weeks a year, and the slope a year that counts as a trend.
OWN_SIZES, ALL_SIZES = (5, 10, 25), (25, 50, 100)
WARM_UP, YEAR, TREND = 52, 52, 0.35


def trend_word(slope: Column) -> Column:
    return F.when(slope > TREND, "rose").when(slope < -TREND, "fell").otherwise("held roughly steady")


def warmed(rows: DataFrame) -> DataFrame:
    """With ``warm``: whether the week comes after the warm-up. Where there are no such weeks, all count."""
    spine = rows.select("week").distinct().withColumn("i", F.row_number().over(Window.orderBy("week")))  # a calendar
    spine = spine.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return rows.join(F.broadcast(spine.select("week", ((F.col("i") > WARM_UP) | (F.col("n") <= WARM_UP)).alias("warm"))), "week")


def movement(value: str, by: list[str]) -> tuple[Column, Column]:
    """Columns of a series' index from 0 and its steps."""
    order = Window.partitionBy(*by).orderBy("week")
    return (F.row_number().over(order) - 1).alias("x"), (F.col(value) - F.lag(value).over(order)).alias("step")


def slope_and_volatility(value: str) -> list[Column]:
    slope = F.when(F.count("*") >= 3, F.regr_slope(F.col(value), F.col("x").cast("double")) * YEAR).otherwise(0.0)
    return [slope.alias("slope_per_year"), F.coalesce(F.stddev_pop("step"), F.lit(0.0)).alias("volatility")]


def placed(rows: DataFrame) -> DataFrame:
    """Places by week, in the own country and over all; ties by id."""
    order = [F.desc("rating"), F.col("pid")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("own_place", place("week", "country_name")).withColumn("place", place("week"))


def team_facts(s, d):
    """A row for each club. Places come from the weeks after the warm-up, or from all where a club has none of those."""
    x, step = movement("rating", ["pid"])
    used = F.col("warm") | ~F.max("warm").over(Window.partitionBy("pid"))
    rows = placed(warmed(weekly(s, d))).select("*", x, step, used.alias("used"))
    on = lambda value: F.when(F.col("used"), value)
    share = lambda place, size: F.avg(on((F.col(place) <= size).cast("double")))
    facts = rows.groupBy("pid").agg(
        F.max("club_name").alias("club_name"), F.max("country_name").alias("country_name"),
        F.count("*").alias("rated_weeks"), F.count_if("used").alias("ladder_weeks"),
        F.max_by("rating", "week").alias("latest_rating"), F.avg("rating").alias("mean_rating"), *slope_and_volatility("rating"),
        *[f(on(F.col(p))).alias(f"{n}_{p}") for p in ("own_place", "place") for n, f in (("mean", F.avg), ("best", F.min))],
        *[F.max_by(p, "week").alias(f"latest_{p}") for p in ("own_place", "place")],
        *[share("own_place", k).alias(f"own_top_{k}") for k in OWN_SIZES], *[share("place", k).alias(f"top_{k}") for k in ALL_SIZES],
    )
    return rounded(facts.withColumn("trend", trend_word(F.col("slope_per_year"))))


def country_facts(s, d):
    """A row for each country that has a week after the warm-up; presence is the share of its weeks with a club in the top."""
    rows = placed(warmed(weekly(s, d))).where("warm")
    week = rows.groupBy("country_name", "week").agg(
        F.avg("rating").alias("mean_rating"), (F.max("rating") - F.min("rating")).alias("spread"), F.count("*").alias("clubs"), F.min("place").alias("best"),
    )
    x, step = movement("mean_rating", ["country_name"])
    last = lambda c: F.max_by(c, "week").alias(f"latest_{c}")
    facts = week.select("*", x, step).groupBy("country_name").agg(
        F.count("*").alias("weeks"), F.min("week").alias("first_week"), F.max("week").alias("last_week"), last("mean_rating"), F.avg("mean_rating").alias("history_mean"),
        last("spread"), F.avg("spread").alias("mean_spread"), last("clubs"), F.avg("clubs").alias("mean_clubs"), *slope_and_volatility("mean_rating"),
        *[F.avg((F.col("best") <= k).cast("double")).alias(f"presence_{k}") for k in ALL_SIZES],
    )
    return rounded(facts.withColumn("trend", trend_word(F.col("slope_per_year"))))


def team_narrative(s, d):
    """A sentence for each club."""
    text = "%s (%s) has %d rated weeks; its rating %s. Place %d at home, %d at best; place %d over all, %d at best."
    columns = ("club_name", "country_name", "rated_weeks", "trend", "latest_own_place", "best_own_place", "latest_place", "best_place")
    return team_facts(s, d).select("pid", F.format_string(text, *columns).alias("text"))


def country_narrative(s, d):
    """A sentence for each country."""
    text = "%s: %d weeks from %d to %d, %d clubs of late; the mean rating %s and is %s its history."
    against = F.when(F.col("latest_mean_rating") > F.col("history_mean"), "above").otherwise("not above")
    columns = ("country_name", "weeks", "first_week", "last_week", "latest_clubs", "trend", against)
    return country_facts(s, d).select("country_name", F.format_string(text, *columns).alias("text"))


QUERIES = {"TS06_country_facts": country_facts, "TS07_team_facts": team_facts, "Q11_country_narrative": country_narrative, "Q12_team_narrative": team_narrative}


def _team_sql() -> str:
    shares = "".join(f", avg((own_place <= {k})::INT) FILTER (used) AS own_top_{k}" for k in OWN_SIZES)
    shares += "".join(f", avg((place <= {k})::INT) FILTER (used) AS top_{k}" for k in ALL_SIZES)
    return f"""{_PLACED},
rx AS (SELECT *, row_number() OVER o - 1 AS x, rating - lag(rating) OVER o AS step, warm OR NOT bool_or(warm) OVER (PARTITION BY pid) AS used
  FROM r WINDOW o AS (PARTITION BY pid ORDER BY week)),
tf AS (SELECT pid, max(club_name) AS club_name, max(country_name) AS country_name, count(*) AS rated_weeks, count(*) FILTER (used) AS ladder_weeks,
  arg_max(rating, week) AS latest_rating, avg(rating) AS mean_rating, CASE WHEN count(*) >= 3 THEN regr_slope(rating, x) * {YEAR} ELSE 0 END AS slope_per_year,
  coalesce(stddev_pop(step), 0) AS volatility, avg(own_place) FILTER (used) AS mean_own_place, min(own_place) FILTER (used) AS best_own_place,
  avg(place) FILTER (used) AS mean_place, min(place) FILTER (used) AS best_place, arg_max(own_place, week) AS latest_own_place,
  arg_max(place, week) AS latest_place{shares} FROM rx GROUP BY pid)"""


_PLACED = f""", v AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM w)),
r AS (SELECT w.*, v.i > {WARM_UP} OR v.n <= {WARM_UP} AS warm, row_number() OVER (PARTITION BY week, country_name ORDER BY rating DESC, pid) AS own_place,
  row_number() OVER (PARTITION BY week ORDER BY rating DESC, pid) AS place FROM w JOIN v USING (week))"""
_TREND = f"CASE WHEN slope_per_year > {TREND} THEN 'rose' WHEN slope_per_year < -{TREND} THEN 'fell' ELSE 'held roughly steady' END"


def _country_sql() -> str:
    presence = "".join(f", avg((best <= {k})::INT) AS presence_{k}" for k in ALL_SIZES)
    return f"""{_PLACED},
cw AS (SELECT country_name, week, avg(rating) AS mean_rating, max(rating) - min(rating) AS spread, count(*) AS clubs, min(place) AS best FROM r WHERE warm GROUP BY ALL),
cx AS (SELECT *, row_number() OVER o - 1 AS x, mean_rating - lag(mean_rating) OVER o AS step FROM cw WINDOW o AS (PARTITION BY country_name ORDER BY week)),
cf AS (SELECT country_name, count(*) AS weeks, min(week) AS first_week, max(week) AS last_week, arg_max(mean_rating, week) AS latest_mean_rating,
  avg(mean_rating) AS history_mean, arg_max(spread, week) AS latest_spread, avg(spread) AS mean_spread, arg_max(clubs, week) AS latest_clubs,
  avg(clubs) AS mean_clubs, CASE WHEN count(*) >= 3 THEN regr_slope(mean_rating, x) * {YEAR} ELSE 0 END AS slope_per_year,
  coalesce(stddev_pop(step), 0) AS volatility{presence} FROM cx GROUP BY country_name)"""


def oracle_sql() -> dict[str, str]:
    team, country = _team_sql(), _country_sql()
    near = lambda *names: ", ".join(f"round({n}, 5) AS {n}" for n in names)
    tops = [f"own_top_{k}" for k in OWN_SIZES] + [f"top_{k}" for k in ALL_SIZES]
    teams = near("latest_rating", "mean_rating", "slope_per_year", "volatility", "mean_own_place", "mean_place", *tops)
    presence = [f"presence_{k}" for k in ALL_SIZES]
    countries = near("latest_mean_rating", "history_mean", "latest_spread", "mean_spread", "mean_clubs", "slope_per_year", "volatility", *presence)
    return {
        "TS06_country_facts": sql("fcbsw", f"{country} SELECT country_name, weeks, first_week, last_week, latest_clubs, {countries}, {_TREND} AS trend FROM cf"),
        "TS07_team_facts": sql(
            "fcbsw",
            f"{team} SELECT pid, club_name, country_name, rated_weeks, ladder_weeks, best_own_place, best_place, latest_own_place, latest_place, {teams}, {_TREND} AS trend FROM tf",
        ),
        "Q11_country_narrative": sql(
            "fcbsw",
            f"""{country} SELECT country_name, country_name || ': ' || weeks || ' weeks from ' || first_week || ' to ' || last_week || ', ' || latest_clubs || ' clubs of late; the mean rating '
  || {_TREND} || ' and is ' || CASE WHEN round(latest_mean_rating, 5) > round(history_mean, 5) THEN 'above' ELSE 'not above' END || ' its history.' AS text FROM cf""",
        ),
        "Q12_team_narrative": sql(
            "fcbsw",
            f"""{team} SELECT pid, club_name || ' (' || country_name || ') has ' || rated_weeks || ' rated weeks; its rating ' || {_TREND} || '. Place ' || latest_own_place || ' at home, '
  || best_own_place || ' at best; place ' || latest_place || ' over all, ' || best_place || ' at best.' AS text FROM tf""",
        ),
    }
