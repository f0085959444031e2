"""Queries that attach ranks, attributes, connectivity and coordinates to final ratings, and that pick what stands for strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.operators import connectivity
from ladderworks.operators.upsert import keep_first
from ladderworks.plans import serving
from ladderworks.plans.common import layer_now, rounded, sql, weekly
from ladderworks.sources.fixtures import fixtures, table


def attached(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """All columns of ``extra`` that the rows lack, by a left join on the key; of several rows of a key the first by its columns counts."""
    new = [c for c in extra.columns if c == key or c not in rows.columns]
    return rows.join(keep_first(extra.select(new), [key], [F.col(c) for c in new]), key, "left")


def strength_column(rows: DataFrame, names: list[str]) -> str:
    """The first of the columns that is there and has a value. One row comes to the driver."""
    there = [n for n in names if n in rows.columns]
    if not there:
        raise ValueError(f"none of {', '.join(names)}")
    counts = rows.agg(*[F.count(n).alias(n) for n in there]).first()
    return next((n for n in there if counts[n]), there[0])


def _final(s, d):
    return serving.latest(weekly(s, d)).select("pid", "week", "rating", "rd")


def ranked(s, d):
    """Final ratings with an external rank, that of the suppliers in credit by balance; others have none."""
    credit = table(s, d, "supplier").where("s_acctbal > 0")
    # A place is one more than the greater balances: they are counted by value, so few rows are sorted together.
    levels = credit.groupBy("s_acctbal").agg(F.count("*").alias("n")).withColumn("hundred", F.floor(F.col("s_acctbal") / 100))
    blocks = levels.groupBy("hundred").agg(F.sum("n").alias("n"))
    above = blocks.select("hundred", F.coalesce(F.sum("n").over(_down("hundred")), F.lit(0)).alias("before"))
    place = levels.join(F.broadcast(above), "hundred").select("s_acctbal", (F.col("before") + F.coalesce(F.sum("n").over(_down("s_acctbal", "hundred")), F.lit(0)) + 1).alias("rank"))
    ranks = credit.join(place, "s_acctbal").select(F.col("s_suppkey").alias("pid"), "rank")
    return rounded(attached(_final(s, d), ranks, "pid"))


def _down(column: str, *keys: str):
    """Everything above a row by falling ``column``."""
    return Window.partitionBy(*keys).orderBy(F.desc(column)).rowsBetween(Window.unboundedPreceding, -1)


def attributes(s, d):
    """Final ratings with whatever else is known of a club; a column that both have stays as the ratings have it."""
    known = table(s, d, "supplier").select(F.col("s_suppkey").alias("pid"), "s_name", "s_nationkey", F.lit(0.0).alias("rating"))
    return rounded(attached(_final(s, d), known.unionByName(known.withColumn("s_name", F.concat(F.lit("~"), "s_name"))), "pid"))


def with_connectivity(s, d):
    """Final ratings with the connectivity layer's columns of the last week, one row a club; null where it has none."""
    now, edges, final = layer_now(s, d)
    return rounded(attached(final, connectivity.adjust(now, edges, opponents=False).select("pid", "effective", "total_rd", "trust", "baseline", "adjusted"), "pid"))


def on_map(s, d):
    """Country summaries with coordinates; countries without any are left out."""
    places = table(s, d, "nation").where("n_nationkey % 5 < 3").select(F.col("n_name").alias("country_name"), (F.col("n_nationkey") * 3.5 - 40).alias("lat"), (F.col("n_nationkey") * 7.25 - 90).alias("lon"))
    return rounded(serving.country_summaries(weekly(s, d)).select("country_name", "mean_rating", "clubs").join(F.broadcast(places), "country_name"))  # a row a country


def whole_rows(s, d):
    """Matches of which no earlier row says the same in all columns but the id."""
    f = fixtures(s, d)
    again = f.where("away_club_id % 4 = 0").withColumn("result_id", F.col("result_id") + 10_000_000)
    rows = f.unionByName(again)
    return keep_first(rows, [c for c in rows.columns if c != "result_id"], [F.col("result_id")]).select("result_id", "match_date", "home_club_id")


def strengths(s, d):
    """The final ratings' strength: adjusted would come first, but has no value."""
    rows = _final(s, d).withColumn("adjusted", F.lit(None).cast("double"))
    return rounded(rows.select("pid", F.col(strength_column(rows, ["simple_adjusted", "adjusted", "rating"])).alias("strength")))


QUERIES = {
    "J03_ranked_ratings": ranked, "J04_attributes": attributes, "J07_final_connectivity": with_connectivity, "J21_coordinates": on_map, "DED01_whole_rows": whole_rows, "PRJ11_strengths": strengths,
}


def oracle_sql() -> dict[str, str]:
    final = "l.pid, l.week, round(l.rating, 5) AS rating, round(l.rd, 5) AS rd"
    return {
        "J03_ranked_ratings": sql("fcbswl", f", k AS (SELECT s_suppkey AS pid, rank() OVER (ORDER BY s_acctbal DESC) AS rank FROM supplier WHERE s_acctbal > 0) SELECT {final}, rank FROM l LEFT JOIN k USING (pid)"),
        "J04_attributes": sql("fcbswl", f" SELECT {final}, s_name, s_nationkey FROM l LEFT JOIN supplier ON s_suppkey = pid"),
        "J07_final_connectivity": sql("fcbsweg", f", l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY pid ORDER BY week DESC) = 1), x AS (SELECT pid, effective, total_rd, trust, baseline, adjusted FROM adj WHERE week = (SELECT max(week) FROM adj)) SELECT {final}, round(effective, 5) AS effective, round(total_rd, 5) AS total_rd, round(trust, 5) AS trust, round(x.baseline, 5) AS baseline, round(adjusted, 5) AS adjusted FROM l LEFT JOIN x USING (pid)"),
        "J21_coordinates": sql("fcbswl", " SELECT country_name, round(avg(rating), 5) AS mean_rating, count(*) AS clubs, any_value(n_nationkey) * 3.5::DOUBLE - 40 AS lat, any_value(n_nationkey) * 7.25::DOUBLE - 90 AS lon FROM l JOIN nation ON n_name = country_name WHERE n_nationkey % 5 < 3 GROUP BY country_name"),
        "DED01_whole_rows": sql("f", " SELECT min(result_id) AS result_id, match_date, home_club_id FROM f GROUP BY match_date, home_club_id, away_club_id, home_team_goals, away_team_goals, league_code, yyyyww"),
        "PRJ11_strengths": sql("fcbswl", " SELECT pid, round(rating, 5) AS strength FROM l"),
    }
