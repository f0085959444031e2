"""Queries of row-wise functions: dates, names, scales, payloads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderworks.functions import labels, names, scoring, weeks
from ladderworks.operators import connectivity
from ladderworks.plans.common import rounded, sql, weekly
from ladderworks.plans.serving import latest
from ladderworks.sources.fixtures import clubs, fixtures, table


def _by(group, *order):
    return Window.partitionBy(group).orderBy(*order)


def _years(s, d):
    return fixtures(s, d).select(F.year("match_date").alias("year")).distinct()


def seasons(s, d):
    y = F.col("year")
    short, next_short = F.substring(y.cast("string"), 3, 2), F.substring((y + 1).cast("string"), 3, 2)
    texts = {
        "split": F.concat_ws("/", short, next_short), "start_year": y.cast("string"), "end_year": (y + 1).cast("string"),
        "compact": F.concat(short, next_short), "dashed": F.concat_ws("-", y, y + 1),
    }
    return _years(s, d).select("year", *[labels.season_label(t, k).alias(k) for k, t in texts.items()], labels.season_label(F.lit("x"), "start_year").alias("unknown"))


def histories(s, d):
    y = F.col("year")
    after = F.substring((y + 1).cast("string"), 3, 2)
    return _years(s, d).select("year", labels.history_label(F.concat_ws("-", y, y + 1)).alias("long"), labels.history_label(F.concat_ws(" – ", y, after)).alias("short"), labels.history_label(F.concat_ws("/", y, y + 1)).alias("slash"), labels.history_label(y.cast("string")).alias("single"))


def season_days(s, d):
    day = F.col("match_date")
    return fixtures(s, d).select("match_date").distinct().select("match_date", labels.season_name(day).alias("season"), labels.season_name(day, "end_year").alias("season_by_end"))


def overlaps(s, d):
    span = F.concat_ws("/", F.substring(F.col("year").cast("string"), 3, 2), F.substring((F.col("year") + 1).cast("string"), 3, 2))
    rows = _years(s, d)
    other = rows.select(F.col("year").alias("asked"))
    return rows.crossJoin(F.broadcast(other)).select("year", "asked", labels.season_meets_year(span, F.col("asked")).alias("by_span"), labels.season_meets_year(F.col("year").cast("string"), F.col("asked")).alias("by_year"), labels.season_meets_year(F.lit("all"), F.col("asked")).alias("unknown"))  # years alone: a calendar


def kickoffs(s, d):
    seconds = F.col("event_id") * 3607 + 867715200
    day, time, year = labels.kickoff(seconds)
    return table(s, d, "events").select("event_id", day.alias("day"), time.alias("time"), year.alias("year"))


def kickoff_year(s, d):
    return kickoffs(s, d).where("year = 1998").select("event_id", "day")


def week_variants(s, d):
    day = F.col("match_date")
    number = F.weekofyear(day)
    rows = fixtures(s, d).select("match_date").distinct()
    return rows.select("match_date", weeks.packed_week(day).alias("clipped"), weeks.packed_week(day, clip=False).alias("unclipped"), (F.year(day) * 100 + F.least(number, F.lit(52))).cast("int").alias("calendar"))


def dates(s, d):
    day = F.col("match_date")
    rows = fixtures(s, d).select("match_date").distinct()
    forms = {"iso": "yyyy-MM-dd", "long": "dd/MM/yyyy", "short": "dd/MM/yy"}
    return rows.select("match_date", *[weeks.parse_date(F.date_format(day, f)).alias(k) for k, f in forms.items()], weeks.parse_date(F.lit("soon")).alias("unknown"))


def captions(s, d):
    return fixtures(s, d).select("yyyyww").distinct().select("yyyyww", F.date_format(weeks.week_monday(F.col("yyyyww")), "MMMM yyyy").alias("caption"))


def midnights(s, d):
    return table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


def event_ids(s, d):
    return fixtures(s, d).select("result_id", F.concat_ws("_", F.date_format("match_date", "yyyyMMdd"), "home_club_id", "away_club_id").alias("event_id"))


def codes(s, d):
    code = F.col("league_code")
    return fixtures(s, d).groupBy("league_code").agg(F.count("*").alias("n")).select("league_code", "n", F.endswith(F.upper(F.trim(code)), F.lit("CUP")).alias("is_cup"), F.contains(F.upper(code), F.lit("FRIENDLY")).alias("is_friendly"), connectivity.community_suffix(code).alias("suffix"), connectivity.match_weight(code).alias("weight"))


def first_parts(s, d):
    rows = connectivity.weighted_fixtures(fixtures(s, d), clubs(s, d))
    return rows.groupBy(F.get(F.split("home_community", r"\|"), F.lit(0)).alias("country")).agg(F.count("*").alias("n"))


def number_lists(s, d):
    text = F.concat_ws(", ", F.col("p_size") * 3, F.lit("x"), F.col("p_size"), F.col("p_size") * 20, F.col("p_size"))
    return table(s, d, "part").select("p_partkey", F.array_join(labels.cutoffs(text, [25, 50, 100], 5, 500, 8).cast("array<string>"), ",").alias("cutoffs"))


def titles(s, d):
    return table(s, d, "part").select("p_partkey", labels.title(F.concat_ws("-", "p_name", F.lower("p_type"))).alias("title"))


def lists(s, d):
    best = latest(weekly(s, d)).withColumn("place", F.row_number().over(_by("country_name", F.desc("rating"), "pid"))).where("place <= 3")
    named = best.groupBy("country_name").agg(F.sort_array(F.collect_list(F.struct("place", "club_name"))).alias("top"), F.round(F.avg("rating") - 1500, 1).alias("lead"))
    return named.select("country_name", names.oxford_list(F.col("top.club_name")).alias("clubs"), labels.signed(F.col("lead")).alias("lead"))


def file_keys(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://data.example/files/"), F.col("p_size") + 9700, F.lit("/e"), "p_size", F.lit(".csv"))).otherwise(F.concat(F.lit("https://data.example/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit(".php"))).alias("url"))
    folder, league = labels.file_key(F.col("url"))
    return p.select("p_partkey", folder.alias("folder"), league.alias("league"))


def internal_scale(s, d):
    mu, phi = (F.col("rating") - 1500.0) / scoring.SCALE, F.col("rd") / scoring.SCALE
    rows = latest(weekly(s, d)).select("pid", mu.alias("mu"), phi.alias("phi"))
    return rounded(rows.select("pid", "mu", "phi", (F.col("mu") * scoring.SCALE + 1500).alias("rating"), scoring.g(F.col("phi")).alias("g"), scoring.expected(F.lit(0.0), F.col("mu"), F.col("phi")).alias("expected")))


def bins(s, d):
    return table(s, d, "lineitem").groupBy(scoring.fixed_bin(F.col("l_discount") * 100 + 0.5, 2.0).alias("bin")).agg(F.count("*").alias("n"))


def rank_curves(s, d):
    """Rating as a - b ln(rank) over each country's clubs; the defaults where it has fewer than ten."""
    rows = latest(weekly(s, d)).withColumn("place", F.row_number().over(_by("country_name", F.desc("rating"), "pid")))
    fit = rows.groupBy("country_name").agg(F.count("*").alias("n"), F.regr_intercept("rating", F.log("place")).alias("a"), F.regr_slope("rating", F.log("place")).alias("b"))
    enough = F.col("n") >= 10
    return rounded(fit.select("country_name", "n", F.when(enough, F.col("a")).otherwise(3000.0).alias("intercept"), F.when(enough, -F.col("b")).otherwise(160.0).alias("log_coefficient")), 4)


def clipped(s, d):
    n, q = F.col("s_acctbal"), F.greatest(F.lit(1e-9), F.col("s_suppkey").cast("double"))
    return rounded(table(s, d, "supplier").select("s_suppkey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), n / 5000)).alias("clipped"), F.when(F.col("s_suppkey") > 0, n / q).otherwise(0.0).alias("ratio"), (1 - F.exp(-F.col("s_suppkey") / 24.0)).alias("exponential")), 4)


def _payloads(s, d):
    """Events as raw payloads, as a source would send them: every 11th lacks a score, every 13th a home side."""
    e = table(s, d, "events")
    goals = F.when(F.col("event_id") % 11 > 0, F.struct((F.col("user_id") % 5).alias("current")))
    status = F.struct(F.when(F.col("event_type") == "error", "inprogress").when(F.col("event_type") == "click", "finished").otherwise("notstarted").alias("type"))
    body = F.struct(F.col("event_id").alias("id"), (F.col("event_id") * 3607 + 867715200).alias("startTimestamp"), F.struct(F.when(F.col("event_id") % 13 > 0, F.concat(F.lit("Club "), "user_id")).alias("name")).alias("homeTeam"), F.struct(F.lit("Visitors").alias("name")).alias("awayTeam"), goals.alias("homeScore"), F.struct(F.lit(1).alias("normaltime")).alias("awayScore"), status.alias("status"))
    return e.select(F.to_json(body).alias("payload"))


#: The payload's fields; goals come in two shapes.
PAYLOAD = "id bigint, startTimestamp bigint, homeTeam struct<name: string>, awayTeam struct<name: string>, homeScore struct<current: int, normaltime: int>, awayScore struct<current: int, normaltime: int>, status struct<type: string>"


def flat_matches(s, d):
    p = _payloads(s, d).select(F.from_json("payload", PAYLOAD).alias("p")).select("p.*")
    day, time, _ = labels.kickoff(F.col("startTimestamp"))
    goals = lambda x: F.coalesce(F.col(f"{x}.current"), F.col(f"{x}.normaltime"))
    return p.select(F.col("id").alias("match_id"), day.alias("match_date"), time.alias("match_time"), F.col("homeTeam.name").alias("home_team"), F.col("awayTeam.name").alias("away_team"), goals("homeScore").alias("home_goals"), goals("awayScore").alias("away_goals")).where("home_goals IS NOT NULL AND away_goals IS NOT NULL")


def upcoming(s, d):
    p = _payloads(s, d).select(F.from_json("payload", PAYLOAD).alias("p")).select("p.*")
    day, time, _ = labels.kickoff(F.col("startTimestamp"))
    rows = p.select(F.col("id").alias("match_id"), F.concat_ws(" ", day, time).alias("kickoff"), F.col("homeTeam.name").alias("home_team"), F.col("awayTeam.name").alias("away_team"), F.coalesce("status.type", F.lit("")).alias("status"))
    return rows.where("match_id IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL")


def open_fixtures(s, d):
    return upcoming(s, d).where(F.col("status").isin("notstarted", "inprogress")).select("match_id", "status")


QUERIES = {
    "DT06_week_variants": week_variants, "DT07_dates": dates, "DT08_kickoffs": kickoffs, "DT09_seasons": seasons, "DT10_histories": histories, "DT11_season_days": season_days,
    "DT12_overlaps": overlaps, "FLT13_kickoff_year": kickoff_year, "DT13_midnights": midnights, "DT14_event_ids": event_ids, "DT15_captions": captions, "STR04_codes": codes,
    "STR05_first_parts": first_parts, "STR06_number_lists": number_lists, "STR07_titles": titles, "STR08_lists": lists, "STR10_file_keys": file_keys, "MTH01_internal_scale": internal_scale,
    "MTH09_bins": bins, "MTH10_rank_curves": rank_curves, "MTH11_clipped": clipped, "JSN02_flat_matches": flat_matches, "JSN03_upcoming": upcoming, "FLT11_open_fixtures": open_fixtures,
}

_KICK = "WITH k AS (SELECT event_id, user_id, event_type, (DATE '1970-01-01' + ((event_id * 3607 + 867715200) // 86400)::INT)::DATE AS day, lpad(((event_id * 3607 + 867715200) % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad(((event_id * 3607 + 867715200) % 3600 // 60)::VARCHAR, 2, '0') AS time FROM events),\nup AS (SELECT event_id AS match_id, day || ' ' || time AS kickoff, 'Club ' || user_id AS home_team, 'Visitors' AS away_team, CASE event_type WHEN 'error' THEN 'inprogress' WHEN 'click' THEN 'finished' ELSE 'notstarted' END AS status FROM k WHERE event_id % 13 > 0)\n"
_PLACED = ", z AS (SELECT *, row_number() OVER (PARTITION BY country_name ORDER BY rating DESC, pid) AS place FROM l)"


def oracle_sql() -> dict[str, str]:
    years = ", v AS (SELECT DISTINCT year(match_date)::INT AS year FROM f)"
    return {
        "DT06_week_variants": sql("f", "SELECT DISTINCT match_date, yyyyww AS clipped, (isoyear(match_date) * 100 + week(match_date))::INT AS unclipped, (year(match_date) * 100 + least(week(match_date), 52))::INT AS calendar FROM f"),
        "DT07_dates": sql("f", "SELECT DISTINCT match_date, match_date AS iso, match_date AS long, match_date AS short, NULL::DATE AS unknown FROM f"),
        "DT08_kickoffs": _KICK + "SELECT event_id, day, time, year(day)::INT AS year FROM k",
        "FLT13_kickoff_year": _KICK + "SELECT event_id, day FROM k WHERE year(day) = 1998",
        "DT09_seasons": sql("f", years + " SELECT year, '20' || right(year::VARCHAR, 2) || '/20' || right((year + 1)::VARCHAR, 2) AS split, year || '/' || (year + 1) AS start_year, year || '/' || (year + 1) AS end_year, '20' || right(year::VARCHAR, 2) || '/20' || right((year + 1)::VARCHAR, 2) AS compact, year || '/' || (year + 1) AS dashed, NULL::VARCHAR AS unknown FROM v"),
        "DT10_histories": sql("f", years + " SELECT year, year || '/' || (year + 1) AS long, year || '/20' || right((year + 1)::VARCHAR, 2) AS short, year || '/' || (year + 1) AS slash, NULL::VARCHAR AS single FROM v"),
        "DT11_season_days": sql("f", ", v AS (SELECT DISTINCT match_date, year(match_date) AS y, year(match_date) - (month(match_date) < 7)::INT AS b FROM f) SELECT match_date, b || '/' || (b + 1) AS season, (y - 1) || '/' || y AS season_by_end FROM v"),
        "DT12_overlaps": sql("f", years + ", t AS (SELECT year, CASE WHEN year % 100 < 70 THEN 2000 ELSE 1900 END + year % 100 AS lo, CASE WHEN (year + 1) % 100 < 70 THEN 2000 ELSE 1900 END + (year + 1) % 100 AS hi FROM v) SELECT t.year, v.year AS asked, v.year BETWEEN least(lo, hi) AND greatest(lo, hi) AS by_span, abs(t.year - v.year) <= 1 AS by_year, true AS unknown FROM t CROSS JOIN v"),
        "DT13_midnights": "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL",
        "DT14_event_ids": sql("f", "SELECT result_id, strftime(match_date, '%Y%m%d') || '_' || home_club_id || '_' || away_club_id AS event_id FROM f"),
        "DT15_captions": sql("f", "SELECT DISTINCT yyyyww, strftime(date_trunc('week', make_date(yyyyww // 100, 1, 4))::DATE + ((yyyyww % 100 - 1) * 7)::INT, '%B %Y') AS caption FROM f"),
        "STR04_codes": sql("f", "SELECT league_code, count(*) AS n, ends_with(upper(trim(league_code)), 'CUP') AS is_cup, contains(upper(league_code), 'FRIENDLY') AS is_friendly, CASE WHEN contains(league_code, 'FRIENDLY') THEN 'friendly' WHEN league_code = 'UCL' THEN 'UCL' WHEN contains(league_code, 'CUP') THEN 'cup' ELSE 'domestic' END AS suffix, CASE WHEN contains(league_code, 'FRIENDLY') THEN 0.05 ELSE 1.0 END::DOUBLE AS weight FROM f GROUP BY ALL"),
        "STR05_first_parts": sql("fcbse", "SELECT split_part(home_community, '|', 1) AS country, count(*) AS n FROM g1 GROUP BY ALL"),
        "STR06_number_lists": "SELECT p_partkey, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([p_size * 3, p_size, p_size * 20], lambda n: n BETWEEN 5 AND 500))), ','), ''), '25,50,100') AS cutoffs FROM part",
        "STR07_titles": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name || '-' || lower(p_type), '-'), lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')), '-') AS title FROM part",
        "STR08_lists": sql("fcbswl", _PLACED + ", y3 AS (SELECT country_name, list(club_name ORDER BY place) AS t, round(avg(rating) - 1500, 1) AS v FROM z WHERE place <= 3 GROUP BY ALL) SELECT country_name, CASE WHEN len(t) <= 2 THEN array_to_string(t, ' and ') ELSE array_to_string(t[:-2], ', ') || ', and ' || t[-1] END AS clubs, CASE WHEN v < 0 THEN '-' ELSE '+' END || format('{:,.1f}', abs(v)) AS lead FROM y3"),
        "STR10_file_keys": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND length((p_size + 9700)::VARCHAR) = 4 THEN (p_size + 9700)::VARCHAR ELSE 'misc' END AS folder, CASE WHEN p_size % 2 = 0 THEN 'E' || p_size ELSE regexp_replace(replace(p_name, ' ', '%20'), '[^A-Za-z0-9_-]+', '_', 'g') END AS league FROM part",
        "MTH01_internal_scale": sql("fcbswl", ", q AS (SELECT pid, (rating - 1500) / 173.7178::DOUBLE AS mu, rd / 173.7178::DOUBLE AS phi, rating FROM l) SELECT pid, round(mu, 5) AS mu, round(phi, 5) AS phi, round(rating, 5) AS rating, round(1 / sqrt(1 + 3 * phi * phi / pow(pi(), 2)), 5) AS g, round(1 / (1 + exp(mu / sqrt(1 + 3 * phi * phi / pow(pi(), 2)))), 5) AS expected FROM q"),
        "MTH09_bins": "SELECT floor((l_discount * 100 + 0.5) / 2.0) * 2.0 AS bin, count(*) AS n FROM lineitem GROUP BY 1",
        "MTH10_rank_curves": sql("fcbswl", _PLACED + " SELECT country_name, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN regr_intercept(rating, ln(place)) ELSE 3000 END, 4) AS intercept, round(CASE WHEN count(*) >= 10 THEN -regr_slope(rating, ln(place)) ELSE 160 END, 4) AS log_coefficient FROM z GROUP BY ALL"),
        "MTH11_clipped": "SELECT s_suppkey, round(greatest(0, least(1, s_acctbal / 5000)), 4) AS clipped, round(CASE WHEN s_suppkey > 0 THEN s_acctbal / s_suppkey ELSE 0 END, 4) AS ratio, round(1 - exp(-s_suppkey / 24.0::DOUBLE), 4) AS exponential FROM supplier",
        "JSN02_flat_matches": _KICK + "SELECT event_id AS match_id, day AS match_date, time AS match_time, CASE WHEN event_id % 13 > 0 THEN 'Club ' || user_id END AS home_team, 'Visitors' AS away_team, (user_id % 5)::INT AS home_goals, 1 AS away_goals FROM k WHERE event_id % 11 > 0",
        "JSN03_upcoming": _KICK + "SELECT * FROM up",
        "FLT11_open_fixtures": _KICK + "SELECT match_id, status FROM up WHERE status <> 'finished'",
    }
