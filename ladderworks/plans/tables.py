"""Queries that filter, deduplicate, key and merge tables of matches and clubs.

Where an operator needs a second table (staged rows, copies, maps), it follows from the whole tables by a rule.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderworks.functions import names
from ladderworks.functions.weeks import week_sunday
from ladderworks.operators import connectivity, dedupe, upsert
from ladderworks.operators.asof import snapshot
from ladderworks.plans.common import rounded, sql, weekly
from ladderworks.plans.serving import latest
from ladderworks.sources.fixtures import clubs, fixtures, table

SINCE_WEEK, SINCE_DAY = 199731, "1997-08-01"


def complete(s, d):
    return fixtures(s, d).dropna(subset=["match_date", "home_club_id", "away_club_id", "home_team_goals", "away_team_goals"]).select("result_id")


def up_to(s, d):
    return fixtures(s, d).where((F.col("yyyyww") <= SINCE_WEEK) & (F.col("league_code").cast("string") == "UCL")).select("result_id", "yyyyww")


def analytical(s, d):
    return fixtures(s, d).where((F.col("yyyyww") >= SINCE_WEEK) & (F.col("match_date") >= F.lit(SINCE_DAY).cast("date"))).select("result_id", "yyyyww", "match_date")


def last_weeks(s, d):
    w = weekly(s, d)
    newest = w.select("week").distinct().orderBy(F.desc(week_sunday(F.col("week")))).limit(12)
    return rounded(w.join(F.broadcast(newest), "week").select("week", "pid", "rating"))


def recent_years(s, d):
    w = weekly(s, d)
    top = F.broadcast(w.agg(F.max(F.floor(F.col("week") / 100)).alias("top")))
    return rounded(w.join(top, F.floor(F.col("week") / 100) >= F.col("top") - 1).select("week", "pid", "rating"))


def one_country(s, d):
    return rounded(weekly(s, d).where(F.lower("country_name") == "nation_7").select("week", "pid", "rating"))


def real_clubs(s, d):
    c = clubs(s, d).withColumn("club_name", F.when(F.col("club_id") % 10 == 0, F.concat("country_name", F.lit(" International"))).otherwise(F.col("club_name")))
    shown = (F.lower(F.trim("country_name")) != "international") & ~F.endswith("club_name", F.lit(" International"))
    return c.where(shown).select("club_id", "club_name")


def _named(s, d):
    c = clubs(s, d)
    own = lambda x: c.select(F.col("club_id").alias(f"{x}_club_id"), F.col("club_name").alias(f"{x}_name"), F.col("country_name").alias(f"{x}_country"))
    return fixtures(s, d).join(own("home"), "home_club_id", "left").join(own("away"), "away_club_id", "left")


def _side_has(x, *parts):
    found = F.lit(True)
    for p in parts:
        found = found & F.ilike(F.col(f"{x}_name"), F.lit(f"%{p}%"))
    return found


def team_search(s, d):
    return _named(s, d).where(_side_has("home", "SUPPLIER", "07") | _side_has("away", "SUPPLIER", "07")).select("result_id", "home_name", "away_name")


def team_country(s, d):
    there = lambda x: _side_has(x, "07") & (F.lower(f"{x}_country") == "nation_7")
    return _named(s, d).where(there("home") | there("away")).select("result_id", "home_name", "away_name")


def catalogue(s, d):
    kinds = fixtures(s, d).select("league_code", connectivity.community_suffix(F.col("league_code")).alias("kind")).distinct()
    return kinds.where(F.col("kind") == "domestic")


def after_warm_up(s, d):
    """Weeks after the first 52 there are, or all where that leaves none."""
    w = weekly(s, d)
    spine = w.select("week").distinct().withColumn("i", F.row_number().over(Window.orderBy("week")))  # a calendar
    spine = spine.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("i > 52 OR n <= 52")
    return rounded(w.join(F.broadcast(spine.select("week")), "week", "left_semi").select("week", "pid", "rating"))


def finite(s, d):
    ratio = F.try_divide(F.col("s_acctbal"), F.col("s_suppkey") % 5)
    rows = table(s, d, "supplier").select("s_suppkey", ratio.alias("ratio"))
    return rounded(rows.where("ratio IS NOT NULL AND NOT isnan(ratio) AND abs(ratio) < double('infinity')"))


def latest_week(s, d):
    return rounded(snapshot(weekly(s, d)).select("week", "pid", "club_name", "rating"))


def id_of_country(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("country_name"), F.col("n_nationkey").alias("country_id"))
    return clubs(s, d).join(F.broadcast(n), "country_name", "left").select("club_id", "country_id")


def enriched(s, d):
    ids = fixtures(s, d).select((F.col("home_club_id") * 2).alias("pid")).distinct()
    c = clubs(s, d).select(F.col("club_id").alias("pid"), "club_name", "country_name")
    return ids.join(c, "pid", "left").select("pid", F.coalesce("club_name", F.concat(F.lit("Club_"), F.col("pid").cast("string"))).alias("club_name"), "country_name")


def semi(s, d):
    gone = latest(weekly(s, d)).where("rating >= 1500").select("pid")
    return fixtures(s, d).join(gone.withColumnRenamed("pid", "home_club_id"), "home_club_id", "left_semi").select("result_id", "home_club_id")


def new_matches(s, d):
    f = fixtures(s, d).drop("result_id")
    main = f.where("match_date < DATE '1998-01-01'")
    return upsert.new_rows(f, main, f.columns)


def done_leagues(s, d):
    f = fixtures(s, d).select("league_code", F.floor(F.col("yyyyww") / 100).cast("int").alias("year"))
    seen = f.where("year < 1998 AND league_code <> 'D3'").distinct()
    return f.distinct().join(seen, ["league_code", "year"], "left_anti")


def duplicate_fixtures(s, d):
    rows = fixtures(s, d).groupBy("match_date", "home_team_goals", "away_team_goals", "home_club_id").agg(F.array_sort(F.collect_set("away_club_id")).alias("away"))
    return rows.where("size(away) > 1").select("match_date", "home_team_goals", "away_team_goals", "home_club_id", F.array_join(F.col("away").cast("array<string>"), ",").alias("away"))


def staging_matches(s, d):
    """Staged rows with the last main row of the same date, code and names."""
    f = _named(s, d)
    keys = ["match_date", "league_code", "home_key", "away_key"]
    rows = f.withColumns({"home_key": names.canonical_name(F.col("home_name")), "away_key": names.canonical_name(F.col("away_name"))})
    main = upsert.keep_first(rows.where("result_id % 2 = 0"), keys, [F.desc("result_id")]).select(*keys, F.col("result_id").alias("main_id"))
    return rows.where("result_id % 3 = 0").join(main, keys, "left").select("result_id", "main_id")


def unions(s, d):
    a = fixtures(s, d).where("result_id % 2 = 0").select("result_id", "league_code")
    return a.unionByName(fixtures(s, d).where("result_id % 2 = 1").select("result_id", "yyyyww"), allowMissingColumns=True)


def pairs(s, d):
    return fixtures(s, d).select("home_club_id", "league_code").distinct()


def first_seen(s, d):
    return dedupe.first_seen(fixtures(s, d), "home_club_id", "result_id")


def id_sets(s, d):
    """Ids by the sets that hold them: home sides of the cup, away sides of friendlies."""
    f = fixtures(s, d)
    a = f.where("league_code = 'FA_CUP' AND home_team_goals > 8").select(F.col("home_club_id").alias("pid"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = f.where("league_code = 'FRIENDLY_X' AND away_team_goals > 8").select(F.col("away_club_id").alias("pid"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionByName(b).groupBy("pid").agg((F.max("a") > 0).alias("in_cup"), (F.max("b") > 0).alias("in_friendly"))


def coverage(s, d):
    i = id_sets(s, d)
    both = F.col("in_cup") & F.col("in_friendly")
    return i.agg(F.count_if("in_cup").alias("cup"), F.count_if("in_friendly").alias("friendly"), F.count_if(both).alias("both"), F.count_if(F.col("in_cup") & ~F.col("in_friendly")).alias("cup_only"), F.count_if(~F.col("in_cup")).alias("friendly_only"))


def report(s, d):
    f = fixtures(s, d)
    return f.agg(F.count("*").alias("matches"), F.min("match_date").alias("first_day"), F.max("match_date").alias("last_day"), F.count_distinct("yyyyww").alias("weeks"), F.count_distinct("home_club_id").alias("homes"), F.count_distinct("league_code").alias("leagues"))


def keep_last(s, d):
    return upsert.keep_first(fixtures(s, d), ["match_date", "home_club_id"], [F.desc("result_id")]).select("result_id")


def twins(s, d):
    f = fixtures(s, d)
    copies = f.where("result_id % 3 = 0").withColumns({"result_id": F.col("result_id") + 10_000_000, "away_club_id": F.col("away_club_id") + 1})
    return dedupe.drop_twins(f.unionByName(copies)).select("result_id", "home_club_id", "away_club_id", "league_code")


def last_event(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


def last_of_pid(s, d):
    return rounded(latest(weekly(s, d)).select("pid", "week", "rating", "rd"))


def by_slug(s, d):
    """Of clubs with one slug, that of the highest finite rating."""
    rows = latest(weekly(s, d)).withColumn("slug", F.lower(F.concat_ws("-", "country_name", F.col("pid") % 3)))
    return rounded(upsert.keep_first(rows.where("NOT isnan(rating)"), ["slug"], [F.desc("rating"), F.col("pid")]).select("slug", "pid", "rating"))


def year_slices(s, d):
    f = fixtures(s, d).select("match_date", "home_club_id", "away_club_id", "home_team_goals", "away_team_goals")
    keys = ["match_date", "home_club_id", "away_club_id"]
    staged = upsert.keep_first(f.where("match_date >= DATE '1998-06-01' AND match_date < DATE '1999-03-01'"), keys, [F.col("home_team_goals"), F.col("away_team_goals")])
    return dedupe.merge_slice(f, staged.withColumn("home_team_goals", F.col("home_team_goals") + 1), F.year("match_date"), keys)


def dims(s, d):
    c = clubs(s, d).select("club_id", "club_name")
    newer = c.where("club_id % 4 = 0").select((F.col("club_id") + 50).alias("club_id"), F.concat("club_name", F.lit(" (new)")).alias("club_name"))
    return upsert.upsert(c, newer, ["club_id"])


def key_ids(s, d):
    key = F.concat_ws("|", "country_name", names.canonical_name(F.concat(F.lit("FC "), F.substring("club_name", -1, 1))))
    return dedupe.smallest_ids(clubs(s, d), key, "club_id", {"NATION_7|1": 71})


def same_fixtures(s, d):
    """Copies of matches under a created away id are led back to the old one."""
    f = fixtures(s, d)
    copies = f.where("away_club_id % 9 = 0").withColumn("away_club_id", F.col("away_club_id") + 100_000)
    made = copies.select(F.col("away_club_id").alias("id")).distinct()
    return dedupe.same_fixture_map(f.unionByName(copies), made)


def remapped(s, d):
    ids = clubs(s, d).where("club_id % 10 = 3").select(F.col("club_id").alias("old"), (F.col("club_id") - 1).alias("new"))
    return dedupe.remapped(fixtures(s, d), ids).select("result_id", "home_club_id", "away_club_id")


def merged(s, d):
    c = clubs(s, d)
    first = c.where("club_id % 2 = 0").select(F.col("club_id").alias("old"), (F.col("club_id") + 1).alias("new"))
    second = c.where("club_id % 3 = 0").select(F.col("club_id").alias("old"), F.col("club_id").alias("new"))
    return dedupe.merged_maps([first, second, c.select(F.col("club_id").alias("old"), F.lit(0).cast("bigint").alias("new"))])


def post_remap(s, d):
    """Rows that a remap made equal, their own id aside: the first stays."""
    ids = clubs(s, d).select(F.col("club_id").alias("old"), (F.col("club_id") - F.col("club_id") % 5).alias("new"))
    rows = dedupe.remapped(fixtures(s, d), ids).select("result_id", "yyyyww", "home_club_id", "away_club_id", "league_code")
    return upsert.keep_first(rows, ["yyyyww", "home_club_id", "away_club_id", "league_code"], [F.col("result_id")])


def countries(s, d):
    """Countries known and, after them, those that the clubs add."""
    known = table(s, d, "nation").where("n_nationkey < 20").select(F.col("n_name").alias("country_name"), F.col("n_nationkey").alias("country_id"))
    return dedupe.append_new(known, clubs(s, d).where("country_name IS NOT NULL").select("country_name", "club_id"), "country_name", "country_id", "club_id")


def audit(s, d):
    """Per code: matches, and sides that a dimension of known clubs lacks."""
    known = clubs(s, d).where("club_id % 7 > 0").select(F.col("club_id").alias("pid"), F.lit(True).alias("known"))
    f = fixtures(s, d).select("league_code", "result_id", F.explode(F.array("home_club_id", "away_club_id")).alias("pid")).join(known, "pid", "left")
    return f.groupBy("league_code").agg(F.count_distinct("result_id").alias("matches"), F.count_if(F.col("known").isNull()).alias("unmatched"), F.count_distinct(F.when(F.col("known").isNull(), F.col("pid"))).alias("unmatched_clubs"))


def country_map(s, d):
    n = _named(s, d)
    sides = n.select(F.inline(F.array(*[F.struct(F.col(f"{x}_club_id").alias("pid"), F.col(f"{x}_country").alias("country")) for x in ("home", "away")])))
    return sides.groupBy("pid").agg(F.min("country").alias("country"))


QUERIES = {
    "FLT01_complete": complete, "FLT02_up_to": up_to, "FLT03_analytical": analytical, "FLT04_last_weeks": last_weeks, "FLT05_recent_years": recent_years, "FLT06_one_country": one_country,
    "FLT07_real_clubs": real_clubs, "FLT09_team_search": team_search, "FLT10_team_country": team_country, "FLT14_catalogue": catalogue, "FLT16_after_warm_up": after_warm_up, "FLT17_finite": finite,
    "J01_country_ids": id_of_country, "J02_enriched": enriched, "J13_semi": semi, "J14_new_matches": new_matches, "J15_done_leagues": done_leagues, "J16_latest_week": latest_week,
    "J19_duplicate_fixtures": duplicate_fixtures, "J20_staging_matches": staging_matches, "SET01_unions": unions, "SET02_pairs": pairs, "SET03_first_seen": first_seen, "SET04_id_sets": id_sets,
    "AGG28_report": report, "AGG30_coverage": coverage, "DED02_keep_last": keep_last, "DED03_twins": twins, "DED04_last_event": last_event, "DED05_last_of_pid": last_of_pid, "DED06_by_slug": by_slug,
    "UPS01_year_slices": year_slices, "UPS02_dims": dims, "ER01_key_ids": key_ids, "ER05_same_fixtures": same_fixtures, "ER06_merged_maps": merged, "ER07_remapped": remapped,
    "ER08_post_remap": post_remap, "ER10_countries": countries, "ER12_audit": audit, "EV13_country_map": country_map,
}


def oracle_sql() -> dict[str, str]:
    nm = ", nm AS (SELECT f.*, h.club_name AS home_name, h.country_name AS home_country, a.club_name AS away_name, a.country_name AS away_country FROM f LEFT JOIN c h ON h.club_id = home_club_id LEFT JOIN c a ON a.club_id = away_club_id) "
    sets = ", i AS (SELECT c.club_id AS pid, EXISTS (FROM f WHERE league_code = 'FA_CUP' AND home_team_goals > 8 AND home_club_id = c.club_id) AS in_cup, EXISTS (FROM f WHERE league_code = 'FRIENDLY_X' AND away_team_goals > 8 AND away_club_id = c.club_id) AS in_friendly FROM c), i2 AS (SELECT * FROM i WHERE in_cup OR in_friendly) "
    return {
        "FLT01_complete": sql("f", "SELECT result_id FROM f WHERE match_date IS NOT NULL AND home_club_id IS NOT NULL AND away_club_id IS NOT NULL AND home_team_goals IS NOT NULL AND away_team_goals IS NOT NULL"),
        "FLT02_up_to": sql("f", "SELECT result_id, yyyyww FROM f WHERE yyyyww <= 199731 AND league_code = 'UCL'"),
        "FLT03_analytical": sql("f", "SELECT result_id, yyyyww, match_date FROM f WHERE yyyyww >= 199731 AND match_date >= DATE '1997-08-01'"),
        "FLT04_last_weeks": sql("fbs", "SELECT week, pid, round(rating, 5) AS rating FROM s WHERE week IN (SELECT DISTINCT week FROM s ORDER BY week DESC LIMIT 12)"),
        "FLT05_recent_years": sql("fbs", "SELECT week, pid, round(rating, 5) AS rating FROM s WHERE week // 100 >= (SELECT max(week // 100) - 1 FROM s)"),
        "FLT06_one_country": sql("fcbsw", "SELECT week, pid, round(rating, 5) AS rating FROM w WHERE lower(country_name) = 'nation_7'"),
        "FLT07_real_clubs": sql("c", "SELECT club_id, club_name FROM c WHERE club_id % 10 <> 0 AND lower(country_name) <> 'international'"),
        "FLT09_team_search": sql("fc", nm + "SELECT result_id, home_name, away_name FROM nm WHERE (home_name ILIKE '%supplier%' AND home_name ILIKE '%07%') OR (away_name ILIKE '%supplier%' AND away_name ILIKE '%07%')"),
        "FLT10_team_country": sql("fc", nm + "SELECT result_id, home_name, away_name FROM nm WHERE (home_name ILIKE '%07%' AND lower(home_country) = 'nation_7') OR (away_name ILIKE '%07%' AND lower(away_country) = 'nation_7')"),
        "FLT14_catalogue": sql("f", "SELECT DISTINCT league_code, 'domestic' AS kind FROM f WHERE league_code IN ('D3', 'D4')"),
        "FLT16_after_warm_up": sql("fbs", ", v AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM s)) SELECT week, pid, round(rating, 5) AS rating FROM s JOIN v USING (week) WHERE i > 52 OR n <= 52"),
        "FLT17_finite": "SELECT s_suppkey, round(s_acctbal / (s_suppkey % 5), 5) AS ratio FROM supplier WHERE s_suppkey % 5 > 0",
        "J01_country_ids": sql("c", "SELECT club_id, n_nationkey AS country_id FROM c LEFT JOIN nation ON n_name = country_name"),
        "J02_enriched": sql("fc", "SELECT DISTINCT home_club_id * 2 AS pid, coalesce(club_name, 'Club_' || (home_club_id * 2)) AS club_name, country_name FROM f LEFT JOIN c ON club_id = home_club_id * 2"),
        "J13_semi": sql("fcbswl", "SELECT result_id, home_club_id FROM f WHERE home_club_id IN (SELECT pid FROM l WHERE rating >= 1500)"),
        "J14_new_matches": sql("f", "SELECT * EXCLUDE result_id FROM f WHERE match_date >= DATE '1998-01-01'"),
        "J15_done_leagues": sql("f", "SELECT DISTINCT league_code, (yyyyww // 100)::INT AS year FROM f WHERE yyyyww // 100 >= 1998 OR league_code = 'D3'"),
        "J16_latest_week": sql("fcbsw", "SELECT week, pid, club_name, round(rating, 5) AS rating FROM w WHERE week = (SELECT max(week) FROM w)"),
        "J19_duplicate_fixtures": sql("f", "SELECT match_date, home_team_goals, away_team_goals, home_club_id, array_to_string(list_sort(list(DISTINCT away_club_id)), ',') AS away FROM f GROUP BY ALL HAVING count(DISTINCT away_club_id) > 1"),
        "J20_staging_matches": sql("f", "SELECT st.result_id, max(m.result_id) AS main_id FROM f st LEFT JOIN (FROM f WHERE result_id % 2 = 0) m ON st.match_date = m.match_date AND st.league_code = m.league_code AND st.home_club_id = m.home_club_id AND st.away_club_id = m.away_club_id WHERE st.result_id % 3 = 0 GROUP BY ALL"),
        "SET01_unions": sql("f", "SELECT result_id, CASE WHEN result_id % 2 = 0 THEN league_code END AS league_code, CASE WHEN result_id % 2 = 1 THEN yyyyww END AS yyyyww FROM f"),
        "SET02_pairs": sql("f", "SELECT DISTINCT home_club_id, league_code FROM f"),
        "SET03_first_seen": sql("f", "SELECT home_club_id, min(result_id) AS first, row_number() OVER (ORDER BY min(result_id)) AS key FROM f GROUP BY ALL"),
        "SET04_id_sets": sql("fc", sets + "SELECT * FROM i2"),
        "AGG30_coverage": sql("fc", sets + "SELECT count(*) FILTER (in_cup) AS cup, count(*) FILTER (in_friendly) AS friendly, count(*) FILTER (in_cup AND in_friendly) AS both, count(*) FILTER (in_cup AND NOT in_friendly) AS cup_only, count(*) FILTER (NOT in_cup) AS friendly_only FROM i2"),
        "AGG28_report": sql("f", "SELECT count(*) AS matches, min(match_date) AS first_day, max(match_date) AS last_day, count(DISTINCT yyyyww) AS weeks, count(DISTINCT home_club_id) AS homes, count(DISTINCT league_code) AS leagues FROM f"),
        "DED02_keep_last": sql("f", "SELECT max(result_id) AS result_id FROM f GROUP BY match_date, home_club_id"),
        "DED03_twins": sql("f", ", a AS (SELECT result_id, match_date, home_club_id, away_club_id, home_team_goals, away_team_goals, league_code FROM f UNION ALL SELECT result_id + 10000000, match_date, home_club_id, away_club_id + 1, home_team_goals, away_team_goals, league_code FROM f WHERE result_id % 3 = 0), h AS (FROM a WHERE league_code = 'UCL' QUALIFY row_number() OVER (PARTITION BY match_date, home_club_id, home_team_goals, away_team_goals ORDER BY result_id DESC) = 1), w AS (FROM h QUALIFY row_number() OVER (PARTITION BY match_date, away_club_id, home_team_goals, away_team_goals ORDER BY result_id DESC) = 1) SELECT result_id, home_club_id, away_club_id, league_code FROM a WHERE league_code <> 'UCL' UNION ALL SELECT result_id, home_club_id, away_club_id, league_code FROM w"),
        "DED04_last_event": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
        "DED05_last_of_pid": sql("fcbswl", "SELECT pid, week, round(rating, 5) AS rating, round(rd, 5) AS rd FROM l"),
        "DED06_by_slug": sql("fcbswl", ", v AS (SELECT lower(country_name || '-' || (pid % 3)) AS slug, pid, rating FROM l) SELECT slug, pid, round(rating, 5) AS rating FROM v QUALIFY row_number() OVER (PARTITION BY slug ORDER BY v.rating DESC, pid) = 1"),
        "UPS01_year_slices": sql("f", ", t AS (SELECT match_date, home_club_id, away_club_id, home_team_goals + 1 AS home_team_goals, away_team_goals FROM f WHERE match_date >= DATE '1998-06-01' AND match_date < DATE '1999-03-01' QUALIFY row_number() OVER (PARTITION BY match_date, home_club_id, away_club_id ORDER BY f.home_team_goals, away_team_goals) = 1) SELECT match_date, home_club_id, away_club_id, home_team_goals, away_team_goals FROM f WHERE NOT (match_date >= DATE '1998-06-01' AND match_date < DATE '1999-03-01') UNION ALL SELECT * FROM t"),
        "UPS02_dims": sql("c", ", v AS (SELECT club_id + 50 AS club_id, club_name || ' (new)' AS club_name FROM c WHERE club_id % 4 = 0) SELECT * FROM v UNION ALL SELECT club_id, club_name FROM c WHERE club_id NOT IN (SELECT club_id FROM v)"),
        "ER01_key_ids": sql("c", ", v AS (SELECT country_name || '|' || right(club_name, 1) AS key, club_id FROM c) SELECT key, CASE WHEN key = 'NATION_7|1' THEN 71 ELSE min(club_id) END AS id, count(*) AS ids FROM v GROUP BY key"),
        "ER05_same_fixtures": sql("f", ", a AS (SELECT match_date AS day, home_team_goals AS hg, away_team_goals AS ag, home_club_id AS h, away_club_id AS a FROM f UNION ALL SELECT match_date, home_team_goals, away_team_goals, home_club_id, away_club_id + 100000 FROM f WHERE away_club_id % 9 = 0), q AS (SELECT day, hg, ag, 'h' AS side, h AS same, a AS other FROM a UNION SELECT day, hg, ag, 'a', a, h FROM a), g AS (SELECT min(other) FILTER (other >= 100000) AS old, min(other) FILTER (other < 100000) AS new FROM q GROUP BY day, hg, ag, side, same HAVING count(*) = 2 AND count(*) FILTER (other >= 100000) = 1) SELECT old, min(new) AS new FROM g GROUP BY old"),
        "ER06_merged_maps": sql("c", "SELECT club_id AS old, CASE WHEN club_id % 2 = 0 THEN club_id + 1 ELSE 0 END AS new FROM c WHERE club_id % 2 = 0 OR (club_id % 3 <> 0 AND club_id <> 0)"),
        "ER07_remapped": sql("f", "SELECT result_id, home_club_id - (home_club_id % 10 = 3)::INT AS home_club_id, away_club_id - (away_club_id % 10 = 3)::INT AS away_club_id FROM f"),
        "ER08_post_remap": sql("f", ", v AS (SELECT result_id, yyyyww, home_club_id - home_club_id % 5 AS home_club_id, away_club_id - away_club_id % 5 AS away_club_id, league_code FROM f) SELECT min(result_id) AS result_id, * EXCLUDE result_id FROM v GROUP BY ALL"),
        "ER10_countries": sql("c", ", v AS (SELECT country_name, min(club_id) AS p FROM c WHERE country_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 20) GROUP BY ALL) SELECT n_name AS country_name, n_nationkey AS country_id FROM nation WHERE n_nationkey < 20 UNION ALL SELECT country_name, 19 + row_number() OVER (ORDER BY p) FROM v"),
        "ER12_audit": sql("f", ", v AS (SELECT league_code, result_id, unnest([home_club_id, away_club_id]) AS pid FROM f) SELECT league_code, count(DISTINCT result_id) AS matches, count(*) FILTER (pid % 7 = 0) AS unmatched, count(DISTINCT pid) FILTER (pid % 7 = 0) AS unmatched_clubs FROM v GROUP BY ALL"),
        "EV13_country_map": sql("fcb", "SELECT DISTINCT pid, country_name AS country FROM b JOIN c ON pid = club_id"),
    }
