"""Queries that resolve names and re-key staged matches. Clubs, spellings and staged rows follow from whole tables by rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladderworks.functions import names
from ladderworks.operators import identity
from ladderworks.plans.common import sql
from ladderworks.sources.fixtures import fixtures, table

_HEX, _LETTERS = "0123456789abcdef", "bcdfghjklmnpaeio"
_PAIRS = [*names.ALIASES.items()]


def _word(text: Column, at: int, size: int) -> Column:
    return F.initcap(F.translate(F.substring(F.md5(text), at, size), _HEX, _LETTERS))


def _invented(text: Column) -> Column:
    """A name of two words of nine and six letters, another one for every text."""
    return F.concat_ws(" ", _word(text, 1, 9), _word(text, 10, 6))


def _spelled(name: Column, kind: Column) -> Column:
    """The name as it is, with an affix, without capitals and with a hyphen, with a wrong letter, or turned round with one word more."""
    return F.when(kind == 0, F.concat(F.lit("FC "), F.upper(name))).when(kind == 1, F.overlay(name, F.lit("z"), F.lit(3))).when(kind == 2, F.concat_ws(" ", F.substring(name, 11, 6), F.substring(name, 1, 9), F.lit("United"))).when(kind == 3, F.replace(F.lower(name), F.lit(" "), F.lit("-"))).otherwise(name)


def club_dim(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("club_id"), _invented(F.col("s_name")).alias("club_name"), F.col("s_nationkey").cast("bigint").alias("country_id"))


def spellings(s, d):
    """A spelling (seq, name, country_id) for each customer: of the supplier of its number, or a new club's."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_name"))
    dim = club_dim(s, d)
    size = F.broadcast(dim.agg(F.count("*").alias("size")))  # one row
    kind = F.col("seq") % 6
    rows = c.crossJoin(size).withColumn("club_id", F.col("seq") % F.col("size")).join(dim, "club_id")
    name = F.when(kind == 4, _invented(F.concat(F.lit("new "), "c_name"))).when((kind == 5) & (F.col("seq") % 12 == 5), F.lit(None)).otherwise(_spelled(F.col("club_name"), kind))
    return rows.select("seq", name.alias("name"), "country_id")


def canonical(s, d):
    """Keys of all stated spellings, each as a part's number writes it."""
    k = F.col("p_partkey") % (2 * len(_PAIRS)) + 1
    word = F.element_at(F.array(*[F.lit(x) for pair in _PAIRS for x in pair]), k.cast("int"))
    how = F.floor(F.col("p_partkey") / (2 * len(_PAIRS))) % 3
    name = F.when(how == 0, F.initcap(word)).when(how == 1, F.concat(F.upper(word), F.lit(" FC"))).otherwise(F.concat(F.lit("AC "), F.replace(word, F.lit(" "), F.lit("-"))))
    return table(s, d, "part").select("p_partkey", name.alias("name")).withColumn("key", names.canonical_name(F.col("name")))


def suggested(s, d):
    return identity.suggestions(spellings(s, d), club_dim(s, d)).withColumn("score", F.round("score", 5))


def resolved(s, d):
    out = identity.resolve_names(spellings(s, d), club_dim(s, d), create=True)
    return out.select("name", "country_id", "key", "club_id", "how", F.round("score", 5).alias("score"))


def created(s, d):
    """Created ids led back to known clubs by a suggestion of at least 80, or by their own name."""
    seq = F.col("seq")
    made = spellings(s, d).join(club_dim(s, d).select("country_id", "club_name").groupBy("country_id").agg(F.min("club_name").alias("other")), "country_id")
    rows = made.select((seq + 100_000).alias("created_club_id"), F.col("name").alias("club_name"), F.when(seq % 4 == 0, F.col("other")).alias("suggestion"), F.when(seq % 4 == 0, (seq % 100).cast("double")).alias("score"))
    return identity.created_map(rows, club_dim(s, d), 80.0)


def _named_matches(s, d):
    rows = fixtures(s, d).select("result_id", "match_date", "league_code", "home_club_id", "away_club_id", "home_team_goals", "away_team_goals")
    dim = club_dim(s, d)
    for x in ("home", "away"):
        own = dim.select(F.col("club_id").alias(f"{x}_club_id"), F.col("club_name").alias(f"{x}_team_name"), F.col("country_id").alias(f"_{x}_country"))
        rows = rows.join(own, f"{x}_club_id")
    return rows.withColumn("country_id", F.col("_home_country")).drop("_home_country", "_away_country")


def staged_matches(s, d):
    """Every match once more under ids of its own: one in six as main has it, the others a year later and spelled in other ways."""
    kind = F.col("result_id") % 6
    rows = _named_matches(s, d).withColumns({f"{x}_club_id": F.col(f"{x}_club_id") + 100_000 for x in ("home", "away")})
    names_ = {f"{x}_team_name": F.when(kind == 4, _invented(F.concat(F.lit("new "), f"{x}_team_name"))).otherwise(_spelled(F.col(f"{x}_team_name"), kind)) for x in ("home", "away")}
    moved = {"match_date": F.when(kind == 0, F.col("match_date")).otherwise(F.date_add("match_date", 364)), "country_id": F.when(kind == 3, F.lit(None).cast("bigint")).otherwise(F.col("country_id")), "home_team_goals": F.col("home_team_goals") + 1}
    return rows.withColumns(names_ | moved).withColumn("result_id", F.col("result_id") + 1_000_000)


def rekeyed(s, d):
    out = identity.rekeyed(staged_matches(s, d), _named_matches(s, d), club_dim(s, d))
    return out.select("result_id", "home_club_id", "away_club_id", "home_how", "away_how")


def rekey_steps(s, d):
    """How many sides each step found."""
    out = identity.rekeyed(staged_matches(s, d), _named_matches(s, d), club_dim(s, d))
    return out.select(F.explode(F.array("home_how", "away_how")).alias("step")).groupBy("step").agg(F.count("*").alias("sides"))


def merged(s, d):
    keys = ["match_date", "league_code", "home_club_id", "away_club_id"]
    main = _named_matches(s, d)
    out = identity.merged_staging(main, staged_matches(s, d), club_dim(s, d), keys)
    return out.select("result_id", *keys, "home_team_goals", "away_team_goals")


QUERIES = {
    "STR02_canonical": canonical, "STR03_suggestions": suggested, "ER02_resolved": resolved, "ER04_created_map": created, "ER09_rekeyed": rekeyed, "ER09_steps": rekey_steps, "UPS03_merged_staging": merged,
}

_MD5 = "translate(substr(md5({0}), {1}, {2}), '" + _HEX + "', '" + _LETTERS + "')"
_WORD = f"upper({_MD5.format('{0}', '{1}', 1)}) || {_MD5.format('{0}', '{2}', '{3}')}"


def _name(text: str) -> str:
    return "(" + _WORD.format(text, 1, 2, 8) + " || ' ' || " + _WORD.format(text, 10, 11, 5) + ")"


def _sql_spelled(n: str, kind: str) -> str:
    return f"CASE {kind} WHEN 0 THEN 'FC ' || upper({n}) WHEN 1 THEN substr({n}, 1, 2) || 'z' || substr({n}, 4) WHEN 2 THEN substr({n}, 11, 6) || ' ' || substr({n}, 1, 9) || ' United' WHEN 3 THEN replace(lower({n}), ' ', '-') ELSE {n} END"


_DIM = f"cd AS (SELECT s_suppkey AS club_id, {_name('s_name')} AS club_name, s_nationkey::BIGINT AS country_id FROM supplier)"
_SPELLED = f""",
sp AS (SELECT c_custkey AS seq, c_custkey % 6 AS kind, c.country_id, c.club_id, c.club_name,
  CASE WHEN c_custkey % 6 = 4 THEN {_name("'new ' || c_name")} WHEN c_custkey % 12 = 5 THEN NULL ELSE {_sql_spelled('c.club_name', 'c_custkey % 6')} END AS name
  FROM customer JOIN cd c ON c.club_id = c_custkey % (SELECT count(*) FROM cd))"""
#: A key as SQL has it, for names without marks.
_KEY = "array_to_string(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT w IN (" + ", ".join(f"'{a}'" for a in names.AFFIXES) + ")), ' ')"
_STAGED = f""",
nm AS (SELECT f.*, h.club_name AS hn, a.club_name AS an, h.country_id FROM f JOIN cd h ON h.club_id = home_club_id JOIN cd a ON a.club_id = away_club_id),
st AS (SELECT result_id + 1000000 AS result_id, result_id % 6 AS kind, league_code, CASE WHEN result_id % 6 = 0 THEN match_date ELSE match_date + 364 END AS match_date, home_team_goals + 1 AS home_team_goals, away_team_goals,
  home_club_id + CASE WHEN result_id % 6 = 4 THEN 100000 ELSE 0 END AS home_club_id, away_club_id + CASE WHEN result_id % 6 = 4 THEN 100000 ELSE 0 END AS away_club_id, home_club_id AS home_true, away_club_id AS away_true, country_id FROM nm),
sx AS (SELECT st.*, EXISTS (SELECT 1 FROM f WHERE kind NOT IN (1, 2, 4) AND f.match_date = st.match_date AND f.league_code = st.league_code AND f.home_club_id = home_true AND f.away_club_id = away_true) AS met,
  h.country_id = st.country_id AS home_own, a.country_id = st.country_id AS away_own FROM st JOIN cd h ON h.club_id = home_true JOIN cd a ON a.club_id = away_true),
sh AS (SELECT *, CASE WHEN met THEN 'fixture' WHEN kind IN (1, 2) THEN 'fuzzy' WHEN kind = 4 THEN 'kept' WHEN kind = 3 THEN 'key' WHEN home_own THEN 'country' ELSE 'key' END AS home_how,
  CASE WHEN met THEN 'fixture' WHEN kind IN (1, 2) THEN 'fuzzy' WHEN kind = 4 THEN 'kept' WHEN kind = 3 THEN 'key' WHEN away_own THEN 'country' ELSE 'key' END AS away_how FROM sx)"""


def oracle_sql() -> dict[str, str]:
    """The rules say which club a spelling is of and how it can be found; scores are those of one wrong letter and of one word more."""
    words = "[" + ", ".join(f"'{x}'" for pair in _PAIRS for x in pair) + "]"
    alias = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in _PAIRS) + "}"
    title = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    two = 2 * len(_PAIRS)
    canonical_sql = f"""WITH w AS (SELECT p_partkey, ({words})[p_partkey % {two} + 1] AS x, p_partkey // {two} % 3 AS how FROM part),
n AS (SELECT p_partkey, CASE how WHEN 0 THEN {title.format('x')} WHEN 1 THEN upper(x) || ' FC' ELSE 'AC ' || replace(x, ' ', '-') END AS name FROM w),
k AS (SELECT *, {_KEY.format('name')} AS own FROM n)
SELECT p_partkey, name, coalesce(({alias})[own], own) AS key FROM k"""
    dim = "WITH " + _DIM + _SPELLED
    first = "u AS (SELECT name, country_id, min(seq) AS seq, any_value(kind) AS kind, any_value(club_id) AS club_id, any_value(club_name) AS club_name FROM sp GROUP BY name, country_id)"
    score = "CASE kind WHEN 1 THEN 93.75 WHEN 2 THEN 100.0 END::DOUBLE"
    return {
        "STR02_canonical": canonical_sql,
        "STR03_suggestions": f"{dim}, {first} SELECT name, country_id, club_name AS suggestion, CASE kind WHEN 1 THEN 93.75 ELSE 100 END::DOUBLE AS score, club_id FROM u WHERE kind IN (1, 2) OR (kind = 5 AND name IS NOT NULL)",
        "ER02_resolved": f"""{dim}, {first}, nw AS (SELECT name, (SELECT max(club_id) FROM cd) + row_number() OVER (ORDER BY seq) AS new_id FROM u WHERE kind = 4)
SELECT u.name, country_id, {_KEY.format('u.name')} AS key, CASE WHEN u.name IS NULL THEN NULL WHEN kind = 4 THEN new_id ELSE club_id END AS club_id,
  CASE WHEN u.name IS NULL THEN 'unresolved' WHEN kind = 4 THEN 'created' WHEN kind IN (1, 2) THEN 'fuzzy' ELSE 'exact' END AS how, {score} AS score FROM u LEFT JOIN nw ON nw.name = u.name""",
        "ER04_created_map": f"""{dim}, ot AS (SELECT country_id, min(club_name) AS other FROM cd GROUP BY ALL),
mm AS (SELECT seq + 100000 AS old, CASE WHEN seq % 4 = 0 THEN o.club_id WHEN kind IN (0, 3) OR (kind = 5 AND name IS NOT NULL) THEN sp.club_id END AS new FROM sp JOIN ot USING (country_id) JOIN cd o ON o.club_name = other WHERE seq % 4 <> 0 OR seq % 100 >= 80)
SELECT old, new FROM mm WHERE new IS NOT NULL""",
        "ER09_rekeyed": sql("f", f", {_DIM}{_STAGED} SELECT result_id, home_club_id, away_club_id, home_how, away_how FROM sh"),
        "ER09_steps": sql("f", f", {_DIM}{_STAGED} SELECT step, count(*) AS sides FROM (SELECT unnest([home_how, away_how]) AS step FROM sh) GROUP BY step"),
        "UPS03_merged_staging": sql("f", f""", {_DIM}{_STAGED},
one AS (SELECT * FROM sh QUALIFY row_number() OVER (PARTITION BY match_date, league_code, home_club_id, away_club_id ORDER BY result_id DESC) = 1),
main AS (SELECT result_id, match_date, league_code, home_club_id, away_club_id, home_team_goals, away_team_goals FROM nm)
SELECT * FROM main m WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.match_date = m.match_date AND o.league_code = m.league_code AND o.home_club_id = m.home_club_id AND o.away_club_id = m.away_club_id)
UNION ALL SELECT result_id, match_date, league_code, home_club_id, away_club_id, home_team_goals, away_team_goals FROM one"""),
    }
