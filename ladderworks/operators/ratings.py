"""Rating periods as Spark jobs: expansion to both sides, sums per entity, update. State is a table that joins the period's
matches; the volatility equation is solved inside the plan. Periods follow each other; within one, all is parallel."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderworks.functions.scoring import SCALE, expected, g, score, volatility
from ladderworks.operators.keeping import folder
from ladderworks.operators.week_steps import DONE, FIELDS, HELD, READS, SCHEMA, SCORES, SIDE, STATE, STATES, Bucket, history, pack_group, reads, scores

INIT_RATING, INIT_RD, INIT_SIGMA = 1500.0, 250.0, 0.06


@dataclass(frozen=True)
class Engine:
    """The published defaults of the weekly engine. A gate, decay or reseeding of 0 is off."""

    rating: float = INIT_RATING
    rd: float = INIT_RD
    sigma: float = INIT_SIGMA
    tau: float = 0.5
    drift: float = 0.0
    max_sigma: float = 0.1
    upset_max: float = 0.0
    upset_k: float = 0.0
    info_scale: float = 0.0
    decay: float = 0.0
    grace: int = 8
    reseed_after: int = 0


#: The settings of the two kinds of runs.
CONTINENT, COUNTRY = Engine(decay=1.0, grace=52, reseed_after=520), Engine(decay=2.5, grace=12, reseed_after=52)


def both_sides(matches: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each side of a match: pid, opponent, own and other goals, score."""
    side = lambda me, other: F.struct(F.col(f"{me}_club_id").alias("pid"), F.col(f"{other}_club_id").alias("opponent"), F.col(f"{me}_team_goals").alias("goals"), F.col(f"{other}_team_goals").alias("conceded"), F.lit(me == "home").alias("at_home"))
    rows = matches.select(*keep, F.inline(F.array(side("home", "away"), side("away", "home"))))
    return rows.withColumn("score", score(F.col("goals"), F.col("conceded")))


def running_strength(matches: DataFrame) -> DataFrame:
    """(week, pid, rating, rd, matches): 1500 plus 400 times the lead of the mean score so far over a half."""
    weekly = both_sides(matches, ["yyyyww"]).groupBy("yyyyww", "pid").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("pid").orderBy("yyyyww").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return weekly.select(F.col("yyyyww").alias("week"), "pid", *_strength(F.sum("s").over(w), F.sum("n").over(w)), F.col("n").alias("matches"))


def _strength(total: Column, played: Column) -> tuple[Column, Column]:
    return (1500.0 + 400.0 * (total / played - 0.5)).alias("rating"), (350.0 / F.sqrt(1.0 + played)).alias("rd")


def final_strength(matches: DataFrame) -> DataFrame:
    """(pid, week, rating, rd): everybody's last row of `running_strength`, from sums of a player alone."""
    total = both_sides(matches, ["yyyyww"]).groupBy("pid").agg(F.max("yyyyww").alias("week"), F.sum("score").alias("s"), F.count("*").alias("n"))
    return total.select("pid", "week", *_strength(F.col("s"), F.col("n")))


def period_sums(matches: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Per entity: games, information and surprise over the matches, all read from the state before them.

    ``state`` has pid, mu, phi; entities that it lacks have the initial ones.
    """
    rows = both_sides(matches, [])
    mu0, phi0 = F.lit(0.0), F.lit(INIT_RD / SCALE)
    if state is None:
        rows = rows.select("pid", "score", mu0.alias("mu"), mu0.alias("other_mu"), phi0.alias("other_phi"))
    else:
        mine = state.select("pid", "mu")
        theirs = state.select(F.col("pid").alias("opponent"), F.col("mu").alias("other_mu"), F.col("phi").alias("other_phi"))
        rows = rows.join(mine, "pid", "left").join(theirs, "opponent", "left").select("pid", "score", F.coalesce("mu", mu0).alias("mu"), F.coalesce("other_mu", mu0).alias("other_mu"), F.coalesce("other_phi", phi0).alias("other_phi"))
    e = expected(F.col("mu"), F.col("other_mu"), F.col("other_phi"))
    weight = g(F.col("other_phi"))
    return rows.groupBy("pid").agg(F.count("*").alias("games"), F.sum(weight * weight * e * (1 - e)).alias("information"), F.sum(weight * (F.col("score") - e)).alias("surprise"))


def rate_period(state: DataFrame, matches: DataFrame, tau: float = 0.5, max_sigma: float = 0.1, drift: float = 0.0) -> DataFrame:
    """The state after one period. Both sums are damped by the square root of the number of games.

    ``state``: pid, mu, phi, sigma, absent (periods from the last game to this one). Deviations of entities that play again grow first.
    """
    back = F.sqrt(F.col("phi") * F.col("phi") + F.col("absent") * (F.col("sigma") * F.col("sigma") + drift * drift))
    playing = both_sides(matches, []).select("pid").distinct().withColumn("plays", F.lit(True))
    start = state.join(playing, "pid", "full").select("pid", F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce(F.when(F.col("plays"), back).otherwise(F.col("phi")), F.lit(INIT_RD / SCALE)).alias("phi"), F.coalesce("sigma", F.lit(INIT_SIGMA)).alias("sigma"), F.coalesce("absent", F.lit(0)).alias("absent"))
    sums = period_sums(matches, start)
    damp = F.sqrt(F.col("games").cast("double"))
    both = start.join(sums, "pid", "left").withColumns({"i": F.col("information") / damp, "s": F.col("surprise") / damp})
    both = both.withColumn("new_sigma", F.when(F.col("i") > 0, F.least(F.lit(max_sigma), volatility(F.col("sigma"), F.col("phi"), 1 / F.col("i"), F.col("s") / F.col("i"), tau))))
    phi = 1 / F.sqrt(1 / (F.col("phi") ** 2 + F.col("new_sigma") ** 2) + F.col("i"))
    updated = F.col("i") > 0
    return both.select("pid", F.when(updated, F.col("mu") + phi * phi * F.col("s")).otherwise(F.col("mu")).alias("mu"), F.when(updated, phi).otherwise(F.col("phi")).alias("phi"), F.coalesce("new_sigma", "sigma").alias("sigma"), F.when(F.col("games").isNotNull(), 1).otherwise(F.col("absent") + 1).alias("absent"))


def rate_periods(matches: DataFrame, period: str, tau: float = 0.5) -> DataFrame:
    """(period, pid, rating, rd, sigma) after each period: one job for each, with the state kept in the checkpoint folder."""
    from ladderworks.operators.keeping import kept

    spark = matches.sparkSession
    matches = kept(matches)
    state = spark.createDataFrame([], "pid bigint, mu double, phi double, sigma double, absent int")
    parts = None
    for p in [r[0] for r in matches.select(period).distinct().orderBy(period).collect()]:  # the calendar's periods
        state = kept(rate_period(state, matches.where(F.col(period) == p), tau))
        rows = state.select(F.lit(p).alias("period"), "pid", (INIT_RATING + SCALE * F.col("mu")).alias("rating"), (SCALE * F.col("phi")).alias("rd"), "sigma")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts if parts is not None else state.select(F.lit(None).cast("int").alias("period"), "pid", F.col("mu").alias("rating"), F.col("phi").alias("rd"), "sigma")


HISTORY = "config int, pid bigint, week int, mu double, phi double, sigma double, seen int, start_mu double, start_phi double"


def rated_weeks(matches: DataFrame, engines: list[Engine], calendar: list[int] | None = None, seeds: DataFrame | None = None, initial: DataFrame | None = None, chain: int = 16) -> DataFrame:
    """(config, pid, week, mu, phi, sigma, seen, start_mu, start_phi): for each of the engines (config is its place in the list),
    the state of every known player after each week with matches; start_* is what the week's matches read, of players who played.

    One pass over the weeks rates all configurations. Players are dealt into buckets. In a week every bucket makes its players
    ready and tells their opponents what these read of them; that, and the bucket's own rows, go through one shuffle to the
    buckets, which form the sums and update their players. A row holds a bucket's records as bytes, so few rows are shuffled. ``chain`` weeks are one job
    (fewer, if players are many: what is done is carried to its end); its end is written to the checkpoint folder, and the next
    goes on from there. So a week is one stage, its work and its messages grow with its matches, and a task holds a bucket of
    players with one week's messages to them, and what is done in the chain.

    Unseen players start from their seed's rating (``seeds``: pid, rating), else from the initial one; players absent for
    ``reseed_after`` weeks start anew. Deviations of those about to play grow with the weeks since they were seen. Ratings
    of all others decay beyond the grace, for the weeks since the period before: weeks of the ``calendar`` without matches
    only move the clock, so nothing decays for them. Both sums are damped by the square root of the number of games;
    without information only the week in which a player was seen moves. ``initial`` (pid, mu, phi, sigma, seen) is a state to
    go on from. Matches with a null in a week, side or score are left out.
    """
    found = _done_weeks(matches, engines, calendar, seeds, initial, chain, STATES)
    return matches.sparkSession.createDataFrame([], HISTORY) if found is None else found.mapInArrow(history, HISTORY)


def start_values(matches: DataFrame, engines: list[Engine], chain: int = 16) -> DataFrame:
    """(pid, week, start_mu, start_phi): what a week's matches read of their players, an array with a value for each engine."""
    found, schema = _done_weeks(matches, engines, None, None, None, chain, READS), "pid bigint, week int, start_mu array<double>, start_phi array<double>"
    return matches.sparkSession.createDataFrame([], schema) if found is None else found.mapInArrow(partial(reads, len(engines)), schema)


def score_sums(matches: DataFrame, engines: list[Engine], chain: int = 16) -> DataFrame:
    """(config, yyyyww, n, scored, loss, squares, hits, decided): sums of the scores of predictions (`evaluate.sums`) by week.

    A player at home, once told what the opponent is like, has both values that the prediction is made of. So it is scored there
    and then: neither predictions nor what they are made of is carried, stored or joined to matches, only a few sums a week.
    """
    found, schema = _done_weeks(matches, engines, None, None, None, chain, SCORES), "config int, yyyyww int, n bigint, scored bigint, loss double, squares double, hits double, decided bigint"
    return matches.sparkSession.createDataFrame([], schema) if found is None else found.mapInArrow(scores, schema)


#: Players by configurations of a bucket at least; the most of one, where weeks give a record of each and where they
#: give less; and of all in chains of full length in the first case.
BUCKET, MOST, MOST_BARE, CHAINED = 8192, 100_000, 1_000_000, 2_000_000


def bucket_names(spark: SparkSession, count: int) -> list[int]:
    """Numbers for so many buckets, each of which the shuffle deals to a task of its own; numbers from 0 on share tasks, so one task
    would have three buckets and others none."""
    dealt = spark.range(0, 64 * count, 1, 1).select(F.col("id").cast("int").alias("name")).groupBy(F.pmod(F.hash("name"), F.lit(count)).alias("task")).agg(F.min("name").alias("name"))
    names = sorted(r.name for r in dealt.collect())  # one row a bucket
    return names + [k for k in range(2 * count) if k not in names][: count - len(names)]


def _done_weeks(matches: DataFrame, engines: list[Engine], calendar: list[int] | None, seeds: DataFrame | None, initial: DataFrame | None, chain: int, gives: int) -> DataFrame | None:
    """The packed history (week, data) of `rated_weeks`; nothing without weeks."""
    spark, root = matches.sparkSession, f"{folder(matches.sparkSession)}/ratings-{uuid.uuid4().hex}"
    needed = ["home_club_id", "away_club_id", "yyyyww"] if gives == SCORES else None  # predictions need no score
    known = matches.select("home_club_id", "away_club_id", "home_team_goals", "away_team_goals", "yyyyww").dropna(subset=needed)
    sides = both_sides(known, ["yyyyww"]).select("yyyyww", F.col("opponent").cast("bigint").alias("pid"), F.col("pid").cast("bigint").alias("other"), F.coalesce("score", F.lit(math.nan)).alias("x"), F.col("at_home").alias("home"))
    sides.repartition("yyyyww").write.partitionBy("yyyyww").parquet(f"{root}/sides")
    written = "pid bigint, other bigint, x double, home boolean, yyyyww int"
    scored = spark.read.schema(written).parquet(f"{root}/sides").where(~F.isnan("x"))
    have = [r[0] for r in scored.select("yyyyww").distinct().collect()]
    if not have:
        return None
    number = lambda w: w // 100 * 53 + w % 100  # noqa: E731  only to see which weeks come first
    clock, before = [], None
    for week in sorted(set(have) | set(calendar or ()), key=number):
        if week in set(have):
            clock.append((week, elapsed_weeks(before, week) if before is not None else 0))
        before = week

    players = scored.select("pid")
    if initial is not None:
        initial = initial.select(F.col("pid").cast("bigint").alias("pid"), "mu", "phi", "sigma", "seen")
        state = players.unionByName(initial.select("pid")).distinct().join(initial, "pid", "left")
    else:
        state = players.distinct().select("pid", *[F.lit(None).cast(t).alias(c) for c, t in (("mu", "double"), ("phi", "double"), ("sigma", "double"), ("seen", "int"))])
    start = F.lit(0.0)
    if seeds is not None:
        state = state.join(seeds.select("pid", F.col("rating").alias("_seed")), "pid", "left")
        centres = F.array(*[F.lit(e.rating) for e in engines])
        start = F.coalesce((F.col("_seed") - F.element_at(centres, F.col("config") + 1)) / SCALE, start)
    state = state.withColumn("config", F.explode(F.sequence(F.lit(0), F.lit(len(engines) - 1))))
    state = state.select("config", "pid", F.coalesce("seen", F.lit(0)).alias("week"), *[F.coalesce(c, F.lit(math.nan)).alias(n) for c, n in (("mu", "x"), ("phi", "y"), ("sigma", "z"))], start.alias("start"))
    state.write.parquet(f"{root}/start")
    seen = [r[0] for r in initial.select("seen").distinct().collect()] if initial is not None else []  # weeks of a calendar

    # A session of its own: adaptive plans would make a job of each shuffle.
    own = spark.newSession()
    rows = own.read.parquet(f"{root}/start").count()
    # As many buckets as there are cores, as long as none gets too large or too small: a week is one round of tasks.
    parts = max(min(-(-rows // BUCKET), spark.sparkContext.defaultParallelism), -(-rows // (MOST_BARE if gives == SCORES else MOST)))
    chain = chain if gives == SCORES else max(min(chain, 4), min(chain, CHAINED // rows))
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", str(parts))):
        own.conf.set(k, v)
    settings, names = {f.name: np.array([float(getattr(e, f.name)) for e in engines]) for f in fields(Engine)}, bucket_names(own, parts)

    def full(frame: DataFrame, kind: int, week: Column) -> DataFrame:
        dealt = frame.select(F.element_at(F.array(*map(F.lit, names)), F.pmod("pid", F.lit(parts)).cast("int") + 1).alias("bucket"), week.cast("int").alias("_week"), *FIELDS[kind])
        return dealt.groupBy("bucket", "_week").applyInArrow(lambda key, table: pack_group(kind, key, table), SCHEMA)

    def step(done: int | None, to_tell: int | None, gaps: dict[int, int], elapsed: int):
        def run(key, table):
            bucket = Bucket(table, settings, names, gives)
            if done is not None:
                bucket.update(done)
            if to_tell is not None:
                bucket.tell(to_tell, gaps, elapsed)
            return bucket.table()

        return run

    plain = "bucket int, week int, data binary"
    state, weeks_so_far = full(own.read.parquet(f"{root}/start"), STATE, F.lit(0)), {*seen} - {None}
    for at in range(0, len(clock), chain):
        weeks = clock[at : at + chain]
        played = own.read.option("basePath", f"{root}/sides").schema(written).parquet(*[f"{root}/sides/yyyyww={w}" for w, _ in weeks])
        rows, done = state.unionByName(full(played, SIDE, F.col("yyyyww"))), None
        for week, elapsed in [*weeks, (None, 0)]:
            gaps = {w: elapsed_weeks(w, week) for w in weeks_so_far} if week is not None else {}
            rows = rows.groupBy("bucket").applyInArrow(step(done, week, gaps, elapsed), SCHEMA)
            weeks_so_far |= {week} - {None}
            done = week
        rows.write.partitionBy("kind").parquet(f"{root}/chain={at}")
        state = own.read.schema(plain).parquet(f"{root}/chain={at}/kind={HELD}").select("bucket", F.lit(HELD).alias("kind"), "week", "data")
    return spark.read.schema(plain).parquet(*[f"{root}/chain={at}/kind={DONE}" for at in range(0, len(clock), chain)]).select("week", "data")


def weekly_states(matches: DataFrame, engine: Engine = Engine(), calendar: list[int] | None = None, seeds: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(week, pid, mu, phi, sigma, seen) of one engine, as `rated_weeks` has them."""
    return rated_weeks(matches, [engine], calendar, seeds, initial).select("week", "pid", "mu", "phi", "sigma", "seen")


def predicted(matches: DataFrame, starts: DataFrame) -> DataFrame:
    """Each match under each configuration: (config, result_id, yyyyww, home_club_id, away_club_id, p, actual), p from what the match
    read (`start_values`). Matches meet their sides once for all configurations."""
    side = lambda x: starts.select(F.col("week").alias("yyyyww"), F.col("pid").alias(f"{x}_club_id"), F.col("start_mu").alias(f"_{x}_mu"), F.col("start_phi").alias(f"_{x}_phi"))
    rows = matches.join(side("home").drop("_home_phi"), ["yyyyww", "home_club_id"]).join(side("away"), ["yyyyww", "away_club_id"])
    actual = score(F.col("home_team_goals"), F.col("away_team_goals"))
    rows = rows.select("result_id", "yyyyww", "home_club_id", "away_club_id", actual.alias("actual"), F.posexplode(F.arrays_zip("_home_mu", "_away_mu", "_away_phi")).alias("config", "_v"))
    return rows.select("config", "result_id", "yyyyww", "home_club_id", "away_club_id", expected(F.col("_v._home_mu"), F.col("_v._away_mu"), F.col("_v._away_phi")).alias("p"), "actual")


def elapsed_weeks(earlier: int, later: int) -> int:
    """Whole weeks between two packed weeks, as `weeks_between` counts them."""
    from datetime import date

    return max(0, (date.fromisocalendar(later // 100, later % 100, 7) - date.fromisocalendar(earlier // 100, earlier % 100, 7)).days // 7)


def ratings_of(states: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """(week, pid, rating, rd, sigma) of weekly states."""
    return states.select("week", "pid", (engine.rating + SCALE * F.col("mu")).alias("rating"), (SCALE * F.col("phi")).alias("rd"), "sigma")


def two_phases(matches: DataFrame, boundary: int, engine: Engine = Engine()) -> DataFrame:
    """A warm-up before the packed week ``boundary``, and the weeks from it on: (week, ...) of the latter. The clock starts
    anew with the second phase, which goes on from the last state of the first."""
    warm = weekly_states(matches.where(F.col("yyyyww") < boundary), engine)
    last = warm.join(F.broadcast(warm.agg(F.max("week").alias("week"))), "week").select("pid", "mu", "phi", "sigma", "seen")
    return weekly_states(matches.where(F.col("yyyyww") >= boundary), engine, initial=last)


def by_group(matches: DataFrame, group: str, run: Callable[[DataFrame], DataFrame], values: list) -> DataFrame:
    """A run of its own for each of the given values of a column (a country, say), with the value as a column."""
    parts = None
    for v in values:
        rows = run(matches.where(F.col(group) == F.lit(v))).withColumn(group, F.lit(v))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def match_changes(matches: DataFrame, weekly: DataFrame, places: int = 1) -> DataFrame:
    """Ratings and deviations of both sides before and after each match's week, rounded, and how far the ratings moved.

    ``weekly`` (week, pid, rating, rd) has whole states: before is the snapshot of the week before, 1500 and 350 where
    there is none; after is that of the match's week, else as before.
    """
    spine = weekly.select("week").distinct()
    before = spine.select(F.col("week").alias("yyyyww"), F.lag("week").over(Window.orderBy("week")).alias("_before"))  # one row a week
    rows = matches.select("result_id", "yyyyww", "home_club_id", "away_club_id").join(F.broadcast(before), "yyyyww", "left")
    for x in ("home", "away"):
        for when, key in (("pre", "_before"), ("post", "yyyyww")):
            own = weekly.select(F.col("week").alias(key), F.col("pid").alias(f"{x}_club_id"), F.col("rating").alias(f"_{x}_{when}"), F.col("rd").alias(f"_{x}_{when}_rd"))
            rows = rows.join(own, [key, f"{x}_club_id"], "left")
    out = ["result_id", "yyyyww"]
    for x in ("home", "away"):
        for part, default in (("", 1500.0), ("_rd", 350.0)):
            pre = F.coalesce(f"_{x}_pre{part}", F.lit(default))
            post = F.coalesce(F.col(f"_{x}_post{part}"), pre)
            out += [F.round(pre, places).alias(f"{x}_pre{part}"), F.round(post, places).alias(f"{x}_post{part}")]
            if not part:
                out.append(F.round(post - pre, places).alias(f"{x}_change"))
    return rows.select(*out)


def field_strength(matches: DataFrame, states: DataFrame, rd: float = INIT_RD, spread: float = 50.0, top: int = 150, target: float = 1000.0) -> DataFrame:
    """Per week and event: size, sum and mean of the ratings before the week, their decayed sum and that sum normalised.

    ``matches`` has yyyyww, event_id and both sides; ``states`` has for each week the ratings (week, pid, rating, rd) that its
    matches read. A part is the rating, less where the deviation is above ``rd``; parts decay with their rank. The norm
    makes the ``top`` parts of all players of the week worth ``target``.
    """
    part = F.col("rating") * F.least(F.lit(1.0), rd / F.greatest(F.col("rd"), F.lit(1e-12)))
    ranked = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("part"), "pid")) - 1
    decayed = F.sum(F.col("part") * F.exp(-(F.col("rank") * F.col("rank")) / (2 * spread**2)))
    known = states.select("week", "pid", "rating", part.alias("part"))
    # Only the best of every slice can be among the best of a week, so no task sorts a whole week.
    slices = known.withColumn("slice", F.pmod(F.xxhash64("pid"), F.lit(64)))
    best = slices.withColumn("rank", ranked(["week", "slice"])).where(F.col("rank") < top)
    norm = best.withColumn("rank", ranked(["week"])).where(F.col("rank") < top).groupBy("week").agg(F.when(decayed > 0, target / decayed).otherwise(1.0).alias("factor"))
    field = matches.select(F.col("yyyyww").alias("week"), "event_id", F.explode(F.array("home_club_id", "away_club_id")).alias("pid")).distinct().join(known, ["week", "pid"])
    fields = field.withColumn("rank", ranked(["week", "event_id"])).groupBy("week", "event_id").agg(F.count("*").alias("entities"), F.sum("rating").alias("total"), F.avg("rating").alias("mean"), decayed.alias("decayed"))
    return fields.join(F.broadcast(norm), "week").select("week", "event_id", "entities", "total", "mean", "decayed", (F.col("decayed") * F.col("factor")).alias("normalised"))
