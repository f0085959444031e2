"""Settings of the engine and of the connectivity layer tried side by side: one pass over the data for all of them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import fields, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.functions.scoring import SCALE, expected
from ladderworks.operators import evaluate
from ladderworks.operators.asof import asof_before
from ladderworks.operators.keeping import kept
from ladderworks.operators.ratings import INIT_RD, Engine, predicted, score_sums, start_values

#: The settings of the default grid, 27 in all.
GRID = {"rd": [200.0, 250.0, 300.0], "sigma": [0.06, 0.08, 0.1], "tau": [0.3, 0.5, 0.8]}
#: Fixed value: the share of the weeks that comes before the hold-out.
SPLIT = 0.7


def configurations(grid: dict[str, list], base: Engine = Engine()) -> list[Engine]:
    """All combinations of the settings, the last one varying fastest."""
    return [replace(base, **dict(zip(grid, combo, strict=True))) for combo in itertools.product(*grid.values())]


def engine_predictions(matches: DataFrame, engines: list[Engine]) -> DataFrame:
    """Predictions of every match by every engine (config is its place in the list)."""
    matches = kept(matches.select("result_id", "yyyyww", "home_club_id", "away_club_id", "home_team_goals", "away_team_goals"))
    return predicted(matches, start_values(matches, engines))


def engine_scores(matches: DataFrame, engines: list[Engine]) -> DataFrame:
    """Sums of the scores of every engine's predictions by week: what `held_out` and `rolling_origin` need of them."""
    found = score_sums(matches, engines)
    return found.groupBy("config", "yyyyww").agg(*[F.sum(c).alias(c) for c in found.columns[2:]])


def _weekly_sums(predictions: DataFrame) -> DataFrame:
    """Sums of the scores by configuration and week, kept: all that follows reads these few rows, not predictions. ``i`` numbers
    the ``weeks`` from 0 on. `engine_scores` has such sums already."""
    sums = predictions if "p" not in predictions.columns else predictions.groupBy("config", "yyyyww").agg(*evaluate.sums(F.col("p"), F.col("actual")))
    sums = kept(sums)
    spine = sums.select("yyyyww").distinct().withColumn("i", F.row_number().over(Window.orderBy("yyyyww")) - 1)  # one row a week
    return sums.join(F.broadcast(spine.withColumn("weeks", F.count("*").over(Window.partitionBy(F.lit(1))))), "yyyyww")


def held_out(predictions: DataFrame, share: float = SPLIT) -> DataFrame:
    """Per configuration the scores of the last weeks: of n weeks those from the int(n * share)-th on, but neither all nor none."""
    split = F.greatest(F.lit(1), F.least(F.col("weeks") - 1, F.floor(F.col("weeks") * share)))
    rows = _weekly_sums(predictions).where(F.col("i") >= split)
    return rows.groupBy("config").agg(F.count("*").alias("weeks"), *evaluate.means()).select("config", "weeks", "n", "log_loss", "brier", "accuracy")


def rolling_origin(predictions: DataFrame, train: int = 10, step: int = 1) -> DataFrame:
    """Per configuration the mean scores of the splits after the first ``train`` weeks, ``step`` weeks each."""
    rows = _weekly_sums(predictions).where(F.col("i") >= train)
    split = F.floor((F.col("i") - train) / step).alias("split")
    parts = rows.groupBy("config", split).agg(*evaluate.means())
    return parts.groupBy("config").agg(F.count("*").alias("splits"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("log_loss", "brier", "accuracy")])


def ranked(scores: DataFrame, engines: list[Engine], by: str = "log_loss") -> DataFrame:
    """The scores with the settings that vary, and the best: the least value, of equal ones the first."""
    vary = [f.name for f in fields(Engine) if len({getattr(e, f.name) for e in engines}) > 1]
    named = [F.element_at(F.array(*[F.lit(float(getattr(e, n))) for e in engines]), F.col("config") + 1).alias(n) for n in vary]
    order = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last(by), "config"))  # one row a configuration
    return scores.select("config", *named, *[c for c in scores.columns if c != "config"]).withColumn("is_best", (order == 1) & F.col(by).isNotNull())


def sampled_settings(trials: int) -> list[dict[str, float]]:
    """Settings spread over their ranges by multiples of irrational numbers; trial 1 comes first."""
    roots = dict(zip(RANGES, (2, 3, 5, 7, 11, 13, 17, 19, 23), strict=True))
    return [{"trial": t} | {k: low + (high - low) * (t * roots[k] ** 0.5 % 1) for k, (low, high) in RANGES.items()} for t in range(1, trials + 1)]


#: The ranges that settings are drawn from.
RANGES = {
    "direct_floor": (0.01, 0.25),
    "community_floor": (0.01, 0.25),
    "half_life": (8.0, 80.0),
    "blend": (0.25, 0.9),
    "rd_scale": (8.0, 120.0),
    "rd_power": (0.7, 2.0),
    "trust_floor": (0.05, 0.45),
    "trust_rd": (80.0, 320.0),
    "baseline_blend": (0.35, 1.0),
}


def adjusted_by_settings(own: dict[str, np.ndarray], t: dict[str, float]) -> np.ndarray:
    """Adjusted ratings by the settings ``t``; NaN stands for null.

    ``own`` has rating, rd, all_mean, own_mean; of the windows volume and h_norm (null without matches), external and
    community_norm (null without matches elsewhere). As in SQL, the least and the greatest pass over nulls.
    """
    or_0 = lambda x: np.where(np.isnan(x), 0.0, x)
    trust = or_0(own["volume"] / (own["volume"] + t["half_life"]))
    direct = t["direct_floor"] + (1 - t["direct_floor"]) * or_0(own["h_norm"]) * trust
    outer = t["community_floor"] + (1 - t["community_floor"]) * or_0(own["community_norm"] * own["external"] / (own["external"] + t["half_life"]))
    effective = np.fmax(t["direct_floor"], np.fmin(1.0, t["blend"] * direct + (1 - t["blend"]) * outer))
    total = np.sqrt(own["rd"] ** 2 + (t["rd_scale"] * np.power(1 - effective, t["rd_power"])) ** 2)
    share = np.fmax(t["trust_floor"], np.fmin(1.0, t["trust_floor"] + (1 - t["trust_floor"]) * effective * trust / (1 + total / t["trust_rd"])))
    base = t["baseline_blend"] * own["all_mean"] + (1 - t["baseline_blend"]) * own["own_mean"]
    return np.where(own["rating"] <= base, own["rating"], base + share * (own["rating"] - base))


def tried(trials: list[dict[str, float]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the errors of a batch of matches, a row for each trial: formulas are computed once for all matches of the batch."""
    for batch in batches:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: E731,B023
        sides = {x: {c: column(f"_{x}_{c}") for c in ("pre", "week", *PARTS)} for x in ("home", "away")}
        actual, continental = column("actual"), column("continental") == 1
        rows = []
        for t in trials:
            value = {}
            for x, own in sides.items():
                found = adjusted_by_settings(own, t)
                value[x] = np.where(np.isnan(own["week"]) | np.isnan(found), own["pre"], found)
            error = np.abs(1 / (1 + np.power(10.0, (value["away"] - value["home"]) / 400)) - actual)
            known = ~np.isnan(error)
            rows.append((t["trial"], len(error), int(known.sum()), float(error[known].sum()), int((known & continental).sum()), float(error[known & continental].sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)], TRIED.replace(",", "").split()[::2])


#: What is summed up of a trial.
TRIED = "trial int, n bigint, known bigint, error double, continental bigint, continental_error double"
#: What a rating and its windows have.
PARTS = ["rating", "rd", "volume", "h_norm", "external", "community_norm", "all_mean", "own_mean"]


def connectivity_search(predictions: DataFrame, parts: DataFrame, trials: list[dict[str, float]]) -> DataFrame:
    """Per trial the mean absolute error of expectations from adjusted ratings, over all matches and the continental ones.

    Ratings are fixed and so are the windows: ``parts`` (week, pid and what `adjusted_by_settings` reads) are made once, and a
    match meets each side's last ones of an earlier week. Then both sides are in its row, and the trials, which differ in
    formulas only, are computed on arrays of matches; only sums by trial are shuffled then. A side without earlier parts
    has its rating before the match, if predictions have it (home_pre, away_pre), else 1500. ``result_id`` is unique.
    """
    pre = lambda x: F.col(x) if x in predictions.columns else F.lit(1500.0)
    side = lambda x: F.struct(F.lit(x == "home").alias("at_home"), F.col(f"{x}_club_id").alias("pid"), pre(f"{x}_pre").alias("pre"))
    sides = predictions.select("result_id", "yyyyww", (F.col("league_code") == "UCL").alias("continental"), "actual", F.inline(F.array(side("home"), side("away"))))
    met = asof_before(sides, parts.select("pid", "week", *PARTS), "pid", "yyyyww", "week", ["week", *PARTS])
    # Numbers are put together by hash; with texts or structs the rows of all matches would be sorted before and after their shuffle.
    of = lambda x, c: F.max(F.when(F.col("at_home") if x == "home" else ~F.col("at_home"), F.col(c))).alias(f"_{x}_{c}")
    both = met.groupBy("result_id").agg(F.max("continental").alias("continental"), F.max("actual").alias("actual"), *[of(x, c) for x in ("home", "away") for c in ("pre", "week", *PARTS)])
    sums = both.mapInArrow(partial(tried, trials), TRIED).groupBy("trial").agg(*[F.sum(c).alias(c) for c in ("n", "known", "error", "continental", "continental_error")])
    return sums.select("trial", "n", F.try_divide("error", "known").alias("mae"), F.try_divide("continental_error", "continental").alias("continental_mae"))


def elite_weeks(predictions: DataFrame, before: DataFrame, ranks: DataFrame, top: int = 500, least: int = 10, centre: float = 1500.0) -> DataFrame:
    """Per week the scores of the model and of an external ranking, over matches with a side among the best of either.

    ``predictions``: yyyyww, both sides, p and actual. ``before`` (week, pid, rating) and ``ranks`` (week, pid, rank) are what is known
    before the week. Ranks become ratings by the week's own line over the logarithm of the rank, if ``least`` clubs have
    both, else by 3000 - 160 ln(rank). A match counts if both sides have a rank.
    """
    both = before.join(ranks, ["week", "pid"])
    x, y = F.log(F.col("rank").cast("double")), F.col("rating")
    fit = both.groupBy("week").agg(F.count("*").alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    fit = fit.select("week", F.when(F.col("_n") >= least, F.col("_a")).otherwise(3000.0).alias("_a"), F.when(F.col("_n") >= least, F.col("_b")).otherwise(-160.0).alias("_b"))
    # Only the best of every slice can be among the best of a week, so no task sorts a whole week.
    slices = before.withColumn("_slice", F.pmod(F.xxhash64("pid"), F.lit(64)))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rating"), "pid"))
    best = slices.withColumn("_k", place("week", "_slice")).where(F.col("_k") <= top).withColumn("_k", place("week")).where(F.col("_k") <= top).select("week", "pid")
    elite = best.unionByName(ranks.where(F.col("rank") <= top).select("week", "pid")).distinct().withColumn("_elite", F.lit(True))
    known = ranks.join(elite, ["week", "pid"], "left")
    side = lambda s: known.select(F.col("week").alias("yyyyww"), F.col("pid").alias(f"{s}_club_id"), F.col("rank").alias(f"_{s}"), F.coalesce("_elite", F.lit(False)).alias(f"_{s}_elite"))
    rows = predictions.join(side("home"), ["yyyyww", "home_club_id"]).join(side("away"), ["yyyyww", "away_club_id"]).where("_home_elite OR _away_elite")
    rows = rows.join(F.broadcast(fit.withColumnRenamed("week", "yyyyww")), "yyyyww")
    level = lambda s: (F.col("_a") + F.col("_b") * F.log(F.greatest(F.lit(1), F.col(f"_{s}")).cast("double")) - centre) / SCALE
    rows = rows.withColumn("q", expected(level("home"), level("away"), F.lit(INIT_RD / SCALE)))
    scores = [c.alias(f"{kind}_{name}") for kind, p in (("model", "p"), ("rank", "q")) for name, c in zip(("n", "log_loss", "brier", "accuracy"), evaluate.metrics(F.col(p), F.col("actual"))[:4], strict=True) if name != "n"]
    return rows.groupBy(F.col("yyyyww").alias("week")).agg(F.count("*").alias("n"), *scores)
