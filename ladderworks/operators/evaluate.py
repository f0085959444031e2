"""Quality of predictions and shape of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.functions.scoring import fixed_bin


def metrics(p: Column, actual: Column) -> list[Column]:
    """Log loss (clipped), squared error, accuracy without draws, mean absolute and root squared error."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    hit = F.when(actual != 0.5, ((p >= 0.5) == (actual == 1.0)).cast("double"))
    return [F.count("*").alias("n"), F.avg(-(actual * F.log(q) + (1 - actual) * F.log(1 - q))).alias("log_loss"), F.avg((p - actual) ** 2).alias("brier"), F.avg(hit).alias("accuracy"), F.avg(F.abs(p - actual)).alias("mae"), F.sqrt(F.avg((p - actual) ** 2)).alias("rmse")]


def sums(p: Column, actual: Column) -> list[Column]:
    """Sums and counts that `means` makes the first four of `metrics` from, so that groups can be put together."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    hit = F.when(actual != 0.5, ((p >= 0.5) == (actual == 1.0)).cast("double"))
    return [F.count("*").alias("n"), F.count(p - actual).alias("scored"), F.sum(-(actual * F.log(q) + (1 - actual) * F.log(1 - q))).alias("loss"), F.sum((p - actual) ** 2).alias("squares"), F.sum(hit).alias("hits"), F.count(hit).alias("decided")]


def means() -> list[Column]:
    share = lambda total, n: F.try_divide(F.sum(total), F.sum(n))
    return [F.sum("n").alias("n"), share("loss", "scored").alias("log_loss"), share("squares", "scored").alias("brier"), share("hits", "decided").alias("accuracy")]


def calibration(rows: DataFrame, p: str, actual: str, width: float = 0.05, few: int = 30) -> DataFrame:
    """Per bin of the prediction: size, means, gap, shares of wins, draws and losses, and whether the bin is small."""
    share = lambda v: F.avg((F.col(actual) == v).cast("double"))
    out = rows.groupBy(F.round(fixed_bin(F.col(p), width), 6).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(actual).alias("mean_actual"), share(1.0).alias("win"), share(0.5).alias("draw"), share(0.0).alias("loss"))
    return out.withColumn("gap", F.col("mean_actual") - F.col("mean_predicted")).withColumn("small", F.col("n") < few)


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rank correlation within each group; ties share their mean rank."""
    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(group).orderBy(c)) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2

    return rows.withColumns({"_x": mean_rank(x), "_y": mean_rank(y)}).groupBy(group).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("rho"))


def best_split(rows: DataFrame, series: str, order: str, value: str, least: int = 8) -> DataFrame:
    """Per series: where one split lowers the squared error most (first index of the right part), and by how much.

    The left part has at least ``least`` values, the right part more; shorter series have none. Prefix sums in one window."""
    w = Window.partitionBy(series).orderBy(order)
    whole = Window.partitionBy(series)
    v = F.col(value)
    rows = rows.select(series, (F.row_number().over(w)).alias("i"), F.count("*").over(whole).alias("n"), F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.sum(v * v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("q"), F.sum(v).over(whole).alias("all_s"), F.sum(v * v).over(whole).alias("all_q"))
    left = F.col("q") - F.col("s") ** 2 / F.col("i")
    right = (F.col("all_q") - F.col("q")) - (F.col("all_s") - F.col("s")) ** 2 / (F.col("n") - F.col("i"))
    cut = rows.where((F.col("i") >= least) & (F.col("n") - F.col("i") > least)).withColumns({"cost": left + right, "total": F.col("all_q") - F.col("all_s") ** 2 / F.col("n")})
    best = F.row_number().over(Window.partitionBy(series).orderBy(F.round("cost", 6), "i"))
    return cut.withColumn("_r", best).where("_r = 1").select(series, "n", F.col("i").alias("split"), (F.col("total") - F.col("cost")).alias("gain"))


def trend(rows: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Per series: yearly slope over the index, and the spread of its steps."""
    w = Window.partitionBy(series).orderBy(order)
    rows = rows.select(series, (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("v"), (F.col(value) - F.lag(value).over(w)).alias("step"))
    return rows.groupBy(series).agg(F.count("*").alias("n"), (F.regr_slope("v", "i") * 52).alias("slope"), F.stddev_pop("step").alias("volatility"))
