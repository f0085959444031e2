"""Series cut into stretches of even level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(rows: DataFrame, series: str, order: str, value: str, splits: int = 4, least: int = 8, shortest: int = 36) -> DataFrame:
    """(series, segment, start, end, n, mean): greedy binary cuts, each where it lowers the squared error most.

    A cut needs a gain of 1.5 % of the series' squared error and of six variances; a left part has at least ``least`` values,
    a right part more.
    Series below ``shortest`` values have no segments. Of equal gains the first place counts. A round is a pass of windows
    over rows that stay partitioned by series, so there is one shuffle for all rounds.
    """
    whole = Window.partitionBy(series)
    v = F.col("v")
    at = F.row_number().over(Window.partitionBy(series).orderBy(order)) - 1
    rows = rows.select(series, F.col(order).alias("at"), F.col(value).alias("v"), at.alias("i"))
    centred = v - F.avg("v").over(whole)
    rows = rows.withColumns({"n": F.count("*").over(whole), "v0": centred, "seg": F.lit(0)}).where(F.col("n") >= shortest)
    error = F.sum(F.col("v0") * F.col("v0")).over(whole)
    rows = rows.withColumn("needed", F.greatest(error * 0.015, error / F.col("n") * 6.0))
    part, c = Window.partitionBy(series, "seg"), F.col("v0")
    before = part.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(splits):
        left_n, size = F.col("i") - F.col("seg"), F.count("*").over(part)
        left, total = F.sum("v0").over(before), F.sum("v0").over(part)
        cut = rows.withColumns({"_l": left, "_ln": left_n, "_t": total, "_size": size})
        right_n = F.col("_size") - F.col("_ln")
        gain = F.col("_l") ** 2 / F.col("_ln") + (F.col("_t") - F.col("_l")) ** 2 / right_n - F.col("_t") ** 2 / F.col("_size")
        fits = (F.col("_ln") >= least) & (right_n > least)
        cut = cut.withColumn("_c", F.when(fits, F.struct(F.round(gain, 6).alias("gain"), (-F.col("seg")).alias("seg"), (-F.col("i")).alias("i"))))
        cut = cut.withColumn("_b", F.max("_c").over(whole))
        moved = (F.col("_b.gain") >= F.col("needed")) & (F.col("seg") == -F.col("_b.seg")) & (F.col("i") >= -F.col("_b.i"))
        rows = cut.withColumn("seg", F.when(moved, -F.col("_b.i")).otherwise(F.col("seg"))).select(*rows.columns)
    out = rows.groupBy(series, "seg").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"), F.avg("v").alias("mean"))
    return out.select(series, F.row_number().over(Window.partitionBy(series).orderBy("seg")).alias("segment"), "start", "end", "n", "mean")


def typical_step(parts: DataFrame, series: str) -> DataFrame:
    """Per series the number of segments and the mean absolute step between their means; 0 for a single one."""
    step = F.abs(F.col("mean") - F.lag("mean").over(Window.partitionBy(series).orderBy("segment")))
    return parts.withColumn("_s", step).groupBy(series).agg(F.count("*").alias("segments"), F.coalesce(F.avg("_s"), F.lit(0.0)).alias("step"))


def penalised_segments(rows: DataFrame, series: str, order: str, value: str, least: int = 6, jump: int = 2, shortest: int = 36, most: int = 8) -> DataFrame:
    """(series, segment, start, end, n, mean): the cuts with the least squared error plus a penalty for each segment.

    The penalty is five variances, 80 at least. Segments have at least ``least`` values and begin at multiples of ``jump``; of
    equal totals the earliest last cut counts. The first ``most`` segments are given; series below ``shortest`` have none.
    Exact: a fold over a series' places keeps for each the least total up to it, and drops earlier places that can't be the
    last cut any more, as their total already exceeds that of a later one. A series is one array, so of bounded length.
    """
    by = Window.partitionBy(series)
    run = by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v0")
    rows = rows.select(series, F.col(order).alias("at"), F.col(value).alias("v"))
    rows = rows.withColumns({"v0": F.col("v") - F.avg("v").over(by), "i": F.row_number().over(by.orderBy("at"))}).withColumn("n", F.count("*").over(by)).where(F.col("n") >= shortest)
    point = F.struct("i", F.sum(v).over(by.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.sum(v * v).over(by.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("q"), "at", "v")
    one = rows.select(series, "n", point.alias("p")).groupBy(series, "n").agg(F.array_sort(F.collect_list("p")).alias("p"))
    penalty = F.greatest(5.0 * F.element_at("p", -1)["q"] / F.col("n"), F.lit(80.0))
    one = one.withColumns({"s": F.concat(F.array(F.lit(0.0)), F.col("p.s")), "q": F.concat(F.array(F.lit(0.0)), F.col("p.q")), "pen": penalty})
    places = F.concat(F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(jump)), lambda k: k >= least), F.array(F.col("n"))).cast("array<int>")
    get = lambda c, k: F.get(F.col(c), k)
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluates x once

    def error(a: Column, b: Column) -> Column:
        level = get("s", b) - get("s", a)
        return get("q", b) - get("q", a) - level * level / (b - a)

    def place(acc: Column, b: Column) -> Column:
        """Candidates (total up to a place, that place) and, for each place, where its last segment begins."""
        scored = F.transform(F.filter(acc["open"], lambda c: c["t"] <= b - least), lambda c: F.struct((c["f"] + error(c["t"], b)).alias("f"), c["t"].alias("t"), c["f"].alias("own")))
        late = F.filter(acc["open"], lambda c: c["t"] > b - least)

        def choose(x: Column) -> Column:
            best = F.array_min(x["scored"])
            open_ = F.transform(F.filter(x["scored"], lambda c: c["f"] <= best["f"] + F.col("pen")), lambda c: F.struct(c["own"].alias("f"), c["t"].alias("t")))
            new = F.struct((best["f"] + F.col("pen")).alias("f"), b.alias("t"))
            link = F.struct(b.alias("t"), best["t"].alias("before"))
            return F.struct(F.concat(open_, x["late"], F.array(new)).alias("open"), F.concat(x["links"], F.array(link)).alias("links"))

        step = bound(F.struct(scored.alias("scored"), late.alias("late"), acc["links"].alias("links")), choose)
        return F.when(F.size(scored) > 0, step).otherwise(acc)

    start = F.struct(F.array(F.struct(F.lit(0.0).alias("f"), F.lit(0).alias("t"))).alias("open"), F.array().cast("array<struct<t:int,before:int>>").alias("links"))
    links = F.aggregate(places, start, place, lambda acc: acc["links"])
    back = F.aggregate(F.reverse("links"), F.array(F.col("n").cast("int")), lambda acc, k: F.when(k["t"] == F.element_at(acc, -1), F.concat(acc, F.array(k["before"]))).otherwise(acc))
    cuts = one.withColumn("links", links).withColumn("cuts", F.reverse(back))
    parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("cuts") - 1)), lambda k: F.struct(k.cast("int").alias("segment"), F.element_at("cuts", k).alias("a"), F.element_at("cuts", k + 1).alias("b")))
    out = cuts.select(series, "p", F.inline(parts))
    own = F.slice("p", F.col("a") + 1, F.col("b") - F.col("a"))
    mean = F.aggregate(own, F.lit(0.0), lambda t, x: t + x["v"]) / (F.col("b") - F.col("a"))
    return out.select(series, "segment", F.element_at("p", F.col("a") + 1)["at"].alias("start"), F.element_at("p", F.col("b"))["at"].alias("end"), (F.col("b") - F.col("a")).cast("long").alias("n"), mean.alias("mean"))
