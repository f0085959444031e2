"""Backward as-of joins and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Every left row with the right row's ``values`` of the latest ``right_time`` strictly before ``left_time``.

    One union and one window by the key, so rows aren't multiplied. Null where there is none. Of right rows at one time,
    the largest values win.
    """
    rows = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("v"))
    facts = right.select(F.lit(None).cast(rows.schema["l"].dataType).alias("l"), F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(1).alias("side"), F.struct(*values).alias("v"))
    w = Window.partitionBy("k").orderBy("t", "side", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(facts).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 0").select("l.*", *[F.col(f"v.{c}").alias(c) for c in values])


def snapshot(weekly: DataFrame, week: str = "week") -> DataFrame:
    """Rows of the latest week, by a scalar that Spark broadcasts (one row)."""
    return weekly.join(F.broadcast(weekly.agg(F.max(week).alias(week))), week)
