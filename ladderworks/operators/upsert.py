"""Keeping one of several rows, and replacing slices of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order. Null keys are a key of their own."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def new_rows(staged: DataFrame, main: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows whose keys, nulls included, the main table lacks."""
    same = None
    other = main.select(*[F.col(k).alias(f"_{k}") for k in keys])
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = test if same is None else same & test
    return staged.join(other, same, "left_anti")


def upsert(main: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Main and staged rows; where keys agree, the staged row counts."""
    return new_rows(main, staged, keys).unionByName(staged, allowMissingColumns=True)


def replace_slices(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows over the slices (values of ``by``) that they have; other slices stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def closed_map(pairs: DataFrame) -> DataFrame:
    """A remap (old, new) followed to its end; self maps are left out. What runs into a cycle ends at its smallest member.

    Steps double in every round, with the smallest member passed. Rounds go on until every path has ended, or has gone
    more steps than there are pairs: those that haven't ended then are in a cycle, and have been all around it.
    """
    from ladderworks.operators.keeping import kept

    step = kept(pairs.where("old <> new").groupBy("old").agg(F.min("new").alias("new")))
    now, steps, size = step.select("old", "new", F.col("new").alias("low")), 1, step.count()
    while True:
        hop = now.select(F.col("old").alias("new"), F.col("new").alias("next"), F.col("low").alias("next_low"))
        joined = kept(now.join(hop, "new", "left").select("old", "new", "low", "next", "next_low"))
        if steps > size or joined.where("next IS NOT NULL").isEmpty():
            break
        now, steps = joined.select("old", F.coalesce("next", "new").alias("new"), F.least("low", "next_low").alias("low")), 2 * steps
    return joined.select("old", F.coalesce("next_low", "new").alias("new")).where("old <> new")
