"""Matches as a stream: weekly tallies behind a watermark, activity spells, and slices refreshed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderworks.operators.keeping import kept
from ladderworks.operators.ratings import Engine, weekly_states
from ladderworks.operators.upsert import keep_first, replace_slices


def weekly_tallies(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Per Monday week and kind: events and their value. Rows later than ``late`` are dropped in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    week = F.window("ts", "7 days", "7 days", "4 days")
    return rows.groupBy(week.alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("week_start"), "kind", "n", "value")


def spells(events: DataFrame, gap: str = "12 hours", late: str = "7 days") -> DataFrame:
    """Activity spells of an entity: events that are at most ``gap`` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "entity").agg(F.count("*").alias("n")).select("entity", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def _path(spark: SparkSession, path: str):
    """The path's file system, whichever it is, and the path in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def merge_slices(batch: DataFrame, path: str, keys: list[str], by: str, order: str | None = None) -> None:
    """Merges rows into a table that lies in slices (values of ``by``), whole slices at a time; others aren't read but for their keys.

    Of rows with one key, in the batch or in the table, that of the greatest ``order`` counts, a row of the batch before one of the
    table; without an order the batch's row, and in a batch the greatest row. A key that comes in another slice than before
    leaves the old one; a slice that loses all its rows is removed. A batch that comes twice changes nothing.
    """
    spark = batch.sparkSession
    newest = [F.desc_nulls_last(order)] if order else []
    rest = [F.desc_nulls_last(c) for c in batch.columns]
    batch = kept(keep_first(batch, keys, [*newest, *rest]))
    files, place = _path(spark, path)
    if not files.exists(place):
        replace_slices(batch, path, by)
        return
    main = spark.read.parquet(path).select(batch.columns)
    same = batch.select(*keys).distinct()
    touched = kept(batch.select(by).unionByName(main.select(*keys, by).join(same, keys, "left_semi").select(by)).distinct())  # a few slices
    old = main.join(F.broadcast(touched), by, "left_semi").withColumn("_new", F.lit(0))
    merged = keep_first(old.unionByName(batch.withColumn("_new", F.lit(1))), keys, [*newest, F.desc("_new")]).drop("_new")
    merged = kept(merged)
    replace_slices(merged, path, by)
    for row in touched.join(merged.select(by).distinct(), by, "left_anti").collect():
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={row[0]}"), True)


def refresh_slices(stream: DataFrame, path: str, keys: list[str], by: str, checkpoint: str, order: str | None = None):
    """Merges each micro-batch into the slices (values of ``by``) that it touches, as `merge_slices` does."""
    write = lambda batch, _: merge_slices(batch, path, keys, by, order)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_weeks(batch: DataFrame, path: str, engine: Engine = Engine()) -> None:
    """Takes matches, late ones too, into the tables under ``path`` and brings the ratings up to date.

    The first week that the batch touches is found; the states before it stay, and the weeks from it on are rated anew, going on
    from the last good state with the clock as it was. The same states come out as if all matches had come in time.
    ``matches`` lies in weeks, ``states`` (week, pid, mu, phi, sigma, seen) as well; a batch that comes twice changes nothing.
    """
    spark = batch.sparkSession
    first = batch.agg(F.min("yyyyww")).first()[0]
    if first is None:
        return
    merge_slices(batch, f"{path}/matches", ["result_id"], "yyyyww")
    files, place = _path(spark, f"{path}/states")
    last, initial = None, None
    if files.exists(place):
        states = spark.read.parquet(f"{path}/states")
        last = states.where(F.col("week") < first).agg(F.max("week")).first()[0]
        initial = states.where(F.col("week") == last).select("pid", "mu", "phi", "sigma", "seen") if last is not None else None
    played = spark.read.parquet(f"{path}/matches").where(F.col("yyyyww") >= first)
    replace_slices(weekly_states(played, engine, calendar=[last] if last is not None else None, initial=initial), f"{path}/states", "week")


def rate_stream(stream: DataFrame, path: str, checkpoint: str, engine: Engine = Engine()):
    """Ratings kept up to date with a stream of matches, micro-batch by micro-batch, as `replay_weeks` does."""
    write = lambda batch, _: replay_weeks(batch, path, engine)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
