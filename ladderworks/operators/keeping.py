"""Tables that are computed once and cut from their lineage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors must share.

    Only a local run may go without it: there one machine has all files.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or f"{spark.conf.get('spark.local.dir', None) or '/tmp'}/spark-checkpoints")
    return context.getCheckpointDir()


def kept(frame: DataFrame) -> DataFrame:
    """The rows as a checkpoint, computed once and cut from their lineage."""
    folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The same as Parquet files in that folder, for large rows whose readers want few columns each or a range of them."""
    path = f"{folder(frame.sparkSession)}/{uuid4()}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
