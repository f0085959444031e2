"""Carrying whole input rows through Python stages without clashes of column names."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python workers live on from stage to stage, and Arrow's own allocator keeps what is freed: the system's gives it back.
pa.set_memory_pool(pa.system_memory_pool())
_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, else it grows with the arrays that are freed


def trimmed() -> None:
    """Gives freed memory back to the system, where its C library can; called when a task or group is done."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def packed(docs: DataFrame, text_col: str, **columns: Column) -> DataFrame:
    """``_row`` holds all input columns but the text, which is ``_text``; the named columns stand beside them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(True).alias("_none")]
    return docs.select(F.struct(*rest).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"), *[c.alias(n) for n, c in columns.items()])


def row_field(docs: DataFrame, text_col: str) -> T.StructField:
    rest = [f for f in docs.schema.fields if f.name != text_col] or [T.StructField("_none", T.BooleanType())]
    return T.StructField("_row", T.StructType(rest), True)


def unpacked(frame: DataFrame, docs: DataFrame, text_col: str, text: Column | None, /, **columns: Column) -> DataFrame:
    """The input's columns in their order with the text (left out if None), then the named ones; a named column replaces an input column of its name."""
    kept = []
    for c in docs.columns:
        if c == text_col:
            kept += [] if text is None else [text.alias(c)]
        elif c not in columns:
            kept.append(F.col(f"_row.`{c}`").alias(c))
    return frame.select(*kept, *[c.alias(n) for n, c in columns.items() if text is None or n != text_col])


def kept(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder of ``spark.checkpoint.dir``; local runs may set any folder.

    Without a folder this is an error: one made up here would be on one machine, and no executor of a cluster could read it.
    Rows in it survive lost executors. ``spark.cleaner.referenceTracking.cleanCheckpoints`` lets Spark remove them after use.
    """
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"{spark.conf.get('spark.local.dir', None) or '/tmp'}/spark-checkpoints")
    return frame.checkpoint()
