"""Tables as versioned snapshots: a load is seen whole or not at all.

A table is a folder with a folder for each version. A load writes to a folder that readers don't look at, and becomes the next
version by one rename, which shared file systems do at once. Readers take the greatest version when they plan, and go on
reading it while newer ones come; ``expire`` removes versions that nobody should still read. The folder must be shared by the
driver and all executors, on a file system whose renames are atomic; on an object store, have its tables do this instead.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"v-(\d{10})")


class _Folder:
    """The table's folder by Hadoop's file interface, which knows every file system that Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.files = self.root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)

    def path(self, *parts: str):
        found = self.jvm.org.apache.hadoop.fs.Path(parts[0])
        for p in parts[1:]:
            found = self.jvm.org.apache.hadoop.fs.Path(found, p)
        return found

    def versions(self) -> list[int]:
        if not self.files.exists(self.root):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(self.root) if s.isDirectory())
        return sorted(int(m[1]) for m in map(_VERSION.fullmatch, names) if m)

    def rename(self, source: str, version: int) -> bool:
        """False where another load has taken the number."""
        target = self.path(self.root.toString(), f"v-{version:010d}")
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.context.rename(self.path(source), target, none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


def publish(spark: SparkSession, chunks: Iterable[DataFrame], root: str, by: list[str] | None = None) -> int:
    """Loads the chunks as one new version of the table, and returns its number.

    The first chunk starts the version and the others are appended to it; readers see none of it before all are there. A load
    that fails leaves the last version as it was. Without a chunk there is nothing to load, which is an error. Chunks without
    rows and null values of ``by`` (the partition columns) are all right; of two loads at a time both become versions.
    """
    staged, begun = f"{root}/.load-{uuid.uuid4().hex}", False
    folder = _Folder(spark, root)
    try:
        for chunk in chunks:
            chunk.write.mode("append" if begun else "error").partitionBy(*(by or [])).parquet(staged)
            begun = True
        if not begun:
            raise ValueError("no chunk to load")
        version = (folder.versions() or [0])[-1] + 1
        while not folder.rename(staged, version):
            version += 1
        return version
    except BaseException:
        folder.files.delete(folder.path(staged), True)
        raise


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The whole table as of a version, the newest unless one is given."""
    found = _Folder(spark, root).versions()
    if not found or (version is not None and version not in found):
        raise ValueError(f"no version {'' if version is None else version} of {root}")
    return spark.read.parquet(f"{root}/v-{version or found[-1]:010d}")


def since(table: DataFrame, week: int, year: int, week_col: str = "week", year_col: str = "year") -> DataFrame:
    """Rows from a week on, and of years from one on. The year is a partition column, so other years aren't read. Nulls are left out."""
    recent: Column = (F.col(year_col) >= year) & (F.col(year_col) >= week // 100)
    return table.where(recent & (F.col(week_col) >= week))


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Removes all but the newest versions, one at least stays; returns what is left."""
    folder = _Folder(spark, root)
    found = folder.versions()
    for version in found[: -max(1, keep)]:
        folder.files.delete(folder.path(root, f"v-{version:010d}"), True)
    return found[-max(1, keep) :]
