"""Tables of relational databases: scans split by predicates, and loads in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def year_predicates(column: str, first: int, last: int) -> list[str]:
    """A condition for each year of a column of packed weeks, named as the database has it (in quotes where it needs them).

    Each row, null weeks too, meets exactly one: the first and last are open.
    """
    if first > last:
        raise ValueError("the first year is after the last")
    out = []
    for year in range(first, last + 1):
        low = f"{column} >= {100 * year}" if year > first else ""
        high = f"{column} < {100 * (year + 1)}" if year < last else ""
        bounds = " AND ".join(b for b in (low, high) if b) or "1 = 1"
        out.append(f"({bounds}) OR {column} IS NULL" if year == first and (low or high) else bounds)
    return out


def scan(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, fetch: int = 10_000, **properties: str) -> DataFrame:
    """The table's rows, a partition for each predicate (one for all without). Filters and columns of the plan go to the database."""
    properties |= {"fetchsize": str(fetch)}
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def replace(rows: DataFrame, url: str, table: str, batch: int = 5_000, writers: int = 8, **properties: str) -> None:
    """The rows instead of the table's own, whose definition stays; so many connections at most, with batches of so many rows."""
    settings = properties | {"truncate": "true", "batchsize": str(batch), "numPartitions": str(writers)}
    rows.write.jdbc(url, table, mode="overwrite", properties=settings)


def append(rows: DataFrame, url: str, table: str, batch: int = 5_000, writers: int = 8, **properties: str) -> None:
    """The rows after the table's own."""
    rows.write.jdbc(url, table, mode="append", properties=properties | {"batchsize": str(batch), "numPartitions": str(writers)})
