"""Queries over the weekly history as a versioned snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ladderworks.operators.keeping import folder
from ladderworks.plans.common import rounded, sql, weekly
from ladderworks.sources import snapshots

SINCE_WEEK, SINCE_YEAR = 199620, 1995


def _stored(s, d):
    """The weekly history, loaded in two chunks."""
    rows = weekly(s, d).select("week", "pid", "rating", "rd", F.floor(F.col("week") / 100).cast("int").alias("year"))
    root = f"{folder(s)}/weekly-{uuid.uuid4().hex}"
    snapshots.publish(s, [rows.where("pid % 2 = 0"), rows.where("pid % 2 = 1")], root, ["year"])
    return snapshots.read(s, root)


def recent_weeks(s, d):
    """From a week on and of recent years: predicates of a scan that reads no other year."""
    return rounded(snapshots.since(_stored(s, d), SINCE_WEEK, SINCE_YEAR).select("week", "pid", "rating", "rd"))


def whole_table(s, d):
    return rounded(_stored(s, d).select("week", "pid", "rating", "rd"))


QUERIES = {"SRC11_recent_weeks": recent_weeks, "SRC12_whole_table": whole_table}


def oracle_sql() -> dict[str, str]:
    columns = "week, pid, round(rating, 5) AS rating, round(rd, 5) AS rd"
    return {
        "SRC11_recent_weeks": sql("fcbsw", f" SELECT {columns} FROM w WHERE week >= {SINCE_WEEK} AND week // 100 >= {SINCE_YEAR}"),
        "SRC12_whole_table": sql("fcbsw", f" SELECT {columns} FROM w"),
    }
