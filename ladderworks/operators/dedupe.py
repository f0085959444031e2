"""Rows that stand for one thing: twins, later versions, ids that mean the same, numbers for new names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.operators.upsert import keep_first, new_rows, upsert

#: The continental competitions, whose rows come twice when a season is added again.
CONTINENTAL = ("UCL", "UEL", "UECL")


def drop_twins(matches: DataFrame, order: str = "result_id") -> DataFrame:
    """Of continental rows with one date, code and score the last stays, first by home side, then by away side."""
    twin = F.col("league_code").isin(*CONTINENTAL)
    score = ["match_date", "league_code", "home_team_goals", "away_team_goals"]
    rows = matches.where(twin)
    for side in ("home_club_id", "away_club_id"):
        rows = keep_first(rows, [*score, side], [F.desc(order)])
    return matches.where(~F.coalesce(twin, F.lit(False))).unionByName(rows)


def same_fixture_map(matches: DataFrame, created: DataFrame) -> DataFrame:
    """(old, new): a created id and the one other id that shares its date, score and opponent's side.

    ``created`` has one column, id. Where the other side of a group is exactly one created and one older id, the former is
    the latter. Of several answers for an id the smallest counts. Groups are sums of two small numbers, no pairs are made.
    """
    made = created.select(F.col("id").alias("other"), F.lit(True).alias("made")).distinct()
    score = ["match_date", "home_team_goals", "away_team_goals"]
    side = lambda me, other: F.struct(F.lit(me).alias("side"), F.col(f"{me}_club_id").alias("same"), F.col(f"{other}_club_id").alias("other"))
    rows = matches.where("match_date IS NOT NULL").select(*score, F.inline(F.array(side("home", "away"), side("away", "home")))).distinct()
    rows = rows.join(made, "other", "left").withColumn("made", F.coalesce("made", F.lit(False)))
    new, old = F.count_if(F.col("made")), F.count_if(~F.col("made"))
    ids = [F.min(F.when(F.col("made"), F.col("other"))).alias("old"), F.min(F.when(~F.col("made"), F.col("other"))).alias("new")]
    pairs = rows.groupBy("side", "same", *score).agg(new.alias("n_new"), old.alias("n_old"), *ids).where("n_new = 1 AND n_old = 1")
    return pairs.groupBy("old").agg(F.min("new").alias("new"))


def remapped(matches: DataFrame, ids: DataFrame) -> DataFrame:
    """Both sides' ids replaced by the map (old, new); ids without an entry stay."""
    rows = matches
    for side in ("home_club_id", "away_club_id"):
        rows = rows.join(ids.select(F.col("old").alias(side), F.col("new").alias("_new")), side, "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
    return rows.select(*matches.columns)


def merged_maps(maps: list[DataFrame]) -> DataFrame:
    """Maps (old, new) in one; the first that has an id decides."""
    rows = maps[0]
    for m in maps[1:]:
        rows = rows.unionByName(new_rows(m, rows, ["old"]))
    return rows.where("old <> new")


def smallest_ids(dim: DataFrame, key: Column, id_col: str, keep: dict[str, int] | None = None) -> DataFrame:
    """(key, id, ids): the id that each key keeps, the smallest unless ``keep`` names another, and how many it has."""
    rows = dim.groupBy(key.alias("key")).agg(F.min(id_col).alias("id"), F.count_distinct(id_col).alias("ids"))
    if not keep:
        return rows
    chosen = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])[F.col("key")]
    return rows.withColumn("id", F.coalesce(chosen.cast("bigint"), "id"))


def numbered(rows: DataFrame, position: str, name: str, ties: tuple[str, ...] = (), start: int = 1, width: int = 1 << 20) -> DataFrame:
    """Rows numbered from ``start`` in the order of a whole number, without one task for all of them.

    Positions are cut into spans of ``width``; a span is numbered alone and begins after the rows of all spans before it. The
    spans' sizes are one row for each ``width`` positions. Equal positions are ordered by ``ties``.
    """
    span = F.floor(F.col(position) / width)
    rows = rows.withColumn("_span", span)
    before = F.sum("n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("_span").agg(F.count("*").alias("n")).select("_span", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_span").orderBy(position, *ties))
    return rows.join(sizes, "_span").withColumn(name, own + F.col("_before") + (start - 1)).drop("_span", "_before")


def first_seen(rows: DataFrame, value: str, position: str) -> DataFrame:
    """(value, first, key): distinct values numbered in the order in which they first stand."""
    return numbered(rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("first")), "first", "key", (value,))


def append_new(dim: DataFrame, incoming: DataFrame, key: str, id_col: str, position: str) -> DataFrame:
    """A dimension with the incoming keys it lacks, whose ids go on after its largest, in the order of ``position``."""
    fresh = new_rows(incoming.groupBy(key).agg(F.min(position).alias("_p")), dim, [key])
    top = F.broadcast(dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top")))  # one row
    made = numbered(fresh, "_p", "_n", (key,)).crossJoin(top).select(key, (F.col("_top") + F.col("_n")).alias(id_col))
    return dim.select(key, id_col).unionByName(made)


def merge_slice(main: DataFrame, staged: DataFrame, year: Column, keys: list[str]) -> DataFrame:
    """Main with staged rows merged into the years they have: there the staged row wins by key, other years stay as they are."""
    years = staged.select(year.alias("_y")).distinct()
    marked = main.withColumn("_y", year)
    touched, rest = (marked.join(F.broadcast(years), "_y", how).drop("_y") for how in ("left_semi", "left_anti"))  # a few years
    return rest.unionByName(upsert(touched, staged, keys))
