"""Matches from raw season files and from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.functions.weeks import packed_week, parse_date

#: Header names that mean the same in season files.
ALIASES = {"home_team": ("HomeTeam", "HT", "Home"), "away_team": ("AwayTeam", "AT", "Away"), "home_goals": ("FTHG", "HG"), "away_goals": ("FTAG", "AG"), "result": ("FTR", "Res"), "match_date": ("Date",), "division": ("Div", "League"), "season": ("Season",)}
#: Competitions by order priority.
LEAGUES = ("UCL", "FA_CUP", "D3", "D4", "FRIENDLY_X")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (with a header) or Parquet by the path's ending; another ending is an error."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".txt")):
        reader = spark.read.option("header", True).option("mode", "DROPMALFORMED")
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unknown format: {path}")


def require(frame: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame


def season_files(spark: SparkSession, root: str) -> DataFrame:
    """Season files under root/country/season/league.csv: one CSV scan for each family of headers, over that family's files.

    One pass over the files finds their first lines. Quoted cells are read as CSV has them; blank lines and rows without both
    sides are dropped, cells beyond the header count no more, the season column wins over the path's. Files whose first
    line names no column of a match are left out.
    """
    lines = spark.read.text(f"{root}/*/*/*.csv").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("k"))
    heads = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "k").alias("header"))
    parts = None
    for family in heads.groupBy("header").agg(F.collect_list("path").alias("paths")).collect():  # the paths that the driver lists anyway
        names = [h.strip().strip('"') for h in (family.header or "").lstrip("\ufeff").split(",")]
        at = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
        if not any(n in at for alias in ALIASES.values() for n in alias):
            continue
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(sorted(family.paths))
        pick = [F.coalesce(*[F.nullif(F.trim(F.col(at[a])), F.lit("")) for a in alias if a in at] or [F.lit(None).cast("string")]).alias(c) for c, alias in ALIASES.items()]
        rows = raw.select(F.col("_metadata.file_path").alias("path"), *pick)
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        return spark.createDataFrame([], "country string, season string, league string, match_date date, home_team string, away_team string, home_goals int, away_goals int, result string")
    of = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.csv$", k)
    return parts.where("home_team IS NOT NULL AND away_team IS NOT NULL").select(of(1).alias("country"), F.coalesce("season", of(2)).alias("season"), of(3).alias("league"), parse_date(F.col("match_date")).alias("match_date"), "home_team", "away_team", F.expr("try_cast(home_goals AS int)").alias("home_goals"), F.expr("try_cast(away_goals AS int)").alias("away_goals"), "result")


#: Fixed value: the rows that a task sums up.
ROWS = 1_000_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows in tasks by the key, with no more than about ``ROWS`` in one, however large the table; counts come from its footers.

    What groups by the key, or by it and more, needs no shuffle then.
    """
    spark, n = rows.sparkSession, -(-rows.count() // ROWS)
    return rows.repartition(n, key) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the star schema: the two outer suppliers of an order meet; goals follow from the quantities they ship."""
    line = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    sides = line.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"), F.min_by("q", "l_suppkey").alias("q_lo"), F.max_by("q", "l_suppkey").alias("q_hi")).where("lo <> hi")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    even = F.col("o_orderkey") % 2 == 0
    pick = lambda a, b: F.when(even, F.col(a)).otherwise(F.col(b))
    day = F.col("o_orderdate").cast("date")
    league = F.element_at(F.array(*map(F.lit, LEAGUES)), F.substring("o_orderpriority", 1, 1).cast("int"))
    return orders.join(sides, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("result_id"), day.alias("match_date"), pick("lo", "hi").alias("home_club_id"), pick("hi", "lo").alias("away_club_id"), F.floor(pick("q_lo", "q_hi") / 10).cast("int").alias("home_team_goals"), F.floor(pick("q_hi", "q_lo") / 10).cast("int").alias("away_team_goals"), league.alias("league_code"), packed_week(day).alias("yyyyww"))


def clubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clubs with country and continent."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("club_name"), F.col("n_name").alias("country_name"), F.col("r_name").alias("continent"))
