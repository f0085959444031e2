"""Names resolved to known clubs: exact keys, then fuzzy matches, then new ids; and staged rows brought to a main table's ids.

Fuzzy matches come from two inverted indexes and no pairs are compared that neither of them yields. Both lose no pair of the
wanted score: what the score allows two names to differ by, bounds how many words or pieces of words of a name can
be missing in the other one, and one more than that, the rarest, are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.functions.names import canonical_name, token_set_score
from ladderworks.operators.dedupe import merge_slice, numbered
from ladderworks.operators.keeping import kept

#: Fixed value: the least score of a fuzzy match.
LEAST = 88.0
#: White space as Python's split() has it.
_BLANK = "(?U)[\\s\\x1C-\\x1F]+"


def _described(names: DataFrame) -> DataFrame:
    """(name, words, size, odd): distinct names with words, the length of the words joined by spaces, and a bit for each letter
    (by code point modulo 63) that stands in them an odd number of times."""
    words = F.array_distinct(F.filter(F.split("name", _BLANK), lambda w: w != ""))
    rows = names.where("name IS NOT NULL").select("name").distinct().withColumn("words", words).where(F.size("words") > 0)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 63)
    odd = F.aggregate(F.split(F.array_join("words", ""), ""), F.lit(0).cast("bigint"), lambda acc, c: F.when(c == "", acc).otherwise(acc.bitwiseXOR(bit(c))))
    return rows.withColumns({"size": F.length(F.array_join("words", " ")), "odd": odd})


def _word_prefixes(units: DataFrame, s: float) -> DataFrame:
    """Of each name the rarest words, as many as can't all be missing in a name that holds most of it.

    With x letters of a name of size T missing, the score of what is shared is at least s only if
    (1 + x) <= (1 - s) (2 T - 1 - x), so x <= ((1 - s) (2 T - 1) - 1) / (2 - s).
    """
    rare = Window.partitionBy("name").orderBy("n", "unit")
    before = F.coalesce(F.sum(F.length("unit") + 1).over(rare.rowsBetween(Window.unboundedPreceding, -1)) - 1, F.lit(0))
    most = F.greatest(F.lit(0.0), ((1 - s) * (2 * F.col("size") - 1) - 1) / (2 - s))
    return units.withColumn("_before", before).where(F.col("_before") <= most + 1e-9).select("name", "size", "unit")


def _pieces(q: Column) -> Column:
    """Every word in pieces of q letters or some more; words of fewer letters have none."""
    cut = lambda w, p: F.transform(F.sequence(F.lit(1), p), lambda k: F.substr(w, F.floor((k - 1) * F.length(w) / p).cast("int") + 1, (F.floor(k * F.length(w) / p) - F.floor((k - 1) * F.length(w) / p)).cast("int")))
    return F.flatten(F.transform(F.filter("words", lambda w: F.length(w) >= q), lambda w: cut(w, F.floor(F.length(w) / q).cast("int"))))


def _edited(x: DataFrame, y: DataFrame, s: float, strict: bool) -> DataFrame:
    """(_x, _y): described names and those of ``y`` that are as long or longer (strict: longer) whose letters may be alike enough.

    Letters put in or left out are at most (1 - s) times both sizes, and odd if the sizes' sum is. Each breaks at most one of
    the pieces that words are cut into, so of one piece more than that at least one stands within a word of the other name. Pieces
    are cut in two sizes, and those count whose rarest pieces are in the fewest names of the other size. Each edit
    moves a letter's bit of ``odd`` too. Names with too few letters for so many pieces meet all names of the size.
    """
    to = F.explode(F.sequence(F.col("size") + int(strict), F.greatest(F.col("size") + int(strict), F.floor(F.col("size") * (2 - s) / s + 1e-9).cast("int"))))
    sizes = y.select(F.col("size").alias("to")).distinct()
    most = F.floor((1 - s) * (F.col("size") + F.col("to")) + 1e-9)
    rows = x.withColumn("to", to).join(F.broadcast(sizes), "to").withColumn("k", (most - (most + F.col("size") + F.col("to")) % 2 + 1).cast("int")).where("k > 0")
    lengths = F.transform("words", F.length)
    enough = lambda q: F.aggregate(lengths, F.lit(0), lambda n, size: n + F.floor(size / q).cast("int")) >= F.col("k")
    rows = rows.withColumn("q", F.array_max(F.filter(F.sequence(F.lit(1), F.array_max(lengths)), enough)))
    cuts = rows.where("q IS NOT NULL").withColumn("q", F.explode(F.filter(F.array("q", F.col("q") - 1), lambda q: q > 0)))
    pieces = kept(cuts.select("name", "odd", "to", "k", "q", F.posexplode(_pieces(F.col("q"))).alias("at", "piece")))
    wanted = pieces.select("to", F.length("piece").alias("long")).distinct()
    parts = F.transform(F.filter("words", lambda w: F.length(w) >= F.col("long")), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - F.col("long") + 1), lambda k: F.substr(w, k, F.col("long"))))
    held = y.withColumnRenamed("size", "to").join(F.broadcast(wanted), "to").select("to", F.col("name").alias("_y"), F.col("odd").alias("_odd"), F.explode(F.array_distinct(F.flatten(parts))).alias("piece"))
    often = held.groupBy("to", "piece").agg(F.count("*").alias("n"))
    known = pieces.join(often, ["to", "piece"], "left").withColumn("n", F.coalesce("n", F.lit(0))).repartition("name", "to")
    cut = Window.partitionBy("name", "to", "q")
    rare = known.withColumn("_r", F.row_number().over(cut.orderBy("n", "at"))).where("_r <= k").withColumn("cost", F.sum("n").over(cut))
    best = rare.withColumn("_b", F.rank().over(Window.partitionBy("name", "to").orderBy("cost", F.desc("q")))).where("_b = 1 AND n > 0")
    moved = F.bit_count(F.col("odd").bitwiseXOR(F.col("_odd"))) < F.col("k")
    met = best.select("name", "odd", "to", "k", "piece").distinct().join(held, ["to", "piece"])
    short = rows.where("q IS NULL").select("name", "odd", "to", "k").join(y.select(F.col("size").alias("to"), F.col("name").alias("_y"), F.col("odd").alias("_odd")), "to")
    return met.drop("piece").unionByName(short).where(moved).select(F.col("name").alias("_x"), "_y")


def candidates(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): names of the left and of the right that may score ``least`` or more; no pair that does is missing."""
    s = least / 100
    sides = [kept(_described(left)), kept(_described(right))]
    units = [d.select("name", "size", F.explode("words").alias("unit")) for d in sides]
    often = units[0].select("unit").unionByName(units[1].select("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    found = None
    for i in (0, 1):
        x, y = ("a", "b") if i == 0 else ("b", "a")
        rare = _word_prefixes(units[i].join(often, "unit"), s)
        words = rare.select(F.col("name").alias(x), "unit").join(units[1 - i].select(F.col("name").alias(y), "unit"), "unit").select("a", "b")
        edited = _edited(sides[i], sides[1 - i], s, i == 1).select(F.col("_x").alias(x), F.col("_y").alias(y)).select("a", "b")
        both = words.unionByName(edited)
        found = both if found is None else found.unionByName(both)
    return found.distinct()


def _scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([token_set_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_names(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, score): names of the left and the right (column ``name``) whose token-set score is at least ``least`` (above 50).

    Names that are null or have no words are like none. Repeated names count once.
    """
    score = F.pandas_udf(_scores, "double")
    return candidates(left, right, least).withColumn("score", score("a", "b")).where(F.col("score") >= least)


def suggestions(names: DataFrame, clubs: DataFrame, least: float = LEAST) -> DataFrame:
    """(name, country_id, suggestion, score, club_id): the best fuzzy match of each distinct (name, country_id) that has one.

    Clubs (club_id, club_name, country_id) of the name's own country come first, then all; then the score, then the smallest id.
    The club is that of the smallest id among those of the suggested name, wherever they are.
    """
    names = names.select("name", "country_id").distinct()
    alike = similar_names(names, clubs.select(F.col("club_name").alias("name")), least)
    dim = clubs.where("club_name IS NOT NULL").groupBy(F.col("club_name").alias("b"), F.col("country_id").alias("_country")).agg(F.min("club_id").alias("_id"))
    rows = names.join(alike, names["name"] == alike["a"]).join(dim, "b")
    home = F.coalesce(F.col("country_id") == F.col("_country"), F.lit(False))
    best = rows.groupBy("name", "country_id").agg(F.min(F.struct((~home).alias("away"), (-F.col("score")).alias("less"), F.col("_id"), F.col("b"))).alias("m"))
    ids = dim.groupBy("b").agg(F.min("_id").alias("club_id"))
    return best.select("name", "country_id", F.col("m.b").alias("b"), (-F.col("m.less")).alias("score")).join(ids, "b").select("name", "country_id", F.col("b").alias("suggestion"), "score", "club_id")


def grouped(pairs: DataFrame) -> DataFrame:
    """(node, least): of the undirected pairs (a, b) each node with the smallest of its component.

    Every node takes the smallest label around it, and then that label's own one, until none moves.
    """
    both = kept(pairs.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("least"))
    while True:
        told = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("least").alias("low"))
        near = kept(labels.join(told, "node").select("node", F.least("least", "low").alias("least"), F.col("least").alias("was")))
        onward = near.select(F.col("node").alias("least"), F.col("least").alias("next"))
        labels = kept(near.join(onward, "least", "left").select("node", F.least("least", "next").alias("least"), "was"))
        if labels.where("least <> was").isEmpty():
            return labels.select("node", "least")
        labels = labels.drop("was")


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("key", F.nullif(canonical_name(F.col(name)), F.lit("")))


def club_keys(clubs: DataFrame) -> DataFrame:
    """(key, club_id): the smallest id of each key."""
    return _keyed(clubs, "club_name").where("key IS NOT NULL").groupBy("key").agg(F.min("club_id").alias("club_id"))


def resolve_names(names: DataFrame, clubs: DataFrame, create: bool = False, fuzzy: bool = True, least: float = LEAST) -> DataFrame:
    """(name, country_id, key, club_id, how, suggestion, score) of each distinct name and country of ``names`` (seq, name, country_id).

    how: 'exact' (the key is a club's), 'fuzzy' (the first row of the key, by seq, that has a match decides for the key from
    there on; rows before it are unresolved), 'created' or 'unresolved'. With ``create`` the key's first row decides alone: a
    match, or else a new club. New names that are alike are one club: ids go on after the largest one, in the order in
    which the groups first stand. Names without a key (null, blank, affixes only) are unresolved.
    """
    rows = _keyed(names.groupBy("name", "country_id").agg(F.min("seq").alias("seq")), "name")
    exact = rows.join(club_keys(clubs), "key", "left")
    open_rows = kept(exact.where("club_id IS NULL AND key IS NOT NULL").drop("club_id"))
    order = Window.partitionBy("key").orderBy("seq", "name", "country_id")
    if fuzzy:
        hits = suggestions(open_rows, clubs, least)
        tried = open_rows.join(hits, open_rows["name"].eqNullSafe(hits["name"]) & open_rows["country_id"].eqNullSafe(hits["country_id"]), "left").select(open_rows["*"], "suggestion", "score", "club_id")
    else:
        tried = open_rows.withColumns({"suggestion": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "club_id": F.lit(None).cast("bigint")})
    tried = kept(tried.withColumn("_k", F.row_number().over(order)))
    mine = F.struct("club_id", "suggestion", "score")
    if create:
        first = F.first(mine).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    else:
        first = F.first(F.when(F.col("club_id").isNotNull(), mine), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    led = tried.withColumn("_first", first).select("name", "country_id", "key", "seq", "_k", F.col("_first.club_id").alias("club_id"), F.col("_first.suggestion").alias("suggestion"), F.col("_first.score").alias("score"))
    how = F.when(F.col("club_id").isNotNull(), "fuzzy").otherwise("unresolved")
    out = ["name", "country_id", "key", "club_id", "how", "suggestion", "score"]
    blank = {"suggestion": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}
    done = exact.where("club_id IS NOT NULL OR key IS NULL").withColumns({"how": F.when(F.col("key").isNull(), "unresolved").otherwise("exact"), **blank}).select(out)
    if not create:
        return done.unionByName(led.withColumn("how", how).select(out))
    led = kept(led)
    fresh = led.where("club_id IS NULL AND _k = 1").select("key", "seq", "name")
    alike = similar_names(fresh, fresh, least)
    key_of = lambda x: fresh.select(F.col("name").alias(x), F.col("key").alias(f"_{x}"))
    pairs = alike.join(key_of("a"), "a").join(key_of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    group = grouped(pairs)
    fresh = fresh.join(group, fresh["key"] == group["node"], "left").select("key", "seq", F.coalesce("least", "key").alias("_group"))
    top = F.broadcast(clubs.agg(F.coalesce(F.max("club_id"), F.lit(0)).alias("_top")))  # one row
    ids = numbered(fresh.groupBy("_group").agg(F.min("seq").alias("seq")), "seq", "_n", ("_group",)).crossJoin(top).select("_group", (F.col("_top") + F.col("_n")).cast("bigint").alias("_new"))
    made = fresh.join(ids, "_group").select("key", "_new")
    rest = led.join(made, "key", "left").withColumns({"how": F.when(F.col("club_id").isNull(), "created").otherwise("fuzzy"), "club_id": F.coalesce("club_id", "_new")})
    return done.unionByName(rest.select(out))


def created_map(created: DataFrame, clubs: DataFrame, least: float | None = None) -> DataFrame:
    """(old, new): created ids whose suggestion, or else whose own name, has the key of a known club.

    ``created`` has created_club_id, club_name, suggestion and score. Rows with a score under ``least`` are left out; of several
    answers for an id the smallest counts, and no id is mapped to itself.
    """
    rows = created if least is None else created.where(F.coalesce(F.col("score") >= least, F.lit(True)))
    keys = club_keys(clubs)
    for c in ("suggestion", "club_name"):
        rows = _keyed(rows, c).join(keys.withColumnRenamed("club_id", f"_{c}"), "key", "left").drop("key")
    new = F.coalesce("_suggestion", "_club_name")
    return rows.select(F.col("created_club_id").alias("old"), new.alias("new")).where("new IS NOT NULL AND old <> new").groupBy("old").agg(F.min("new").alias("new"))


def rekeyed(staged: DataFrame, main: DataFrame, clubs: DataFrame, least: float = LEAST) -> DataFrame:
    """Staged matches with the main table's club ids, and ``home_how``, ``away_how``: the step that found them.

    A match of main with the same date, code and both sides' keys gives both ids ('fixture'); else each side goes by its
    country and key, by its key, by the best fuzzy match, or keeps its id. A step sees only what the steps before left.
    ``staged`` has match_date, league_code, country_id and for both sides a club id and a team name; ``main`` has names too.
    """
    sides = ("home", "away")
    fixture = ["match_date", "league_code", "_home_key", "_away_key"]
    def with_keys(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"_{x}_key": F.nullif(canonical_name(F.col(f"{x}_team_name")), F.lit("")) for x in sides})

    known = with_keys(main).where("_home_key IS NOT NULL AND _away_key IS NOT NULL").groupBy(*fixture).agg(F.min(F.struct("home_club_id", "away_club_id")).alias("_fixture"))
    rows = with_keys(staged).join(known, fixture, "left")
    by_key = club_keys(clubs)
    by_country = _keyed(clubs, "club_name").where("key IS NOT NULL").groupBy("country_id", "key").agg(F.min("club_id").alias("_own"))
    for x in sides:
        own = by_country.select("country_id", F.col("key").alias(f"_{x}_key"), F.col("_own").alias(f"_{x}_own"))
        any_ = by_key.select(F.col("key").alias(f"_{x}_key"), F.col("club_id").alias(f"_{x}_any"))
        rows = rows.join(own, ["country_id", f"_{x}_key"], "left").join(any_, f"_{x}_key", "left")
    rows = kept(rows)
    left = None
    for x in sides:
        part = rows.where(F.col("_fixture").isNull() & F.col(f"_{x}_own").isNull() & F.col(f"_{x}_any").isNull() & F.col(f"_{x}_key").isNotNull()).select(F.col(f"{x}_team_name").alias("name"), "country_id")
        left = part if left is None else left.unionByName(part)
    hits = kept(suggestions(left, clubs, least).select("name", "country_id", "club_id"))
    for x in sides:
        hit = hits.select(F.col("name").alias("_n"), F.col("country_id").alias("_c"), F.col("club_id").alias(f"_{x}_fuzzy"))
        rows = rows.join(hit, (F.col(f"{x}_team_name") == F.col("_n")) & F.col("country_id").eqNullSafe(F.col("_c")), "left").drop("_n", "_c")
        steps = [("fixture", F.col(f"_fixture.{x}_club_id")), ("country", F.col(f"_{x}_own")), ("key", F.col(f"_{x}_any")), ("fuzzy", F.when(F.col(f"_{x}_key").isNotNull(), F.col(f"_{x}_fuzzy")))]
        how = F.lit("kept")
        for name, found in reversed(steps):
            how = F.when(found.isNotNull(), name).otherwise(how)
        rows = rows.withColumn(f"{x}_how", how).withColumn(f"{x}_club_id", F.coalesce(*[c for _, c in steps], F.col(f"{x}_club_id")))
    return rows.select(*staged.columns, *[f"{x}_how" for x in sides])


def merged_staging(main: DataFrame, staged: DataFrame, clubs: DataFrame, keys: list[str], least: float = LEAST) -> DataFrame:
    """Main with the staged matches, re-keyed, merged into the calendar years they have: there a staged row wins by its keys."""
    ready = rekeyed(staged, main, clubs, least).select(*main.columns)
    newest = Window.partitionBy(*keys).orderBy(F.desc("result_id"))
    one = ready.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return merge_slice(main, one, F.year("match_date"), keys)
