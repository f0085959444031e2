"""N-gram Jaccard join by vertical partitioning.

1. Documents of the same text (by its print, a 128-bit hash) are one node. A count-min sketch of the nodes' shingles gives every shingle a level; level
   and hash are the global order, rare ones first. A shingle of level 1 stands in one node for certain.
2. Two sets of that similarity share a shingle among the first ones of either set, so nodes whose first shingles stand
   nowhere else have no links. The others keep their shared shingles in the global order. A pair is a candidate where
   enough of both sets is left from a shared shingle on.
3. The order is cut at quantiles into fragments. Overlaps of candidate pairs are counted in every fragment by itself
   and summed per pair.
4. Candidates don't multiply within a group: the nodes of a posting list first meet one hub, then hubs that differ by
   shingle. What is connected needs no more pairs; at last every pair that shares a first shingle, is still in two
   components and has room for the overlap that it needs is compared. No link between components can be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderworks.llm.components import components
from ladderworks.llm.frames import kept
from ladderworks.llm.sketches import ANSWER, PARTIAL, Estimates, Layout, ddl, layout, merged_slice, partial_sketch
from ladderworks.llm.words import SPACED, mix, pieces, sequence_hashes, split_words, window_starts

FRAGMENTS = 4
_SETS = pa.schema([("print", pa.binary()), ("first", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int64()))])


def shingle_sets(texts: list[bytes | None], words_each: int) -> list[np.ndarray]:
    """Distinct hashed shingles of every text, sorted; a shorter text is one shingle, a text without words none."""
    out = []
    for lo, hi in pieces(texts):
        words = split_words(texts[lo:hi], SPACED, lower=True)
        hashes, whole = sequence_hashes(words, words_each), window_starts(words, words_each)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= words_each:
                out.append(np.unique(hashes[a:b][whole[a:b]]))
            elif b > a:
                value = np.uint64(b - a)
                for h in words.hashes[a:b]:
                    value = mix(np.array([value ^ h]))[0]
                out.append(np.array([value], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _nodes(left: pa.Table, right: pa.Table) -> tuple[list[tuple[bytes, int | None, int]], list[bytes | None]]:
    """(print, smallest id or None, node) of the block's nodes, and their texts.

    A node is numbered by its smallest id. Where there is none, or another text has that id too, it has a number below
    -2**62 from its print.
    """
    prints = {bytes(p) for s, p in zip(right.column("_slice").to_pylist(), right.column("cells").to_pylist(), strict=True) if s < 0}
    own: dict[bytes, tuple[bool, int, int]] = {}
    for at, (i, p) in enumerate(zip(left.column("id").to_pylist(), left.column("_print").to_pylist(), strict=True)):
        if p in prints:
            row = (i is None, i or 0, at)
            own[p] = min(own.get(p, row), row)
    nodes, rows, taken = [], [], set()
    for p, (none, i, at) in sorted(own.items()):
        free = not none and i not in taken
        taken.add(i)
        nodes.append((p, None if none else i, i if free else -(1 << 62) - (int.from_bytes(p[:8], "big") >> 2)))
        rows.append(at)
    return nodes, left.column("_text").cast(pa.binary()).take(pa.array(rows, pa.int64())).to_pylist()


def _sketched(block: int, left: pa.Table, right: pa.Table, sizes: Layout, words_each: int) -> pa.Table:
    sets = shingle_sets(_nodes(left, right)[1], words_each)
    return partial_sketch(block, np.concatenate([np.empty(0, np.uint64), *sets]), sizes)


def _first(n: int, percent: int) -> int:
    """How many shingles of a set, in the global order, must hold one that a similar set shares."""
    return n - -(-percent * n // 100) + 1


def _screened(left: pa.Table, right: pa.Table, sizes: Layout, words_each: int, percent: int) -> pa.Table:
    """Every node's set size, and its shared shingles in the global order where it may have links."""
    nodes, texts = _nodes(left, right)
    sets = shingle_sets(texts, words_each)
    level = Estimates.of(right.filter(pa.compute.greater_equal(right.column("_slice"), 0)), sizes).level(np.concatenate([np.empty(0, np.uint64), *sets]))
    at, shared = 0, []
    for s in sets:
        own = level[at : at + len(s)]
        at += len(s)
        many = own > 1
        if len(s) and len(s) - many.sum() < _first(len(s), percent):
            shared.append(np.sort((np.minimum(own[many], 127).astype(np.uint64) << np.uint64(56)) | (s[many] >> np.uint64(8))).astype(np.int64))
        else:
            shared.append(np.empty(0, np.int64))
    columns = [list(c) for c in zip(*nodes, strict=True)] if nodes else [[]] * 3
    return pa.table([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(shared, pa.list_(pa.int64()))], schema=_SETS)


def _can_link(percent: int) -> Column:
    """Whether enough of both sets is left from the shared shingle on (places pa and pb in the global order) for the overlap
    that sets of these sizes need. Of a linking pair, the first shared shingle always passes."""
    need = F.floor((percent * (F.col("na") + F.col("nb")) + 99 + percent) / F.lit(100 + percent))
    return (F.col("pa") <= F.col("na") - need + 1) & (F.col("pb") <= F.col("nb") - need + 1)


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v, nu, nv), those that are similar: partial overlaps by fragment, summed."""
    wanted = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    one = segments.select(F.col("id").alias("u"), "fragment", F.col("segment").alias("_u"))
    two = segments.select(F.col("id").alias("v"), "fragment", F.col("segment").alias("_v"))
    partial = wanted.join(one, ["u", "fragment"]).join(two, ["v", "fragment"]).select("u", "v", "nu", "nv", F.size(F.array_intersect("_u", "_v")).alias("part"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("part").alias("overlap"))
    return total.where(100 * F.col("overlap") >= percent * (F.col("nu") + F.col("nv") - F.col("overlap"))).select("u", "v")


def _paired(left: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u < v) of rows that have both nodes, sizes and places as a, na, pa, b, nb, pb."""
    swap = F.col("a") > F.col("b")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rows = left.where((F.col("a") != F.col("b")) & _can_link(percent))
    return rows.select(either("a", "b").alias("u"), either("b", "a").alias("v"), either("na", "nb").alias("nu"), either("nb", "na").alias("nv")).distinct()


def _across(postings: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of shingles that still hold several components, with the largest of these; and those outside it."""
    member = found.select(F.col("node").alias("id"), "component")
    held = postings.join(member, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = held.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.count("*").alias("m"), F.max_by("component", F.struct("k", "component")).alias("major")).where("m > 1").drop("m")
    held = kept(held.join(several, "shingle"))
    return held, held.where("component <> major")


def _all_links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that connect what the links between nodes connect."""
    sets = sets.where(F.size("shared") > 0)
    cuts = sets.select(F.explode("shared").alias("x")).agg(F.percentile_approx("x", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 1000)).first()[0] or [0] * (FRAGMENTS - 1)
    marks = [-1, *cuts, (1 << 63) - 1]

    def cut(k: int) -> Column:
        return F.struct(F.lit(k).alias("fragment"), F.filter("shared", lambda x: (x > marks[k]) & (x <= marks[k + 1])).alias("segment"))

    segments = sets.select("id", F.inline(F.array(*map(cut, range(FRAGMENTS))))).where(F.size("segment") > 0)
    n, unique = F.col("n"), F.col("n") - F.size("shared")
    first = F.greatest(n - F.ceil(percent * n / 100) + 1 - unique, F.lit(0)).cast("int")
    postings = sets.select("id", "n", unique.alias("unique"), F.posexplode(F.slice("shared", F.lit(1), first)).alias("place", "shingle"))
    postings = kept(postings.withColumn("place", F.col("place") + F.col("unique") + 1))

    def met(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        return rows.select("shingle", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa")).join(hubs, "shingle")

    member = F.struct(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    hub = lambda order: F.min_by(member, order)
    # The first hub is the node with the fewest shingles of its own: the one that copies were made from, if it is there.
    hubs = postings.groupBy("shingle").agg(hub(F.struct("unique", "id")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("shingle", "hub.*")
    links = kept(_links(_paired(met(postings, hubs), percent), segments, percent))
    held, minor = _across(postings, components(links))
    order = F.xxhash64("shingle", "id")
    some = [rows.groupBy("shingle").agg(hub(order).alias("hub")).select("shingle", "hub.*") for rows in (held.where("component = major"), minor)]
    links = links.unionByName(kept(_links(_paired(met(minor, some[0].unionByName(some[1])), percent), segments, percent)))
    held, minor = _across(postings, components(links))
    # Of two sets, the smaller one (of equals, of the smaller id) must have the shingle among so few of its first ones.
    room = F.col("place") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    left = minor.select("shingle", "major", "component", "n", "place", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    right = held.select("shingle", "n", "place", F.col("component").alias("other"), member.alias("m"))
    apart = (F.col("component") != F.col("other")) & ((F.col("other") == F.col("major")) | (F.col("a") < F.col("b")))
    smaller = F.struct("nb", "b") < F.struct("na", "a")
    rest = None
    for mine, theirs, test in ((left, right.where(room), smaller), (left.where(room), right, ~smaller)):
        pairs = mine.drop("n", "place").join(theirs.select("shingle", "other", "m.*"), "shingle").where(apart & test)
        rest = pairs if rest is None else rest.unionByName(pairs)
    return links.unionByName(_links(_paired(rest, percent), segments, percent))


def _print_of(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.unhex(F.md5(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 75) -> DataFrame:
    """Per different text (but for the case of A-Z): ``_print``, ``n`` (shingles), ``first`` (its smallest id), ``node``,
    ``component`` (a number of the class of linked texts) and ``least`` (the smallest id of the class)."""
    sizes = layout(docs, text_col)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(sizes.blocks)).cast("int")
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("_text"), _print_of(text).alias("_print"))
    nodes = kept(own.groupBy("_print").agg(F.min("id").alias("node")))
    # Rows without an id are one for each text before they are dealt out, whatever their number.
    nameless = own.where("id IS NULL").groupBy("_print").agg(F.min("_text").alias("_text")).select(F.lit(None).cast("long").alias("id"), "_text", "_print")
    deal = lambda i: block(F.coalesce(i, F.xxhash64("_print")))
    blocked = own.where("id IS NOT NULL").unionByName(nameless).withColumn("_block", deal(F.col("id"))).repartition("_block")
    marks = nodes.select(deal(F.col("node")).alias("_block"), F.lit(-1).alias("_slice"), F.col("_print").alias("cells"), F.lit(b"").alias("levels"))
    partial = blocked.groupBy("_block").cogroup(marks.groupBy("_block")).applyInArrow(lambda key, left, right: _sketched(key[0].as_py(), left, right, sizes, words_each), ddl(PARTIAL))
    answers = partial.groupBy("_slice").applyInArrow(lambda key, table: merged_slice(key, table, sizes, True), ddl(ANSWER))
    sets = blocked.groupBy("_block").cogroup(answers.unionByName(marks).groupBy("_block")).applyInArrow(lambda left, right: _screened(left, right, sizes, words_each, percent), "print binary, first bigint, id bigint, n bigint, shared array<bigint>")
    sets = kept(sets)
    linked = components(_all_links(sets.select("id", "n", "shared"), percent)).join(sets.select(F.col("id").alias("node"), "first"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    found = linked.join(least, "component").select(F.col("node").alias("id"), "component", "least")
    known = sets.select("print", "first", "id", "n").join(found, "id", "left")
    return known.select(F.col("print").alias("_print"), "n", "first", F.col("id").alias("node"), F.coalesce("component", "id").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 75) -> DataFrame:
    """Per document: its id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two documents link when their sets of shingles of ``words_each`` words (A-Z as a-z) overlap by ``percent`` of the union.

    * A text of fewer words is one shingle; a null or empty text has none and links with nothing.
    * Documents of the same text (but for the case of A-Z) link if it has words; repeated rows each get a row.
    * Ids are integers above -2**62. Rows without an id are documents as others are: their component is the smallest id
      that they reach, null if there is none. Several texts under one id are several documents.
    * An empty table gives an empty table; other columns are ignored.
    """
    text = F.col(f"`{text_col}`").cast("string")
    prints = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _print_of(text).alias("_print"))
    joined = prints.join(classes(docs, id_col, text_col, words_each, percent).select("_print", "n", "least"), "_print", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select(F.col("id").alias(id_col), n.alias("n_shingles"), F.when(n > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, percent: int = 75) -> DataFrame:
    """The documents with one row of each class of linked texts: that of the smallest id (rows without an id come last), of
    several texts under it the one with the smallest print.

    * Texts without words, null ones included, are linked with nothing and all stay.
    * Rows that agree in id and text (but for the case of A-Z) are one document; one of them stays.
    * An empty table gives an empty table. All columns stay; their names may be any.
    """
    best = classes(docs, id_col, text_col, words_each, percent).where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "_print")).alias("r"))
    name = lambda i, p: F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("-")).cast("binary"), F.lit(b" "), p))
    chosen = best.select(name(F.col("r.first"), F.col("r._print")).alias("_name"))
    text = F.col(f"`{text_col}`").cast("string")
    wordless = ~F.coalesce(F.rlike(text, F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = docs.where(~wordless).select(name(F.col(f"`{id_col}`").cast("long"), _print_of(text)).alias("_name"), row).dropDuplicates(["_name"])
    return own.join(chosen, "_name", "left_semi").select("_row.*").unionByName(docs.where(wordless))
