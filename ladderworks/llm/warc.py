"""Not-modified revisits of web archives, resolved to the full responses that they stand for.

A revisit record with the server's "not modified" profile has no payload. It takes over that of the latest earlier full
response under the same canonical URL, if the validators agree (entity tag, else modification date), and updates that
response's headers with those that a 304 may change.

The as-of join keeps no URL in one task. Records are ranged by URL and time, so a URL with many records spreads over
neighbouring partitions; each partition finds the latest response among its own rows, and the few rows that have none
there take the last one of the partitions before it: one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderworks.llm.frames import kept

#: The profile of not-modified revisits in WARC 1.1.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers that describe the payload or the connection, which a 304 doesn't change.
PAYLOAD_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "trailer", "upgrade")
#: Query parameters that only track visitors.
TRACKING = "^(utm_[^=]*|fbclid|gclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, path without a closing slash, query parameters sorted without
    tracking ones, no scheme, no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that agree then, the last value in the order of the original names counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("k"), e.key.alias("o"), e.value.alias("v")))
    last = F.array_sort(entries)
    final = F.filter(last, lambda e, i: F.coalesce(F.get(last, i + 1).k != e.k, F.lit(True)))
    return F.map_from_entries(F.transform(final, lambda e: F.struct(e.k.alias("key"), e.v.alias("value"))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Not-modified revisits of ``records``, each with the response that it stands for.

    ``records`` has record_id, type ("response" or "revisit"), uri, date (timestamp), status (int), profile, headers (map
    of strings). Result: record_id, canonical_url, date, ``outcome``, ``refers_to`` (record_id of the response), ``headers``.

    outcome: "resolved"; "mismatch" (the latest earlier response has other validators), "unproven" (either side has no
    validator in common with the other), "orphan" (no earlier response). Only "resolved" has refers_to and merged headers.

    * A full response has the type "response" and a status from 200 to 299. Of responses at one time, that of the largest
      record_id is the latest. A response at the very time of the revisit isn't earlier.
    * Records without a URL, date or id can't be matched; such revisits are orphans. Repeated rows each have their own result.
    * Weak entity tags ("W/") agree with strong ones of the same value. Null headers are empty. Other columns are ignored.
    * An empty table gives an empty table.
    """
    h = _lower_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    rows = records.select("record_id", canonical_url(F.col("uri")).alias("url"), "date", h.alias("headers"), F.coalesce((F.col("type") == "response") & F.col("status").between(200, 299), F.lit(False)).alias("full"), ((F.col("type") == "revisit") & (F.col("profile") == NOT_MODIFIED)).alias("revisit"))
    rows = rows.where("full OR revisit")
    known = "url IS NOT NULL AND date IS NOT NULL AND record_id IS NOT NULL"
    # Revisits come before responses of the same time, so that only earlier ones are seen.
    ranged = kept(rows.where(known).repartitionByRange("url", "date", "full", "record_id").withColumn("part", F.spark_partition_id()))
    response = F.when(F.col("full"), F.struct("url", "record_id", "headers"))
    in_part = Window.partitionBy("part", "url").orderBy("date", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("own", F.last(response, ignorenulls=True).over(in_part)).where("revisit")
    order = F.struct("url", "date", "record_id")
    ends = ranged.groupBy("part").agg(F.max_by(response, F.when(F.col("full"), order)).alias("end"))
    # One row a partition: what its last response was; the latest of the partitions before each.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = seen.join(carried, "part", "left").withColumn("found", F.coalesce("own", F.when(F.col("carried.url") == F.col("url"), F.col("carried"))))
    found = found.select("record_id", "url", "date", "headers", "found").unionByName(rows.where(f"revisit AND NOT ({known})").select("record_id", "url", "date", "headers", F.lit(None).cast(found.schema["found"].dataType).alias("found")))

    tag = lambda m: F.regexp_replace(F.get(F.array(m["etag"]), F.lit(0)), "^W/", "")
    mine, theirs = F.col("headers"), F.col("found.headers")
    agrees = F.coalesce(tag(mine) == tag(theirs), mine["last-modified"] == theirs["last-modified"])
    outcome = F.when(F.col("found").isNull(), "orphan").when(agrees.isNull(), "unproven").when(agrees, "resolved").otherwise("mismatch")
    fresh = F.map_filter(mine, lambda k, _: ~k.isin(*PAYLOAD_HEADERS))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    resolved = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select("record_id", F.col("url").alias("canonical_url"), "date", "outcome", F.when(resolved, F.col("found.record_id")).alias("refers_to"), F.when(resolved, merged).alias("headers"))
