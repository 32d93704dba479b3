"""Temporal list join: every capture is judged by the URL-list entries that were active when it was fetched.

Dated entries (added, removed) become validity intervals. Captures look up their host, its parent domains and
their host with the first path segment; the as-of condition is an equi-join on key and time tile plus a range test.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE_DAYS = 32
MOST_TILES = 64  # tiles grow beyond this number, so that odd days far away do not multiply open intervals
ALLOW = "allow"


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def lookup_keys(url: Column) -> Column:
    """Keys of a URL from the narrowest: host with first path segment, host, parent domains of two labels or more."""
    host = url_host(url)
    path = F.regexp_extract(url, r"//[^/?#]*(/[^/?#]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.when(F.size(labels) > 2, F.sequence(F.lit(2), F.size(labels) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    keys = F.array_distinct(F.concat(F.when(path != "", F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>")), F.array(host), parents))
    return F.when(host.isNotNull(), keys).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(list, key, since, until)`` with since <= day < until (null: still listed) from ``(list, key, day, action)``.

    Entries of one list, key and day count once; a removal wins over an addition of the same day. A second addition
    or removal in a row changes nothing. Rows with a null in any of the four columns take no part.
    """
    daily = (
        entries.select("list", "key", "day", "action")
        .na.drop()
        .groupBy("list", "key", "day")
        .agg(F.min(F.col("action") == "add").alias("listed"))
    )
    order = Window.partitionBy("list", "key").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(False))).where(F.col("listed") != F.col("was"))
    spans = changes.withColumn("until", F.lead("day").over(order)).where("listed")
    return spans.select("list", "key", F.col("day").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture ``(page_id, url, day)`` with ``lists`` active for it and ``verdict``.

    verdict: ``allow`` if an allow-list entry is active, else ``block`` if any other is, else ``pass``. A null or
    hostless URL or a null day matches nothing and passes. Repeated captures stay; other columns are left out. Empty
    tables give no rows, or captures that pass. An interval is repeated for ``MOST_TILES`` + 1 tiles at most, whatever days occur.
    """
    rows = captures.select("page_id", "url", F.col("day").cast("int").alias("day")).withColumn("_row", F.monotonically_increasing_id())
    spans = validity_intervals(entries)
    days = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    low, high = (days["a"] or 0), (days["b"] or 0)
    tile = max(TILE_DAYS, -((low - high - 1) // MOST_TILES))
    tiles = (
        spans.where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
        .withColumn("_from", F.greatest(F.col("since"), F.lit(low)))
        .withColumn("_to", F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high)))
        .select("list", F.col("key").alias("_key"), "since", "until", F.explode(F.expr(f"sequence(_from div {tile}, _to div {tile})")).alias("_tile"))
    )
    asked = rows.select("*", F.explode_outer(lookup_keys(F.col("url"))).alias("_key"), F.expr(f"day div {tile}").alias("_tile"))
    active = (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    joined = asked.join(tiles, (asked["_key"] == tiles["_key"]) & (asked["_tile"] == tiles["_tile"]) & active, "left")
    found = joined.groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("day").alias("day"), F.array_sort(F.collect_set("list")).alias("_lists")
    )
    verdict = F.when(F.array_contains("_lists", ALLOW), F.lit("allow")).when(F.size("_lists") > 0, F.lit("block")).otherwise(F.lit("pass"))
    return found.select("page_id", "url", "day", F.array_join("_lists", ",").alias("lists"), verdict.alias("verdict"))
