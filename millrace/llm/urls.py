"""URL filters with dates: list entries become intervals of validity, and each capture meets those of its own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(url: Column) -> Column:
    """Host (lower case, without ``www.``, user and port) and path, without scheme, query, fragment and closing slashes."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "/+$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/]*)", 1), "^.*@", ""), ":[0-9]*$", ""))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_extract(bare, "^[^/]*(/.*)?$", 1))


def keys_of(page: Column) -> Column:
    """What a list may name a normalised URL by: the URL, its host with the first part of the path, its host, and each
    parent domain of two labels or more; distinct."""
    host = F.regexp_extract(page, "^([^/]*)", 1)
    first = F.regexp_extract(page, "^([^/]*/[^/]+)", 1)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(labels) - 1), lambda k: k <= F.size(labels) - 2),
        lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."),
    )
    return F.array_distinct(F.filter(F.concat(F.array(page, first, host), parents), lambda k: k != ""))


def intervals(entries: DataFrame, wanted: DataFrame, slice_seconds: int) -> DataFrame:
    """When each key is listed: ``key``, ``slice``, ``begins``, ``ends``, ``since``, cut at slices of time.

    ``entries``: ``key``, ``ts``, ``listed``; of entries of one moment, listing wins. ``wanted``: the (key, slice) that
    captures fall into. Only one state per key and slice is carried from slice to slice, so a key with many entries
    is split by time.
    """
    clean = entries.where("key is not null and ts is not null and listed is not null").groupBy("key", "ts").agg(F.bool_or("listed").alias("listed"))
    clean = clean.withColumn("slice", F.floor(F.unix_seconds("ts") / slice_seconds))
    own = Window.partitionBy("key", "slice").orderBy("ts")
    changes = clean.select("key", "slice", F.col("ts").alias("begins"), F.lead("ts").over(own).alias("ends"), "listed")
    last = clean.groupBy("key", "slice").agg(F.max_by(F.struct("listed", "ts"), "ts").alias("state"), F.min("ts").alias("first"))
    every = last.unionByName(wanted.select("key", "slice").distinct(), allowMissingColumns=True)
    every = every.groupBy("key", "slice").agg(F.max("state").alias("state"), F.min("first").alias("first"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("was", F.last("state", ignorenulls=True).over(earlier)).where("was.listed")
    carried = carried.select("key", "slice", F.lit(None).cast("timestamp").alias("begins"), F.col("first").alias("ends"), F.col("was.ts").alias("since"))
    within = changes.where("listed").select("key", "slice", "begins", "ends", F.col("begins").alias("since"))
    return carried.unionByName(within)


def filtered(
    captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, time_col: str, slice_seconds: int = 3600
) -> DataFrame:
    """Whether each capture was on the list when it was fetched.

    ``entries``: ``url`` (a URL, a host with the first part of a path, a host or a domain), ``ts`` and ``listed``
    (true: added, false: taken off). An entry holds from its moment on, until the next for the same key. Returns id,
    url, time, ``blocked``, ``rule`` (the longest key listed then; null if none) and ``since`` (when that key was
    last added). Captures without URL or time, and entries without key, time or action, match nothing. A capture
    that repeats is judged each time.
    """
    rows = captures.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(time_col).cast("timestamp").alias("t"))
    keyed = rows.where("t is not null").select("row", "t", F.explode(keys_of(normalised(F.col("u")))).alias("key"))
    keyed = keyed.withColumn("slice", F.floor(F.unix_seconds("t") / slice_seconds))
    named = entries.select(normalised(F.col("url")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "listed").where("key <> ''")
    listed = named.select("key").distinct()
    keyed = keyed.join(listed, "key", "left_semi")
    spans = intervals(named, keyed, slice_seconds)
    hits = (
        keyed.join(spans, ["key", "slice"])
        .where("(begins is null or begins <= t) and (ends is null or t < ends)")
        .groupBy("row")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "since")).alias("hit"))
    )
    return rows.join(hits, "row", "left").select(
        F.col("i").alias(id_col), F.col("u").alias(url_col), F.col("t").alias(time_col),
        F.col("hit").isNotNull().alias("blocked"), F.col("hit.key").alias("rule"), F.col("hit.since").alias("since"),
    )
