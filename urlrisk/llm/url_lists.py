"""Dated URL lists joined with captures as of their fetch time.

List entries (list, key, time, add or remove) become validity intervals.  A key
is a host; it covers the host and all hosts below it.  Every capture is held
against the intervals that hold at its fetch time: captures and the changes of
their keys are put in order of time and the latest change of each list is
carried on.  That runs by key and day, and within them in SALTS parts, so that a
host with a third of all captures is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlrisk.functions.url import host_of, suffixes, url_part
from urlrisk.session import materialize

#: Parts that the captures of one key and day are dealt out to.
SALTS = 16
#: Lists that are told apart at once; each is one column of the ordered pass.
LISTS_AT_ONCE = 32


def host(url: Column) -> Column:
    """The host of a URL in lower case, without port, user and www; null where there is none."""
    found = host_of(url_part(F.trim(F.lower(url)), 2))
    return F.when(F.length(found) > 0, found)


def intervals(entries: DataFrame, list_: str = "list", key: str = "key", at: str = "at", adds: str = "adds") -> DataFrame:
    """(list, key, valid_from, valid_to): when an entry held; valid_to is null while it still does.

    An addition holds from its time until the next entry for the same list and key
    (exclusive).  At equal times additions win and repeated entries are one; a
    removal of what is not there changes nothing.  Neighbouring intervals are
    joined into one.  Entries with a null list, key, time or action take no part;
    keys are compared in lower case.
    """
    rows = entries.select(F.col(list_).alias("list"), F.lower(F.trim(F.col(key))).alias("key"), F.col(at).alias("at"),
                          F.col(adds).alias("adds")).where("list IS NOT NULL AND key <> '' AND at IS NOT NULL AND adds IS NOT NULL")
    changes = rows.groupBy("list", "key", "at").agg(F.max("adds").alias("adds"))
    order = W.partitionBy("list", "key").orderBy("at")
    changes = changes.withColumn("before", F.coalesce(F.lag("adds").over(order), F.lit(False))).where("adds <> before")
    return (changes.withColumn("valid_to", F.lead("at").over(order)).where("adds")
            .select("list", "key", F.col("at").alias("valid_from"), "valid_to"))


def hits(captures: DataFrame, entries: DataFrame, key: str = "capture_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(key, fetched_at, host, hits array<struct<list, key>>) of every capture, hits in order and empty where none holds.

    A capture is hit by an interval of its host or of a domain above it that holds
    at its fetch time, the start included and the end not.  A null or empty URL, a
    URL without a host and a null time have no hits.  Rows that repeat a key stay
    rows, each with its own hits; an empty table gives an empty table, and without
    entries nothing is hit.  Other columns are not read.
    """
    spark = captures.sparkSession
    spans = materialize(intervals(entries), "intervals")
    named = captures.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
                            F.col(at).cast("timestamp").alias("at"), host(F.col(url)).alias("host"))
    named = materialize(named, "captures")
    # Each host is read into its domains once; of these only listed ones go on.
    hosts = named.where("host IS NOT NULL").select("host").distinct()
    names = hosts.select("host", F.explode(F.array_distinct(F.array_append(suffixes(F.col("host")), F.col("host")))).alias("key"))
    listed = materialize(names.join(spans.select("key").distinct(), "key", "left_semi"), "listed")
    by_host = listed.groupBy("host").agg(F.collect_set("key").alias("keys"))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    asked = (named.where("at IS NOT NULL").join(by_host, "host")
             .select("row", "at", F.to_date("at").alias("day"), F.explode("keys").alias("key"), salt.alias("salt")))
    asked = materialize(asked, "asked")
    # Days that some capture asks for, with what holds at their beginning and what changes in them.
    days = asked.groupBy("key", "day").agg(F.max("at").alias("last"))
    start = F.col("day").cast("timestamp")
    next_day = F.date_add("day", 1).cast("timestamp")
    pieces = (spans.join(days, "key").where((F.col("valid_from") <= F.col("last"))
                                            & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))
              .select("list", "key", "day", F.greatest("valid_from", start).alias("begin"),
                      F.when(F.col("valid_to") < next_day, F.col("valid_to")).alias("end")))
    changes = materialize(pieces.select("list", "key", "day", F.explode(F.array(
        F.struct(F.col("begin").alias("at"), F.lit(True).alias("on")), F.struct(F.col("end").alias("at"), F.lit(False).alias("on"))
    )).alias("c")).where("c.at IS NOT NULL").select("list", "key", "day", "c.at", "c.on"), "changes")
    lists = [r["list"] for r in spans.select("list").distinct().orderBy("list").toLocalIterator()]

    found = None
    for first in range(0, len(lists), LISTS_AT_ONCE):
        group = lists[first:first + LISTS_AT_ONCE]
        dealt = (changes.where(F.col("list").isin(group)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                 .select(F.lit(None).cast("long").alias("row"), "at", "day", "key", "salt", "list", "on"))
        both = dealt.unionByName(asked, allowMissingColumns=True)
        # Changes come before captures of the same moment.
        order = (W.partitionBy("key", "day", "salt").orderBy("at", F.col("row").isNotNull())
                 .rowsBetween(W.unboundedPreceding, W.currentRow))
        active = [F.last(F.when(F.col("list") == name, F.col("on")), True).over(order).alias(f"l{i}") for i, name in enumerate(group)]
        states = both.select("row", "key", *active).where("row IS NOT NULL")
        held = states.select("row", F.explode(F.array_compact(F.array(*(
            F.when(F.col(f"l{i}"), F.struct(F.lit(name).alias("list"), F.col("key").alias("key")))
            for i, name in enumerate(group))))).alias("hit"))
        found = held if found is None else found.unionByName(held)
    none = F.array().cast("array<struct<list:string,key:string>>")
    columns = [F.col("id").alias(key), F.col("at").alias("fetched_at"), "host"]
    if found is None:
        return named.select(*columns, none.alias("hits"))
    per_row = found.groupBy("row").agg(F.sort_array(F.collect_set("hit")).alias("hits"))
    return named.join(per_row, "row", "left").select(*columns, F.coalesce("hits", none).alias("hits"))


def allowed(captures: DataFrame, entries: DataFrame, key: str = "capture_id", url: str = "url", at: str = "fetched_at") -> DataFrame:
    """(key, fetched_at, host) of the captures that no list held at their fetch time; cases as in ``hits``."""
    return hits(captures, entries, key, url, at).where(F.size("hits") == 0).drop("hits")
