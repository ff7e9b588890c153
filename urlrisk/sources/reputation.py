"""Reputation tables: read a store file, build one from feeds, describe its age."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.urls import url_fingerprints
from urlrisk.messages import REPUTATION_POLICY
from urlrisk.session import cut, shared_path
from urlrisk.sources.json_store import read_store, write_store

STALE_DAYS = 30
SECTIONS = ("url_fingerprints", "hosts", "roots")


@dataclass
class ReputationTables:
    """Three keyed tables (key, sources, url_count), the store's time, and the time of the lookup.

    ``now`` is an argument everywhere, so results can be repeated.
    """

    fingerprints: DataFrame
    hosts: DataFrame
    roots: DataFrame
    generated_at: Column
    now: Column
    load_error: str | None = None

    @cached_property
    def keyed(self) -> DataFrame:
        """All three tables as one (key, sources, url_count), bucketed and sorted by key.

        Keys begin with u:, h: or r:.  A join on the key finds the store's side in place
        and in order.
        """
        parts = [t.select(F.concat(F.lit(p), "key").alias("key"), "sources", "url_count")
                 for p, t in (("u:", self.fingerprints), ("h:", self.hosts), ("r:", self.roots))]
        spark, name = self.hosts.sparkSession, f"urlrisk_store_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(buckets, "key").write
         .bucketBy(buckets, "key").sortBy("key").option("path", shared_path(spark, "store", keep=True)).saveAsTable(name))
        return spark.table(name)

    @cached_property
    def counts(self) -> dict[str, int]:
        """Rows of each section."""
        return {name: table.count() for name, table in zip(SECTIONS, (self.fingerprints, self.hosts, self.roots), strict=True)}

    def about(self) -> dict[str, Column]:
        """What every evidence says of the store itself."""
        counts = self.counts if self.load_error is None else dict.fromkeys(SECTIONS, 0)
        return {"generated_at_utc": F.date_format(self.generated_at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"),
                "counts": F.struct(*[F.lit(counts[n]).cast("bigint").alias(n) for n in SECTIONS]),
                "load_error": F.lit(self.load_error).cast("string"), "policy": F.lit(REPUTATION_POLICY)}

    @property
    def age_days(self) -> Column:
        seconds = F.unix_timestamp(self.now.cast("timestamp")) - F.unix_timestamp(self.generated_at.cast("timestamp"))
        return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")

    @property
    def available(self) -> Column:
        """Whether lookups may use the store: it was readable and holds at least one host."""
        if self.load_error is not None:
            return F.lit(False)
        return F.lit(self.counts["hosts"] > 0)

    @property
    def stale(self) -> Column:
        return F.coalesce(self.age_days > STALE_DAYS, F.lit(False))


def clean_sources(sources: Column) -> Column:
    """Lower-case, trimmed, distinct, sorted source names."""
    names = F.transform(sources, lambda s: F.lower(F.trim(s)))
    return F.sort_array(F.array_distinct(F.filter(names, lambda s: s != "")))


def build_tables(feed: DataFrame, generated_at: Column, now: Column) -> ReputationTables:
    """Tables of a (url, source) feed.

    Rows are first reduced to distinct (fingerprint, source), which happens before
    the shuffle and takes the weight off a host that fills a third of the feed.
    """
    named = url_fingerprints(feed).filter(F.col("rep_host") != "").select(
        "fingerprint_hash", "rep_host", "rep_root", F.lower(F.trim("source")).alias("source"))
    distinct = cut(named.distinct(), "rep-feed")

    def keyed(key: str) -> DataFrame:
        # Two levels: per (key, fingerprint), then per key, so no distinct count
        # has to hold a hot key's fingerprints in one place.
        per_url = distinct.groupBy(key, "fingerprint_hash").agg(F.collect_set("source").alias("names"))
        sources = F.array_distinct(F.flatten(F.collect_set("names")))
        return per_url.groupBy(F.col(key).alias("key")).agg(
            F.sort_array(F.filter(sources, lambda s: s != "")).alias("sources"),
            F.count("*").alias("url_count"))

    per_url = distinct.groupBy(F.col("fingerprint_hash").alias("key")).agg(
        F.sort_array(F.filter(F.collect_set("source"), lambda s: s != "")).alias("sources"),
        F.lit(1).cast("bigint").alias("url_count"))
    return ReputationTables(cut(per_url, "rep-urls"), cut(keyed("rep_host"), "rep-hosts"),
                            cut(keyed("rep_root"), "rep-roots"), generated_at, now)


def _section(entries: DataFrame, name: str) -> DataFrame:
    """One keyed section; a record is an object, or a bare list of sources."""
    record = F.from_json("record", "struct<sources:array<string>,url_count:string>")
    bare = F.from_json("record", "array<string>")
    single = F.from_json("record", "struct<sources:string>")
    as_list = F.when(F.col("record").startswith("["), bare).otherwise(
        F.coalesce(record["sources"], F.when(single["sources"].isNotNull() & ~single["sources"].startswith("["),
                                             F.array(single["sources"]))))
    empty = F.array().cast("array<string>")
    return entries.where(F.col("section") == name).select(
        "key", clean_sources(F.coalesce(as_list, empty)).alias("sources"),
        F.greatest(F.lit(0), F.coalesce(record["url_count"].try_cast("bigint"), F.lit(0))).alias("url_count"))


def load_tables(spark: SparkSession, path: str, now: Column) -> ReputationTables:
    """Read a store of any size in splits; a missing or unreadable one gives empty tables and an error text."""
    entries, values, error = read_store(spark, path)
    generated = values.where("name = 'generated_at_utc'").select(F.max("value").alias("v")).first()[0]
    sections = [cut(_section(entries, name), name.replace("_", "-")) for name in SECTIONS]
    return ReputationTables(*sections, generated_at=F.lit(generated).cast("string").try_cast("timestamp"), now=now, load_error=error)


def write_tables(tables: ReputationTables, path: str, generated_at_utc: str) -> None:
    """Write the three sections as one store that ``load_tables`` reads."""
    entries = None
    for name, table in zip(SECTIONS, (tables.fingerprints, tables.hosts, tables.roots), strict=True):
        part = table.select(F.lit(name).alias("section"), "key", F.struct("sources", "url_count").alias("record"))
        entries = part if entries is None else entries.unionByName(part)
    write_store(entries, {"generated_at_utc": generated_at_utc}, path)


def metadata(tables: ReputationTables) -> DataFrame:
    """One row: sizes, age, staleness and whether lookups may use the store."""
    def counted(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")

    sizes = counted(tables.fingerprints, "url_fingerprints")
    for name in ("hosts", "roots"):
        sizes = sizes.unionByName(counted(getattr(tables, name), name))

    def size(name):
        return F.sum(F.when(F.col("part") == name, F.col("n")))

    return sizes.agg(*[size(n).alias(n) for n in SECTIONS]).select(
        *SECTIONS, tables.age_days.alias("age_days"), tables.stale.alias("stale"),
        (F.lit(tables.load_error is None) & (F.col("hosts") > 0)).alias("available"))
