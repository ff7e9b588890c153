"""Reputation lookup: exact URL, then exact host, then registrable root as context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.messages import REPUTATION_POLICY
from urlrisk.operators.urls import url_fingerprints
from urlrisk.sources.reputation import SECTIONS, ReputationTables

c = F.col


def store_hits(rows: DataFrame, tables: ReputationTables) -> DataFrame:
    """(fingerprint_hash, hit): the best record of every distinct URL that has one; level 1 is the URL, 2 its host, 3 its root.

    The three keys of a URL are exploded once and meet the store in one join, on
    the key that the store is bucketed by.
    """
    asked = rows.filter(c("rep_host") != "").select("fingerprint_hash", "rep_host", "rep_root").distinct()
    keys = F.array(*[F.struct(F.lit(level).alias("level"), F.concat(F.lit(prefix), name).alias("key")) for level, prefix, name in (
        (1, "u:", "fingerprint_hash"), (2, "h:", "rep_host"), (3, "r:", "rep_root"))])
    met = asked.select("fingerprint_hash", F.inline(keys)).join(tables.keyed, "key")
    return met.groupBy("fingerprint_hash").agg(F.min_by(F.struct("level", "sources", "url_count"), "level").alias("hit"))


def add_reputation(urls: DataFrame, tables: ReputationTables, column: str = "url") -> DataFrame:
    """Add the ``reputation`` struct.

    The store meets distinct URLs, not rows.  What matched is usually small and is
    joined back; the optimizer broadcasts it only where it is.
    """
    stale = tables.stale
    # A row without a host matches nothing, and neither does a store without hosts.
    rows = url_fingerprints(urls, column)
    helpers = ("rep_host", "rep_root", "fingerprint", "fingerprint_hash")
    if tables.load_error is not None or not tables.counts["hosts"]:
        return no_reputation(rows, tables).drop(*helpers)
    rows = rows.join(store_hits(rows, tables), "fingerprint_hash", "left")
    level, sources = c("hit.level"), c("hit.sources")
    by_url, by_host, by_root = (F.coalesce(level == n, F.lit(False)) for n in (1, 2, 3))
    at_root = c("rep_host") == c("rep_root")
    strong = F.array_contains(sources, "urlhaus") | (F.size(sources) >= 2)
    host_class = F.when(~at_root, "dedicated_host").when(strong, "root_host_multi_source").otherwise(
        "root_host_single_source")
    host_score = F.when(~at_root, 98).when(strong, 90).otherwise(35)
    host_score = F.when(stale, F.least(host_score, F.when(at_root, 30).otherwise(75))).otherwise(host_score)
    none = F.array().cast("array<string>")
    reputation = F.struct(
        F.lit(True).alias("available"), stale.alias("stale"), tables.age_days.alias("age_days"),
        (by_url | by_host).alias("match"),
        F.when(by_url, "exact_url").when(by_host, "host").alias("match_type"),
        F.when(by_url, F.when(stale, 85).otherwise(100)).when(by_host, host_score).otherwise(0).alias("score"),
        F.when(by_url | by_host, sources).otherwise(none).alias("sources"),
        F.when(by_url | by_host, c("hit.url_count")).otherwise(0).alias("url_count"),
        F.when(by_url, "exact_url").when(by_host, host_class).when(by_root, "root_context_only")
        .alias("evidence_class"),
        by_root.alias("context_match"),
        F.when(by_root, sources).otherwise(none).alias("context_sources"),
        F.when(by_root, c("hit.url_count")).otherwise(0).alias("context_url_count"),
        c("rep_host").alias("normalized_host"), c("rep_root").alias("root_domain"),
        *[value.alias(name) for name, value in tables.about().items()])
    return rows.withColumn("reputation", reputation).drop("hit", *helpers)


def no_reputation(rows: DataFrame, tables: ReputationTables | None = None) -> DataFrame:
    """The evidence of an absent or empty store."""
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    if tables is not None:
        about, age, stale = tables.about(), tables.age_days, tables.stale
    else:
        zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in SECTIONS])
        about = {"generated_at_utc": null, "counts": zero, "load_error": null, "policy": F.lit(REPUTATION_POLICY)}
        age, stale = F.lit(None).cast("int"), F.lit(False)
    return rows.withColumn("reputation", F.struct(
        F.lit(False).alias("available"), stale.alias("stale"), age.alias("age_days"),
        F.lit(False).alias("match"), null.alias("match_type"), F.lit(0).alias("score"), none.alias("sources"),
        F.lit(0).cast("bigint").alias("url_count"), null.alias("evidence_class"),
        F.lit(False).alias("context_match"), none.alias("context_sources"),
        F.lit(0).cast("bigint").alias("context_url_count"),
        null.alias("normalized_host"), null.alias("root_domain"), *[value.alias(name) for name, value in about.items()]))
