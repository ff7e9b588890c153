"""The whole scoring job: URLs in, audited risk scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.operators.indicators import add_indicators, evidence_defaults
from urlrisk.operators.matching import host_profile, is_shortener, lure_matches
from urlrisk.operators.reputation import add_reputation, no_reputation
from urlrisk.operators.scoring import add_score
from urlrisk.operators.urls import prepared_urls
from urlrisk.session import cut
from urlrisk.sources.registry import Registry

KEYS = ["domain", "lure_text"]


def with_lure_text(urls: DataFrame) -> DataFrame:
    """Mark short links; only their path and query can name a brand."""
    c = F.col
    return urls.withColumn("shortener", is_shortener(c("domain"))).withColumn(
        "lure_text", F.when(c("shortener"), F.concat_ws(" ", "path", "query")).otherwise(""))


def site_facts(prepared: DataFrame, registry: Registry) -> DataFrame:
    """Match evidence per distinct (host, short-link text) that matches anything.

    Duplicates are removed before the shuffle, so a host that holds most rows
    costs one row here.  Most hosts match no rule and leave no row, which keeps
    the table that is joined back small.
    """
    keys = cut(prepared.select(*KEYS).distinct(), "site-keys")
    profile = host_profile(keys.select("domain").distinct(), registry)
    lures = lure_matches(keys.filter("lure_text <> ''").select("lure_text").distinct(), registry)
    facts = keys.join(profile, "domain", "left").join(lures, "lure_text", "left")
    return cut(facts.filter("is_official IS NOT NULL OR lure_hit IS NOT NULL"), "site-facts")


def url_evidence(urls: DataFrame, registry: Registry, reputation=None) -> DataFrame:
    """Prepared URLs with all match evidence.

    Full rows are joined once, on (host, short-link text).  The right side is a
    written table on a cluster: when its real size is under the broadcast limit
    nothing is shuffled, otherwise it is a sort-merge join whose right side is
    distinct, so adaptive execution can split a hot host.
    """
    prepared = with_lure_text(prepared_urls(urls))
    rows = evidence_defaults(prepared.join(site_facts(prepared, registry), KEYS, "left"))
    return add_reputation(rows, reputation, "rule_url") if reputation else no_reputation(rows)


def score_urls(urls: DataFrame, registry: Registry, reputation=None, modelled: bool = False) -> DataFrame:
    """Score a table with a ``url`` column; other columns pass through."""
    return add_score(add_indicators(url_evidence(urls, registry, reputation), modelled))
