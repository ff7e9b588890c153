"""Whole-table URL preparation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.functions import url as U
from urlrisk.functions.text import has_marker, is_ascii, skeleton


def normalize_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Add ``normalized_url``; empty input stays empty."""
    return urls.withColumn("normalized_url", U.normalize_url(F.col(column)))


def reject_empty_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    return normalize_urls(urls, column).filter(F.length("normalized_url") > 0)


def split_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Add scheme, netloc, path, query, raw_domain, domain, root, sld, tld of a normal-form URL."""
    c = F.col
    netloc = U.url_part(c(column), 2)
    return (
        urls.withColumns({
            "scheme": F.lower(U.url_part(c(column), 1)),
            "netloc": netloc,
            "path": U.url_path(c(column)),
            "query": U.url_part(c(column), 4),
        })
        .withColumns({
            "raw_domain": U.host_of(c("netloc")),
            # An unbalanced bracket is not a readable authority; the row is kept and marked.
            "parse_error": c("netloc").contains("[") != c("netloc").contains("]"),
        })
        .withColumn("domain", U.domain_of(c("raw_domain")))
        .withColumn("root", U.root_domain(c("domain")))
        .withColumns({"sld": U.sld(c("root")), "tld": U.tld(c("domain"))})
    )


def prepared_urls(urls: DataFrame) -> DataFrame:
    """Normal form, reported as ``url``, and the parts of its second normalization.

    The normaliser is not idempotent on junk input, and rules see the second pass.
    """
    once = reject_empty_urls(urls).withColumn("url", F.col("normalized_url"))
    twice = once.withColumn("rule_url", U.normalize_url(F.col("url"))).drop("normalized_url")
    return split_urls(twice, "rule_url")


def idna_hosts(urls: DataFrame, column: str = "raw_domain") -> DataFrame:
    """Non-ASCII hosts and their ASCII form, one row per host."""
    return (
        urls.filter(~is_ascii(F.col(column))).select(column).distinct()
        .withColumn("domain", U.domain_of(F.col(column)))
    )


def confusable_skeletons(urls: DataFrame, column: str) -> DataFrame:
    return urls.withColumn("skeleton", skeleton(F.col(column)))


def confusable_markers(urls: DataFrame, column: str) -> DataFrame:
    return urls.withColumn("has_marker", has_marker(F.col(column)))


def confusable_tld(tld: Column) -> Column:
    """A TLD that is not itself, but looks like, a common TLD."""
    folded = skeleton(tld)
    return (tld != folded) & folded.isin(C.COMMON_TLDS)


def is_ip_like(text: Column) -> Column:
    return text.rlike(C.IP_PATTERN)


def single_http_url_gate(urls: DataFrame, column: str = "url") -> DataFrame:
    """Mark rows that hold exactly one http(s) URL with a host and no space."""
    c = F.col(column)
    host = U.host_of(U.url_part(c, 2))
    return urls.withColumn(
        "accepted",
        (F.regexp_count(c, F.lit("(?i)https?://")) == 1)
        & ~c.rlike(r"(?U)\s") & c.rlike("(?i)^https?://") & (F.length(host) > 0),
    )


def url_fingerprints(urls: DataFrame, column: str = "url") -> DataFrame:
    """Add the reputation key: host + path + query, lower case, and its SHA-256."""
    c = F.col
    raw = F.trim(c(column))
    absolute = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    authority = r"^[^:/?#]+://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    netloc = F.substring_index(F.lower(F.regexp_extract(c("_abs"), authority, 1)), "@", -1)
    host = F.when(netloc.startswith("["), F.regexp_extract(netloc, r"^\[([^\]]*)\]?", 1)).otherwise(
        F.substring_index(netloc, ":", 1))
    path = F.regexp_replace(F.regexp_extract(c("_abs"), authority, 2), r";[^/]*$", "")
    query = F.regexp_extract(c("_abs"), authority, 3)
    return (
        urls.withColumn("_abs", absolute)
        .withColumn("rep_host", U.domain_of(host))
        .withColumn("fingerprint", F.lower(F.concat(
            c("rep_host"),
            F.when(path == "", F.lit("/")).otherwise(path),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))))
        .withColumn("fingerprint_hash", F.sha2("fingerprint", 256))
        .withColumn("rep_root", U.root_domain(c("rep_host")))
        .drop("_abs")
    )
