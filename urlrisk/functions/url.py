"""Column expressions that take a URL or host apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk.functions.text import idna, nfkc

# A URL of this shape is already in normal form; it covers nearly all real input.
_CLEAN = r"^(?i:https?)://(?!(?i:https?)://)[0-9A-Za-z][!-+\-.-:<-~]*$"
_URL = r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def normalize_url(raw: Column) -> Column:
    """Repair copy/paste damage: spaces, trailing marks, stacked or broken schemes."""
    text = nfkc(F.coalesce(raw, F.lit("")))
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")
    text = F.regexp_replace(text, r"[,;，；、。]+$", "")
    text = F.regexp_replace(text, r"(?i)^[.,;，；。]+(?=https?[:?]//)", "")
    text = F.regexp_replace(text, r"(?i)^(https?)\?//", "$1://")
    text = F.regexp_replace(text, r"(?i)^(https?):/+", "$1://")
    text = F.regexp_replace(text, r"(?i)^(?:https?://[.,;，；。]*)+(?=https?://)", "")
    fixed = F.when((text == "") | text.rlike(r"(?i)^https?://"), text).otherwise(
        F.concat(F.lit("https://"), text)
    )
    return F.when(raw.rlike(_CLEAN), raw).otherwise(fixed)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.btrim(F.lower(F.trim(host)), F.lit(".")), r"^www\.", "")


def host_of(netloc: Column) -> Column:
    """Host of an authority: after the last '@', before the first ':'."""
    host = F.substring_index(F.substring_index(F.lower(netloc), "@", -1), ":", 1)
    return strip_www(host)


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def url_path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(url_part(url, 3), r";[^/]*$", "")


def domain_of(raw_domain: Column) -> Column:
    return strip_www(idna(raw_domain))


def root_domain(domain: Column, suffixes=C.TWO_LEVEL_SUFFIXES) -> Column:
    """Registrable domain: last two labels, or three under a two-label suffix."""
    last_two = F.substring_index(domain, ".", -2)
    return F.when(last_two.isin(list(suffixes)), F.substring_index(domain, ".", -3)).otherwise(last_two)


def sld(root: Column) -> Column:
    """First label of a registrable domain."""
    return F.substring_index(root, ".", 1)


def tld(domain: Column) -> Column:
    return F.when(domain.contains("."), F.substring_index(domain, ".", -1)).otherwise(F.lit(""))


def labels(domain: Column) -> Column:
    return F.split(domain, r"\.")


def suffixes(domain: Column) -> Column:
    """Every dot-suffix of a host, from the host itself to its last label."""
    parts = labels(domain)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."),
    )
