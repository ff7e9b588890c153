"""Views of the given tables in the shapes the operators work on.

Each view is one SELECT that both Spark and the checking engine understand, so
the two sides read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-02-01 00:00:00"
ORDERS_NOW = "2001-08-01 00:00:00"

# First host label of a page without its service prefix.
_WORD = "regexp_extract(url, '^https?://(?:www[.]|m[.]|blog[.])?([^./?#]+)', 1)"

_PREFIXES = [
    "'https://www.google.com'", "'https://mail.google.com'", "'https://www.goog1e.com'",
    f"concat('https://paypa1-', {_WORD}, '.com')", "'http://192.168.1.10'",
    "'http://paypal.com@evil-site.ru'", "'https://goo.su/i.whatAapp'", "'https://d0cs.google.com'",
    "'https://mail.yahoo.com'", "'https://docs.render.com'", "'https://xn--googl-3ve.com'",
    "'https://touchngo-wallet-update.corn'", f"concat('https://', {_WORD}, '.github.io')",
    f"concat('https://secure-update-', {_WORD}, '-login.xyz')", f"concat('https://a.b.c.', {_WORD}, '.example.com')",
    "'https://https://example.net'", "'.https://example.org'", "'https://amazom.com'",
    "'https://www.maybank2u.com.my'", f"concat('https://', {_WORD}, '.example.com:8443')",
]
_PREFIX = "CASE page_id % 20 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PREFIXES)) + " END"

CORPUS = "SELECT page_id AS url_id, url FROM {pages}"
ADVERSARIAL = (
    "SELECT page_id AS url_id, page_id % 20 AS kind, "
    f"regexp_replace(url, '^https?://[^/?#]*', {_PREFIX}) AS url FROM {{pages}}"
)
DETECTIONS = """
SELECT concat('detection:', userId, ':', iso, ':', CAST(event_id AS {string})) AS id, event_id, event_type, value,
       url, riskScore, 100 - riskScore AS safetyScore, riskScore >= 45 AS isPhishing,
       event_type = 'error' AND riskScore >= 80 AS critical_phishing, userId,
       CASE WHEN userId = 'anonymous' THEN 'anonymous' ELSE concat('user', userId, '@example.com') END AS userEmail,
       timestamp
FROM (SELECT e.event_id, e.event_type, e.value,
             CASE WHEN e.event_type = 'purchase' AND e.value > 150 THEN 'http://[broken' ELSE p.url END AS url,
             CASE WHEN e.event_type = 'view' AND e.value > 100 THEN NULL
                  ELSE CAST(least(100, floor(e.value)) AS INT) END AS riskScore,
             CASE WHEN e.user_id % 10 = 0 THEN 'anonymous' ELSE CAST(e.user_id AS {string}) END AS userId,
             {iso} AS iso, CAST(e.ts AS TIMESTAMP) AS timestamp
      FROM (SELECT ev.*, ev.event_id % n.pages AS page_id
            FROM {events} ev CROSS JOIN (SELECT count(*) AS pages FROM {pages}) AS n) AS e
      JOIN {pages} p ON p.page_id = e.page_id) AS d
"""
DETECTIONS_ORDERS = """
SELECT concat('detection:', CAST(o_custkey AS {string}), ':', CAST(o_orderkey AS {string})) AS id,
       CAST(o_orderdate AS TIMESTAMP) AS timestamp, CAST(floor(o_totalprice) AS BIGINT) % 101 AS riskScore,
       CAST(floor(o_totalprice) AS BIGINT) % 101 >= 45 AS isPhishing, false AS critical_phishing,
       CAST(o_custkey AS {string}) AS userId
FROM {orders}
"""
PREDICTIONS = """
SELECT l.doc_id, l.toxic AS label, 1 - l.quality AS prediction, CAST(d.n_chars AS DOUBLE) AS score
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""
# Pages with a query string reported by feeds; the page language names the feed.
FEED = """
SELECT url, CASE WHEN url LIKE '%/en/%' THEN 'PhishTank ' WHEN url LIKE '%/fr/%' THEN 'openphish'
                 ELSE 'urlhaus' END AS source
FROM {pages} WHERE url LIKE '%?%'
UNION ALL
SELECT url, 'openphish' AS source FROM {pages} WHERE url LIKE '%page=2%'
"""
LABELLED = (
    "SELECT url, CASE WHEN kind IN (0, 1, 12, 14, 15, 16, 18, 19) THEN 0 ELSE 1 END AS label, "
    f"'overlay' AS source, 1.0 AS sample_weight FROM ({ADVERSARIAL}) AS a"
)
# A second source that repeats part of the first with other weights.
RELABELLED = (
    "SELECT url, 1 AS label, 'reported' AS source, 20.0 AS sample_weight "
    f"FROM ({ADVERSARIAL}) AS a WHERE url LIKE '%?%'"
)
# Registry entries named after the hosts of the pages.
REGISTRY_ENTRIES = f"""
SELECT brand, brand_ord, domain FROM (
  SELECT {_WORD} AS brand, page_id AS brand_ord,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain FROM {{pages}}) AS r
"""

SPARK_ISO = "date_format(e.ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
DUCK_ISO = "strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%gZ')"

TABLES = ("pages", "events", "orders", "labels", "documents")


def spark_view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a fixture SELECT on the parquet tables it names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    text = text.replace("{iso}", SPARK_ISO).replace("{string}", "STRING")
    return spark.sql(text, **used)


def duck_view(text: str) -> str:
    text = text.replace("{iso}", DUCK_ISO).replace("{string}", "VARCHAR")
    for table in TABLES:
        text = text.replace("{" + table + "}", table)
    return text
