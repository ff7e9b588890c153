"""Registered queries of the text operators and their check SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm import ann, bpe, decontam, filter_audit, grades, lm, mixing, neardup, passages, periods, prefix, url_lists

#: Tokens of the context that documents are cut to.
CONTEXT = 4096


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a hidden Markov model of those that are not held out."""
    return lm.scores(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected quality grade of all documents, and which are good enough."""
    return grades.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, fetched when the event of its number happened, against the lists of that time.

    Error events put the host (or, for odd users, the domain) of a page on one of
    three lists, purchases take it off.
    """
    pages, events = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "events")
    captures = pages.join(events.select(F.col("event_id").alias("page_id"), F.col("ts").alias("fetched_at")), "page_id", "left")
    return _listed(captures, _entries(pages, events), "page_id")


def op3_url_filters_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a capture of a page, against the lists of its time, made as for ``op3_url_filters``."""
    pages, events = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "events")
    many = _many(pages)
    captures = (events.select("event_id", F.col("ts").alias("fetched_at"), (F.col("event_id") % many).alias("page_id"))
                .join(pages, "page_id"))
    return _listed(captures, _entries(pages, events), "event_id")


def _many(pages: DataFrame) -> int:
    return pages.agg(F.max("page_id") + 1).first()[0] or 1


def _entries(pages: DataFrame, events: DataFrame) -> DataFrame:
    many = _many(pages)
    host = url_lists.host(F.col("url"))
    return (events.where("event_type IN ('error', 'purchase')").withColumn("page_id", F.col("event_id") % many)
            .join(pages, "page_id").select(
                F.concat(F.lit("list"), F.col("user_id") % 3).alias("list"), F.col("ts").alias("at"),
                F.when(F.col("user_id") % 2 == 0, host).otherwise(F.substring_index(host, ".", -2)).alias("key"),
                (F.col("event_type") == "error").alias("adds")))


def _listed(captures: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    found = url_lists.hits(captures, entries, key)
    names = F.transform("hits", lambda x: F.concat_ws(" ", x["list"], x["key"]))
    return found.select(key, "host", F.size("hits").cast("long").alias("n_hits"), F.array_join(names, ",").alias("hits"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents, and how much of each fits the context."""
    return prefix.budgets(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), CONTEXT)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on three-word shingles at 0.85."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the bytes decoded from them, as digests."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has as well, of all documents."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item and the place."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents."""
    return grades.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents in each of their orders, by language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 150 % takes that brings all sources to their target weights."""
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def _repeating(doc_id: int | None, words: list) -> list:
    """The words of a document, for a tenth of the ids with a stretch that repeats; a null id has none."""
    number = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if number % 10 or not words:
        return words
    seed, n = number // 10, len(words)
    start = seed % n
    period = 1 + (n - start) // (3 + seed % 8)
    return words[:start] + [words[start + (i - start) % period] for i in range(start, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, the greatest one, and the texts without the repeats, as digests."""
    return periods.digest(periods.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=_repeating))


QUERIES = {q.__name__: q for q in (
    op1_language_model, op2_quality_classifier, op3_url_filters, op3_url_filters_over_time, op4_token_counts,
    op5_minhash_near_dedup, op6_byte_bpe, op7_nearest, op8_substring_dedup, op9_decontamination, op10_toxicity,
    op11_filter_audit, op12_mixing, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op3_url_filters": r"""
WITH p AS MATERIALIZED (
  SELECT page_id, nullif(regexp_replace(trim(regexp_replace(regexp_replace(
           regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':.*$', ''), '.'),
           '^www\.', ''), '') AS host FROM pages),
c AS MATERIALIZED (SELECT row_number() OVER () AS rid, p.page_id, p.host, e.ts FROM p LEFT JOIN events e ON e.event_id = p.page_id),
entries AS (
  SELECT concat('list', e.user_id % 3) AS list, e.ts AS at, bool_or(e.event_type = 'error') AS adds,
         CASE WHEN e.user_id % 2 = 0 THEN p.host
              WHEN p.host LIKE '%.%' THEN regexp_extract(p.host, '[^.]*\.[^.]*$') ELSE p.host END AS key
  FROM events e JOIN p ON p.page_id = e.event_id % (SELECT max(page_id) + 1 FROM pages)
  WHERE e.event_type IN ('error', 'purchase') GROUP BY ALL),
spans AS MATERIALIZED (
  SELECT list, key, began, ended FROM (
    SELECT e.list, e.key, e.adds, e.at AS began, lead(e.at) OVER (PARTITION BY e.list, e.key ORDER BY e.at) AS ended FROM entries e) WHERE adds),
names AS MATERIALIZED (
  SELECT host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
           lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key
  FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
held AS (
  SELECT c.rid, s.list, s.key FROM c JOIN names n ON n.host = c.host JOIN spans s ON s.key = n.key
   AND s.began <= c.ts AND (s.ended IS NULL OR c.ts < s.ended)),
hits AS (SELECT rid, count(*) AS n_hits, string_agg(concat(list, ' ', key), ',' ORDER BY list, key) AS hits FROM held GROUP BY rid)
SELECT c.page_id, c.host, coalesce(h.n_hits, 0) AS n_hits, coalesce(h.hits, '') AS hits FROM c LEFT JOIN hits h ON h.rid = c.rid
"""}
ORACLES["op3_url_filters_over_time"] = (
    ORACLES["op3_url_filters"]
    .replace("p.page_id, p.host, e.ts FROM p LEFT JOIN events e ON e.event_id = p.page_id",
             "e.event_id, p.host, e.ts FROM events e JOIN p ON p.page_id = e.event_id % (SELECT max(page_id) + 1 FROM pages)")
    .replace("SELECT c.page_id", "SELECT c.event_id"))
ORACLES["op11_filter_audit"] = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM words d LEFT JOIN marks m ON m.doc_id = d.doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT concat(f1.l, f2.l, f3.l, f4.l, f5.l) AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31
   AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step,
       coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0) AS kept,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
       coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
       coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
       coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
       coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0) AS shapley
FROM counted, steps GROUP BY part, filter_order, step
"""
