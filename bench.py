"""Headline queries, timed.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from urlrisk.plans.registered import QUERIES
from urlrisk.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "normalize_urls", "split_urls", "lexical_counts", "match_official_domain", "lookalike_subdomain",
    "typo_ratio_match", "brand_like_token", "reputation_cascade", "pages_per_band", "score_urls", "indicators_long",
    "features_22", "features_30", "basic_statistics", "global_statistics", "monthly_stats", "top_high_risk_hosts",
    "recent_history", "search_detections", "append_detections", "dedupe_keep_last", "stratified_split", "roc_auc",
    "stream_score_urls", "stream_band_counts",
]


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # A no-op sink runs the whole plan without moving rows to the driver.
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
