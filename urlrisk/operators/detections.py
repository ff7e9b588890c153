"""Filters, statistics and rankings over a detection log.

A detection has id, url, riskScore, safetyScore, isPhishing, critical_phishing,
userId, userEmail and timestamp.  ``now`` is always an argument; time is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.functions.text import half_up
from urlrisk.operators.scoring import band_column, risk_levels

c = F.col
HIGH = 80

# Band names of the server and of the screens.
BAND_RANGES = {
    "trusted": (None, 20), "lowRisk": (20, 45), "low-risk": (20, 45),
    "suspicious": (45, 80), "highRisk": (80, None), "high-risk": (80, None),
}


def valid_detections(log: DataFrame) -> DataFrame:
    return log.filter(c("riskScore").isNotNull() & c("timestamp").isNotNull())


def in_months(log: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Of a log partitioned by month, the months between two times, so that other files are not read.

    Two days more on both sides allow for a writer in another time zone.  A log
    without a text column ``month`` stays as it is.
    """
    if ("month", "string") not in log.dtypes:
        return log
    if first is not None:
        log = log.filter(c("month") >= F.date_format(first.cast("timestamp") - F.expr("interval 2 days"), "yyyy-MM"))
    if last is not None:
        log = log.filter(c("month") <= F.date_format(last.cast("timestamp") + F.expr("interval 2 days"), "yyyy-MM"))
    return log


def is_critical() -> Column:
    return F.coalesce(c("critical_phishing"), F.lit(False))


def search_detections(log: DataFrame, start_date: str | None = None, end_date: str | None = None,
                      risk_level: str | None = None, critical_rule: str | None = None,
                      domain: str | None = None, user: str | None = None) -> DataFrame:
    """All given conditions, newest first.  Plain column tests, so they reach the scan."""
    rows = valid_detections(log)
    if start_date:
        start = F.lit(start_date).cast("timestamp")
        rows = in_months(rows, first=start).filter(c("timestamp") >= start)
    if end_date:
        end = F.lit(f"{end_date} 23:59:59.999").cast("timestamp")
        rows = in_months(rows, last=end).filter(c("timestamp") <= end)
    low, high = BAND_RANGES.get(risk_level, (None, None))
    if low is not None:
        rows = rows.filter(c("riskScore") >= low)
    if high is not None:
        rows = rows.filter(c("riskScore") < high)
    if critical_rule == "applied":
        rows = rows.filter(is_critical())
    elif critical_rule == "not-applied":
        rows = rows.filter(~is_critical())
    if domain:
        rows = rows.filter(F.lower("url").contains(domain.lower()))
    if user:
        rows = rows.filter(F.lower("userEmail").contains(user.lower()) | (F.lower("userId") == user.lower()))
    return newest_first(rows)


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(c("timestamp").desc(), "id")


def _basic() -> list[Column]:
    total = F.count("*")
    phishing = F.count_if(F.coalesce(c("isPhishing"), F.lit(False)))
    return [
        total.alias("totalScans"), phishing.alias("phishingDetected"), (total - phishing).alias("safeDetected"),
        F.coalesce(half_up(F.avg("riskScore"), 1), F.lit(0.0)).alias("avgRiskScore"),
        F.coalesce(half_up(F.try_divide(phishing, total) * 100), F.lit(0)).cast("bigint").alias("phishingRate"),
    ]


def basic_statistics(log: DataFrame, *by: str) -> DataFrame:
    """Totals, average risk and phishing share, over all rows or per group."""
    return valid_detections(log).groupBy(*by).agg(*_basic())


def risk_band_counts(log: DataFrame) -> DataFrame:
    """Rows per band; the four bands always appear."""
    bands = risk_levels(log.sparkSession).select("band", "minimum")
    counts = valid_detections(log).groupBy(band_column(c("riskScore"), 0).alias("band")).agg(F.count("*").alias("n"))
    return bands.join(counts, "band", "left").select("band", "minimum", F.coalesce("n", F.lit(0)).alias("n"))


def band_percentages(log: DataFrame) -> DataFrame:
    counts = risk_band_counts(log)
    total = valid_detections(log).agg(F.count("*")).scalar()
    share = F.coalesce(F.try_divide(c("n") * 100.0, total), F.lit(0.0))
    return counts.select("band", "n", half_up(share, 2).alias("percent"))


def _months(spark, now: Column) -> DataFrame:
    """The twelve calendar months that end with the current one."""
    first = F.add_months(F.trunc(now, "month"), -11)
    series = F.sequence(first, F.trunc(now, "month"), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(series).alias("month_start")).select(
        F.date_format("month_start", "yyyy-MM").alias("month"))


def monthly_stats(log: DataFrame, now: Column) -> DataFrame:
    """Total and high-risk rows of each of the last twelve months, zero-filled.

    The range filter prunes old months before anything is grouped.
    """
    first = F.add_months(F.trunc(now, "month"), -11)
    counts = (
        valid_detections(in_months(log, first)).filter(c("timestamp") >= first)
        .groupBy(F.date_format("timestamp", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("total"), F.count_if(c("riskScore") >= HIGH).alias("highRisk"))
    )
    return _months(log.sparkSession, now).join(counts, "month", "left").select(
        "month", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("highRisk", F.lit(0)).alias("highRisk"))


def months_ascending(log: DataFrame, now: Column) -> DataFrame:
    return monthly_stats(log, now).orderBy("month").select(
        F.concat(F.substring("month", 6, 2), F.lit("/"), F.substring("month", 1, 4)).alias("label"),
        "month", "total", "highRisk")


def submitted_host(url: Column) -> Column:
    """Lower-case host name as a browser sees it: keeps ``www.``, drops user and port; null if unreadable."""
    authority = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#\\\s]*)", 1))
    host = F.regexp_replace(F.substring_index(authority, "@", -1), r":\d*$", "")
    return F.when(host.rlike(r"^[^\s%<>^|\[\]:]+$"), host)


def _host_table(log: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("url", "riskScore", is_critical().alias("critical"), "timestamp"),
                      F.struct("timestamp", "id"))
    return (
        valid_detections(log).filter(c("riskScore") >= HIGH)
        .withColumn("host", submitted_host(c("url"))).filter("host IS NOT NULL")
        .groupBy("host")
        .agg(F.count("*").alias("detectionCount"), F.count_if(is_critical()).alias("criticalRuleApplications"),
             latest.alias("latest"))
        .select("host", "detectionCount", "criticalRuleApplications",
                c("latest.url").alias("latestSubmittedUrl"), c("latest.riskScore").alias("latestRiskScore"),
                c("latest.critical").alias("latestCriticalRuleApplied"),
                c("latest.timestamp").alias("latestTimestamp"))
    )


def top_high_risk_hosts(log: DataFrame, k: int = 10) -> DataFrame:
    """Hosts with most high-risk detections; ties by latest detection, then name."""
    return _host_table(log).orderBy(c("detectionCount").desc(), c("latestTimestamp").desc(), "host").limit(k)


def abused_domain_counts(log: DataFrame) -> DataFrame:
    return top_high_risk_hosts(log).select(c("host").alias("domain"), c("detectionCount").alias("count"))


def latest_per_host(log: DataFrame) -> DataFrame:
    """Most recent detection of every host."""
    fields = ["id", "url", "riskScore", "timestamp"]
    return (
        valid_detections(log).withColumn("host", submitted_host(c("url"))).filter("host IS NOT NULL")
        .groupBy("host").agg(F.max_by(F.struct(*fields), F.struct("timestamp", "id")).alias("d"))
        .select("host", "d.*")
    )


_GRAINS = ("user", "band", "month", "host")
HOST_RECORD = ("host", "detectionCount", "criticalRuleApplications", "latestSubmittedUrl", "latestRiskScore",
               "latestCriticalRuleApplied", "latestTimestamp")


def statistics_grains(log: DataFrame, now: Column, exact_users: bool = True) -> DataFrame:
    """One row per user, band, month of the last twelve and high-risk host, with its counts.

    All grains come from one scan and one aggregation over grouping sets; ``grain``
    names the set and ``key`` its value.
    """
    first = F.add_months(F.trunc(now, "month"), -11)
    high = c("riskScore") >= HIGH
    rows = valid_detections(log).select(
        "id", "url", "riskScore", "timestamp", c("userId").alias("user"), band_column(c("riskScore"), 0).alias("band"),
        F.when(c("timestamp") >= first, F.date_format("timestamp", "yyyy-MM")).alias("month"),
        F.when(high, submitted_host(c("url"))).alias("host"),
        F.coalesce(c("isPhishing"), F.lit(False)).alias("phishing"), is_critical().alias("critical"))
    sets = [[name] for name in _GRAINS if exact_users or name != "user"]
    # The newest record is kept for rows with a host only; elsewhere nothing is stored per group.
    record = F.when(c("newest_of").isNotNull(), F.struct("url", "riskScore", "critical", "timestamp"))
    order = F.when(c("newest_of").isNotNull(), F.struct("timestamp", "id"))
    counts = [
        F.count("*").alias("n"), F.count_if("phishing").alias("phishing"), F.sum("riskScore").alias("risk"),
        F.count_if("critical").alias("critical"), F.count_if(high).alias("high"),
        F.count_if(c("user_name") == "anonymous").alias("anonymous"), F.max_by(record, order).alias("latest")]
    if not exact_users:
        counts.append(F.hll_sketch_agg("user_name").alias("users"))
    grouped = (rows.withColumns({"newest_of": c("host"), "user_name": c("user")})
               .groupingSets(sets, *[name for name in _GRAINS if exact_users or name != "user"])
               .agg(F.grouping_id().alias("_set"), *counts))
    names = [s[0] for s in sets]
    # A bit of the set's number is 0 for the column that is grouped by.
    full = (1 << len(names)) - 1
    number = {name: full ^ (1 << (len(names) - 1 - i)) for i, name in enumerate(names)}
    grain = F.coalesce(*[F.when(c("_set") == value, F.lit(name)) for name, value in number.items()])
    return grouped.withColumn("grain", grain).withColumn("key", F.coalesce(*names)).drop("_set", *names).filter(
        c("key").isNotNull() | c("grain").isin("user", "band"))


def global_statistics(log: DataFrame, now: Column, exact_users: bool = True, k: int = 10) -> DataFrame:
    """One row: totals, bands, users, ``months`` (the last twelve, zero-filled) and ``hosts`` (the k with most high risk).

    One scan feeds one aggregation over all grains (:func:`statistics_grains`).
    Hosts are cut to k within each task before they are shuffled, users are
    counted as rows of their grain, so nothing unbounded meets in one task.
    ``exact_users=False`` replaces the grain of users by a sketch.  An empty log gives zeros,
    twelve empty months and no hosts.
    """
    grains = statistics_grains(log, now, exact_users)
    is_ = lambda name: c("grain") == name
    # Ranks count within all hosts together, and within every other key alone, where they are always 1.
    place = Window.partitionBy("grain", F.when(~is_("host"), F.struct("key"))).orderBy(
        c("n").desc(), c("latest.timestamp").desc(), "key")
    rows = grains.withColumn("place", F.row_number().over(place)).filter(c("place") <= k)
    band = lambda col: F.sum(F.when(is_("band"), col))
    zero = lambda col: F.coalesce(col, F.lit(0))
    n, phishing = band(c("n")), band(c("phishing"))
    users = F.count(F.when(is_("user"), c("key"))) if exact_users else zero(F.hll_sketch_estimate(
        F.hll_union_agg(F.when(is_("band"), c("users")))))
    month_rows = F.collect_list(F.when(is_("month"), F.struct(c("key").alias("month"), F.struct("n", "high"))))
    host_rows = F.collect_list(F.when(is_("host"), F.struct(
        "place", c("key").alias("host"), c("n").alias("detectionCount"), c("critical").alias("criticalRuleApplications"),
        c("latest.url").alias("latestSubmittedUrl"), c("latest.riskScore").alias("latestRiskScore"),
        c("latest.critical").alias("latestCriticalRuleApplied"), c("latest.timestamp").alias("latestTimestamp"))))
    folded = rows.agg(
        zero(n).alias("totalScans"), zero(phishing).alias("phishingDetected"), zero(n - phishing).alias("safeDetected"),
        F.coalesce(half_up(F.try_divide(band(c("risk")), n), 1), F.lit(0.0)).alias("avgRiskScore"),
        zero(half_up(F.try_divide(phishing, n) * 100)).cast("bigint").alias("phishingRate"),
        *[zero(F.sum(F.when(is_("band") & (c("key") == b), c("n")))).alias(b)
          for b in ("trusted", "lowRisk", "suspicious", "highRisk")],
        zero(band(c("critical"))).alias("criticalRuleApplications"), users.alias("uniqueUsers"),
        zero(band(c("anonymous"))).alias("anonymousScans"),
        F.map_from_entries(month_rows).alias("_months"), host_rows.alias("_hosts"))
    series = F.sequence(F.add_months(F.trunc(now, "month"), -11), F.trunc(now, "month"), F.expr("interval 1 month"))

    def month(start: Column) -> Column:
        name = F.date_format(start, "yyyy-MM")
        found = F.try_element_at(c("_months"), name)
        return F.struct(name.alias("month"), zero(found["n"]).alias("total"), zero(found["high"]).alias("highRisk"))

    hosts = F.transform(F.array_sort("_hosts"), lambda h: F.struct(*[h[name].alias(name) for name in HOST_RECORD]))
    return folded.withColumn("months", F.transform(series, month)).withColumn("hosts", hosts).drop("_months", "_hosts")


def daily_risk_trend(log: DataFrame, days: int = 7) -> DataFrame:
    """Average risk of the last days that have data."""
    daily = valid_detections(log).groupBy(F.to_date("timestamp").alias("date")).agg(
        half_up(F.avg("riskScore")).cast("bigint").alias("avgRisk"))
    return daily.orderBy(c("date").desc()).limit(days).orderBy("date")


def recent_scan_count(log: DataFrame, now: Column, days: int = 7) -> DataFrame:
    start = now.cast("timestamp") - F.expr(f"interval {days} days")
    return valid_detections(in_months(log, start)).filter(c("timestamp") >= start).agg(F.count("*").alias("recentScans"))


def indicator_status_counts(indicators: DataFrame) -> DataFrame:
    """Safe, warning and danger rows per indicator."""
    return indicators.groupBy("name").agg(*[
        F.count_if(c("status") == s).alias(s) for s in ("safe", "warning", "danger")])


def recent_history(log: DataFrame, k: int = 5) -> DataFrame:
    """Newest k scans per user; the same URL at the same time counts once.

    Each map task keeps k rows per user before the shuffle (a group limit on the
    rank), so one very active user does not fill a task.
    """
    once = valid_detections(log).groupBy("userId", "url", "timestamp").agg(
        F.min("id").alias("id"), F.max("riskScore").alias("riskScore"))
    newest = Window.partitionBy("userId").orderBy(c("timestamp").desc(), "id")
    return once.withColumn("rank", F.row_number().over(newest)).filter(c("rank") <= k)
