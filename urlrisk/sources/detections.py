"""Reading and writing the detection log as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.operators.scoring import band_column, explanations, recommendations
from urlrisk.sources.upsert import upsert

c = F.col


def detections_from_scores(scored: DataFrame, user_id: Column, user_email: Column, timestamp: Column,
                           request_id: Column) -> DataFrame:
    """Detection records of scored URLs; the stored score is always the computed one."""
    iso = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    user = F.coalesce(user_id, F.lit("anonymous"))
    return scored.select(
        F.concat_ws(":", F.lit("detection"), user, iso, request_id).alias("id"), "url",
        c("risk_score").alias("riskScore"), c("safety_score").alias("safetyScore"),
        (c("prediction") == 1).alias("isPhishing"), "result", "decision",
        c("critical").alias("critical_phishing"), explanations(c("indicators")).alias("explanations"),
        recommendations(band_column(c("risk_score"), 0)).alias("recommendations"), "indicators",
        user.alias("userId"), F.coalesce(user_email, F.lit("anonymous")).alias("userEmail"),
        timestamp.alias("timestamp"))


def append_detections(rows: DataFrame, path: str) -> None:
    """Append to the log, partitioned by month so that date filters skip files.

    Rebalancing gathers a month into few files and still splits a large month.
    """
    monthly = rows.withColumn("month", F.date_format("timestamp", "yyyy-MM")).hint("rebalance", "month")
    monthly.write.mode("append").partitionBy("month").parquet(path)


def merge_detections(rows: DataFrame, path: str, version: str) -> None:
    """Merge records into the log by key, so that reading needs no choice between versions.

    A record's month is that of its time, which is part of its key; only months
    that ``rows`` touch are written again.
    """
    upsert(rows.withColumn("month", F.date_format("timestamp", "yyyy-MM")), path, "id", c(version), "month")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_by_key(log: DataFrame, version: str) -> DataFrame:
    """Upsert view: the last written record of every key; of equal versions that with the greatest hash of its fields."""
    newest = Window.partitionBy("id").orderBy(c(version).desc(), F.xxhash64(F.to_json(F.struct(*log.columns))).desc())
    return log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def scan_by_key_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """Records whose key starts with a text, taken literally; the test reaches the scan."""
    return log.filter(c("id").startswith(prefix))


def lookup_by_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    return log.join(keys.select("id"), "id", "left_semi")


def remove_by_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    return log.join(keys.select("id"), "id", "left_anti")


def export_cases(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Selected records without personal fields; the case number is the key's last part."""
    return (
        lookup_by_keys(log, keys)
        .withColumn("caseId", F.substring_index("id", ":", -1))
        .withColumn("source", F.when(c("userId") == "anonymous", "Anonymous User").otherwise("Registered User"))
        .drop("id", "userId", "userEmail")
    )


def export_header(cases: DataFrame, now: Column) -> DataFrame:
    return cases.agg(F.count("*").alias("totalCases")).withColumn("exportDate", now)


def validate_scores(results: DataFrame, column: str = "risk_score") -> DataFrame:
    """Mark results whose score is not a number in 0..100."""
    score = c(column).try_cast("double")
    return results.withColumn("valid", F.coalesce(score.between(0, 100) & ~F.isnan(score), F.lit(False)))
