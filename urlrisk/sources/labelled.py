"""Labelled URL tables: loading, union, duplicate removal, report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlrisk.session import cut

c = F.col


def load_labelled_urls(spark: SparkSession, path: str, source: str, weight: float = 1.0,
                       positive_label: int = 1) -> DataFrame:
    """Read a CSV with a URL and a label column; names are trimmed, ``url`` and ``URL`` are the same.

    ``positive_label`` says which label of the file means phishing.
    """
    raw = spark.read.csv(path, header=True)
    names = {name.strip().lower(): name for name in raw.columns}
    label = c(names["label"]).try_cast("double").cast("int")
    return (
        raw.select(c(names["url"]).alias("url"), label.alias("label"))
        .dropna(subset=["url", "label"])
        .select("url", F.when(F.lit(positive_label == 1), c("label")).otherwise(1 - c("label")).alias("label"),
                F.lit(source).alias("source"), F.lit(weight).alias("sample_weight"))
    )


def union_sources(*tables: DataFrame) -> DataFrame:
    """Concatenate labelled tables; ``priority`` grows with position."""
    merged = None
    for priority, table in enumerate(tables):
        part = table.select("url", "label", "source", "sample_weight", F.lit(priority).alias("priority"))
        merged = part if merged is None else merged.unionByName(part)
    return merged


def dedupe_keep_last(merged: DataFrame) -> DataFrame:
    """One row per (url, label): the last source wins.  Partial aggregation, no sort."""
    return merged.groupBy("url", "label").agg(
        F.max(F.struct("priority", "sample_weight", "source")).alias("last")).select(
        "url", "label", "last.source", "last.sample_weight")


def stratified_split(rows: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark a fixed share of every label as test rows, reproducibly; rows are distinct (url, label).

    Rows are ordered by a hash of the URL, and a row is a test row when its hash
    is at most the cut hash of its label.  The cut is found from counts per hash
    bucket: only the one bucket that holds it is ranked, so no label is sorted.
    """
    hashed = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "url"), 256))
    buckets = hashed.groupBy("label", F.substring("_h", 1, 4).alias("_b")).agg(F.count("*").alias("_n"))
    totals = buckets.groupBy("label").agg(F.floor(F.sum("_n") * test_share + 0.5).alias("_want"))
    # At most 65,536 buckets per label reach this window.
    upto = buckets.withColumn("_upto", F.sum("_n").over(Window.partitionBy("label").orderBy("_b")))
    holder = upto.join(totals, "label").filter(
        (c("_upto") >= c("_want")) & (c("_upto") - c("_n") < c("_want"))).select(
        "label", "_b", (c("_want") - c("_upto") + c("_n")).alias("_take"))
    inside = hashed.select("label", "_h", F.substring("_h", 1, 4).alias("_b")).join(holder, ["label", "_b"])
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_h")))
    cuts = ranked.filter(c("_r") == c("_take")).select("label", c("_h").alias("_cut"))
    return (
        hashed.join(cut(cuts, "cuts"), "label", "left")
        .withColumn("is_test", F.coalesce(c("_h") <= c("_cut"), F.lit(False))).drop("_h", "_cut")
    )


def report_lines(metrics: DataFrame, labels: DataFrame, sources: DataFrame, cases: DataFrame) -> DataFrame:
    """Report as (section, name, line): metrics, distributions and one line per named case."""
    parts = [
        metrics.select(F.inline(F.array(*[
            F.struct(F.lit("1 metrics").alias("section"), F.lit(n).alias("name"),
                     F.format_string(f"{n}: %.4f", c(n).cast("double")).alias("line"))
            for n in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")]))),
        labels.select(F.lit("2 labels").alias("section"), c("label").cast("string").alias("name"),
                      F.format_string("label %d: %d rows", "label", "n").alias("line")),
        sources.select(F.lit("3 sources").alias("section"), c("source").alias("name"),
                       F.format_string("source %s: %d rows", "source", "n").alias("line")),
        cases.select(F.lit("4 cases").alias("section"), c("name"), F.format_string(
            "%s | %s | expected=%d predicted=%d probability=%.4f | %s",
            F.when(c("pass"), "PASS").otherwise("FAIL"), "name", "expected", "predicted", "probability", "url")
            .alias("line")),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as JSON rows and as text, both in order."""
    ordered = lines.orderBy("section", "name")
    ordered.write.mode("overwrite").json(f"{path}/json")
    ordered.select("line").write.mode("overwrite").text(f"{path}/text")
