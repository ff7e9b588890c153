"""Streaming form of scoring and of the detection statistics.

Every stream ends when its present input is used up (``availableNow``) and can be
started again from its checkpoint.  Sinks are tables, never the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.operators.detections import HIGH, is_critical, submitted_host, valid_detections
from urlrisk.operators import sgd
from urlrisk.operators.scoring import band_column
from urlrisk.session import children, drop_shared, scratch, shared_path
from urlrisk.sources.upsert import read, upsert

c = F.col


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Stream of a parquet table, with at most so many files a batch.  The pattern also accepts a table of one file."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path[:-1] + "[" + path[-1] + "]")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over its present input into a parquet table and read that back, on from ``folder`` where one is given."""
    spark = stream.sparkSession
    path = f"{folder}/rows" if folder else shared_path(spark, name)
    checkpoint = f"{folder}/checkpoint" if folder else shared_path(spark, f"{name}-checkpoint")
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None],
                mode: str = "append", checkpoint: str | None = None) -> None:
    """Run a stream batch by batch over its present input, on from ``checkpoint`` where one is given."""
    checkpoint = checkpoint or shared_path(stream.sparkSession, f"{name}-checkpoint")
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


def stream_score_urls(urls: DataFrame, score: Callable[[DataFrame], DataFrame], name: str = "scores") -> DataFrame:
    """Score arriving URLs batch by batch; each batch is one ordinary scoring job.

    The batch number is part of the file path, so a repeated batch replaces itself;
    the tables that a batch needs go with it.
    """
    spark = urls.sparkSession
    path = shared_path(spark, name)

    def handle(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(urls, name, handle)
    return spark.read.parquet(path).drop("batch")


#: Where a stream keeps state of its own kind.
_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_dedupe(log: DataFrame, version: str, delay: str = "1 day", folder: str | None = None) -> DataFrame:
    """One record per detection id: the one with the greatest ``version``, however late it came.

    Records of an id whose times are less than ``delay`` apart are one session; its
    newest record is state until the watermark passes the session by ``delay``, then it is
    emitted and the state goes.  Of equal versions that with the greatest hash of
    its fields stays.  Records of an id further apart are records of their own;
    one that comes when its session has been emitted is late and is dropped.
    With a ``folder`` the stream goes on where an earlier run on that folder ended.
    """
    spark, names = log.sparkSession, log.columns
    before = spark.conf.get(_STATE_STORE[0], None)
    spark.conf.set(*_STATE_STORE)
    try:
        record, order = F.struct(*names), F.struct(c(version).alias("v"), F.xxhash64(F.to_json(F.struct(*names))).alias("h"))
        newest = (valid_detections(log).withColumns({"_record": record, "_order": order}).withWatermark("timestamp", delay)
                  .repartition("id").groupBy("id", F.session_window("timestamp", delay)).agg(F.max_by("_record", "_order").alias("_r")).select("_r.*"))
        return run_to_table(newest, "deduped", folder=folder)
    finally:
        spark.conf.unset(_STATE_STORE[0]) if before is None else spark.conf.set(_STATE_STORE[0], before)


def stream_band_counts(log: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per band and tumbling window, emitted once a window is closed."""
    counts = (
        valid_detections(log).withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", width).alias("w"), band_column(c("riskScore"), 0).alias("band"))
        .agg(F.count("*").alias("n"))
        .select(c("w.start").alias("window_start"), "band", "n")
    )
    return run_to_table(counts, "bands")


#: Partitions of the table of hosts; a batch rewrites those of the hosts it changes.
HOST_PARTS = 16
HOST_SCHEMA = "host string, detectionCount bigint, criticalRuleApplications bigint, latestTimestamp timestamp, part int"


def stream_top_hosts(log: DataFrame, k: int = 10, folder: str | None = None) -> DataFrame:
    """High-risk host counts as stateful aggregation; the ranking reads a table with one row per host.

    Sums live in the state store.  Each batch hands over only the hosts that it
    changed, with their totals, and these are merged into the table, so a repeated batch
    changes nothing and files grow with hosts, not with batches.  With a
    ``folder`` the stream goes on where an earlier run on that folder ended.
    """
    spark = log.sparkSession
    folder = folder or shared_path(spark, "hosts")
    counts = (
        valid_detections(log).filter(c("riskScore") >= HIGH)
        .withColumn("host", submitted_host(c("url"))).filter("host IS NOT NULL")
        .groupBy("host").agg(
            F.count("*").alias("detectionCount"), F.count_if(is_critical()).alias("criticalRuleApplications"),
            F.max("timestamp").alias("latestTimestamp")))

    def handle(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("host"), F.lit(HOST_PARTS)).cast("int")
        upsert(batch.withColumn("part", part), f"{folder}/table", "host", c("detectionCount"), "part")

    run_batches(counts, "hosts", handle, "update", f"{folder}/checkpoint")
    return read(spark, f"{folder}/table", HOST_SCHEMA).drop("part").orderBy(
        c("detectionCount").desc(), c("latestTimestamp").desc(), "host").limit(k)


def stream_mini_batch_fit(rows: DataFrame, vectors: Callable[[DataFrame], DataFrame], settings: sgd.Settings,
                          folder: str | None = None) -> sgd.SgdModel:
    """Learn on from batch to batch; returns the model after the last one.

    Weights, averages and the number of steps are a written table per batch, read by the
    next; a repeated batch starts from the one before it and replaces itself.
    The last two tables are kept.  With a ``folder`` the stream goes on where an earlier run
    on that folder ended.
    """
    spark = rows.sparkSession
    folder = folder or shared_path(spark, "model")

    def handle(batch: DataFrame, number: int) -> None:
        before = sgd.load(spark, settings, f"{folder}/rounds/{number - 1}") if number else sgd.SgdModel(settings)
        sgd.fit_round(before, vectors(batch), f"{folder}/rounds/{number}")
        if number > 1:
            drop_shared(spark, f"{folder}/rounds/{number - 2}")

    run_batches(rows, "model", handle, checkpoint=f"{folder}/checkpoint")
    rounds = [int(name) for name in children(spark, f"{folder}/rounds")]
    return sgd.load(spark, settings, f"{folder}/rounds/{max(rounds)}") if rounds else sgd.SgdModel(settings)
