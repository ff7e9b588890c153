"""Streams and batch jobs give the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import detections as D
from urlrisk.plans import registered
from urlrisk.plans.score import score_urls
from urlrisk.session import children, shared_folder
from urlrisk.streaming import jobs as ST

DDL = "id string, url string, riskScore int, critical_phishing boolean, timestamp timestamp"


@pytest.fixture()
def log(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"d{i % 90}", f"https://h{i % 4}.example/{i % 90}", (i % 90 * 7) % 101, i % 90 % 5 == 0,
             start + dt.timedelta(hours=i % 90)) for i in range(120)]
    path = str(tmp_path / "log.parquet")
    for part in range(3):
        spark.createDataFrame(rows[part * 40:part * 40 + 40], DDL).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return ST.read_stream(spark, path, spark.read.parquet(path).schema)


def test_dedupe_keeps_the_last_record(spark, tmp_path):
    """Corrections in later deliveries, one older than what is held, repeats, and a restart's worth of keys."""
    start, path = dt.datetime(2024, 1, 1), str(tmp_path / "log.parquet")
    deliveries = [
        [(f"d{i}", f"u{i}", i, False, start + dt.timedelta(hours=i), 2) for i in range(40)] + [("null", "x", None, False, start, 9)],
        [(f"d{i}", f"new{i}", 100 - i, None, start + dt.timedelta(hours=i), 3) for i in range(0, 40, 2)],
        [(f"d{i}", f"old{i}", 50, True, start + dt.timedelta(hours=i), 1) for i in range(0, 40, 5)],
        [("end", "x", 0, False, dt.datetime(2024, 5, 1), 1)], [("end2", "x", 0, False, dt.datetime(2024, 5, 2), 1)]]
    for rows in deliveries:
        spark.createDataFrame(rows, DDL + ", version int").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    got = {r.id: (r.url, r.riskScore) for r in ST.stream_dedupe(ST.read_stream(spark, path, schema, 1), "version", "10 days").collect()
           if not r.id.startswith("end")}
    assert got == {f"d{i}": (f"new{i}", 100 - i) if i % 2 == 0 else (f"u{i}", i) for i in range(40)}


def test_dedupe_goes_on_after_a_restart(spark, tmp_path):
    """Deliveries of several files each, one run per delivery; nothing is emitted before the watermark has passed."""
    start, source, folder = dt.datetime(2024, 1, 1), str(tmp_path / "in.parquet"), f"file://{tmp_path}/deduped"
    ddl = DDL + ", version int"
    first = spark.createDataFrame([(f"d{i}", f"u{i}", i, False, start + dt.timedelta(hours=i), 1) for i in range(40)], ddl)
    # A correction may move the time of its record, and of equal versions the same one stays in any order.
    later = spark.createDataFrame([(f"d{i}", f"new{i}", 90, None, start + dt.timedelta(hours=i + 30), 2) for i in range(0, 40, 2)], ddl)
    same = later.withColumn("url", F.concat("url", F.lit("x")))
    end = spark.createDataFrame([("end", "x", 0, False, dt.datetime(2024, 5, 1), 1)], ddl)
    counts = []
    for rows in (first.repartition(3), later.repartition(2), same, end):
        rows.write.mode("append").parquet(source)
        got = ST.stream_dedupe(ST.read_stream(spark, source, rows.schema), "version", "10 days", folder)
        counts.append(got.count())
    assert counts[:3] == [0, 0, 0]
    tied = later.union(same).withColumn("h", F.xxhash64(F.to_json(F.struct(*later.columns))))
    want = {r.id: r.url for r in first.collect()} | {r.id: r.url for r in tied.orderBy("h").collect()}
    assert {r.id: r.url for r in got.collect()} == want and counts[3] == 40


def test_closed_windows_equal_batch_counts(spark, log):
    marker = [("end", "x", 0, False, dt.datetime(2024, 3, 1))]
    spark.createDataFrame(marker, DDL).write.mode("append").parquet(log)
    got = ST.stream_band_counts(stream(spark, log)).filter("window_start < '2024-02-01'")
    assert got.agg(F.sum("n")).first()[0] == 120
    batch = D.risk_band_counts(spark.read.parquet(log).filter("id <> 'end'"))
    streamed = {r.band: r.n for r in got.groupBy("band").agg(F.sum("n").alias("n")).collect()}
    assert streamed == {r.band: r.n for r in batch.collect()}


def test_top_hosts_equal_batch(spark, log):
    got = ST.stream_top_hosts(stream(spark, log)).collect()
    want = D.top_high_risk_hosts(spark.read.parquet(log)).collect()
    fields = ("host", "detectionCount", "criticalRuleApplications", "latestTimestamp")
    assert [tuple(r[f] for f in fields) for r in got] == [tuple(r[f] for f in fields) for r in want]


def test_top_hosts_go_on_after_a_restart(spark, log, tmp_path):
    """Two runs on one folder equal one run; the table's files do not grow with batches."""
    folder, source = f"file://{tmp_path}/hosts", str(tmp_path / "in.parquet")
    rows = spark.read.parquet(log)
    for third in range(3):
        rows.filter(F.abs(F.hash("id")) % 3 == third).coalesce(1).write.mode("append").parquet(source)
        got = ST.stream_top_hosts(ST.read_stream(spark, source, rows.schema, 1), folder=folder).collect()
    want = D.top_high_risk_hosts(rows).collect()
    fields = ("host", "detectionCount", "criticalRuleApplications", "latestTimestamp")
    assert [tuple(r[f] for f in fields) for r in got] == [tuple(r[f] for f in fields) for r in want]
    files = list((tmp_path / "hosts" / "table").glob("part=*/*.parquet"))
    assert len(files) <= len(want)
    again = ST.stream_top_hosts(ST.read_stream(spark, source, rows.schema, 1), folder=folder).collect()
    assert again == got


def test_a_delivery_is_not_written_by_one_task(spark, monkeypatch, tmp_path):
    """Every delivery keeps its partitions, and the stream of it holds what came before."""
    monkeypatch.setattr(registered, "shared_path", lambda spark, name: f"{tmp_path}/{name}.parquet")
    files = lambda: len(list(tmp_path.glob("*.parquet/part-*")))
    written = [files() for _ in registered._delivered(spark, *(spark.range(9).repartition(3) for _ in range(2)))]
    assert written == [3, 6]


def test_scores_equal_batch(spark, registry, tmp_path):
    path = str(tmp_path / "urls.parquet")
    spark.createDataFrame([("https://google.com",), ("https://goog1e.com",), ("http://a.b/login",)], "url string").write.parquet(path)
    score = lambda rows: score_urls(rows, registry).select("url", "risk_score")
    ST.stream_score_urls(stream(spark, path), score)       # whatever a registry keeps stands now
    before = set(children(spark, shared_folder(spark)))
    got = ST.stream_score_urls(stream(spark, path), score)
    left = set(children(spark, shared_folder(spark))) - before
    assert {name.rsplit("-", 1)[0] for name in left} == {"scores", "scores-checkpoint"}
    assert got.exceptAll(score(spark.read.parquet(path))).isEmpty() and got.count() == 3
