import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from urlrisk.operators import detections as D
from urlrisk.operators import evaluation as E
from urlrisk.session import materialize
from urlrisk.sources.upsert import newest
from urlrisk.sources import detections as SD

NOW = dt.datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(2)
    rows = []
    for i in range(600):
        time = NOW - dt.timedelta(days=rng.randint(0, 500), seconds=rng.randint(0, 80000))
        user = rng.choice(["anonymous", "u1", "u2", "u10"])
        url = rng.choice(["https://WWW.A.com:8443/x", "http://u@b.com", "not a url", "https://c.org/?a=1"])
        score = rng.choice([None, *range(0, 101)])
        rows.append((f"detection:{user}:{i}", url, score, None if score is None else score >= 45,
                     rng.random() < 0.2, user, f"{user}@mail.example", time))
    return rows


@pytest.fixture(scope="module")
def log(spark, raw):
    return spark.createDataFrame(raw, "id string, url string, riskScore int, isPhishing boolean, "
                                      "critical_phishing boolean, userId string, userEmail string, timestamp timestamp")


def valid(raw):
    return [r for r in raw if r[2] is not None]


def test_bands_sum_to_total(log, raw):
    counts = {r.band: r.n for r in D.risk_band_counts(log).collect()}
    assert sum(counts.values()) == len(valid(raw)) == D.basic_statistics(log).first().totalScans
    assert counts["highRisk"] == sum(r[2] >= 80 for r in valid(raw))


def test_empty_log_is_zero(log):
    empty = log.limit(0)
    row = D.basic_statistics(empty).first()
    assert (row.totalScans, row.avgRiskScore, row.phishingRate) == (0, 0.0, 0)
    assert {r.n for r in D.risk_band_counts(empty).collect()} == {0}
    assert {r.percent for r in D.band_percentages(empty).collect()} == {0.0}
    row = D.global_statistics(empty, F.lit("2024-02-01").cast("timestamp")).first()
    assert (row.uniqueUsers, row.totalScans, row.hosts) == (0, 0, [])
    assert [m.total for m in row.months] == [0] * 12


def test_search(log, raw):
    got = D.search_detections(log, "2023-06-01", "2023-12-31", "highRisk", "not-applied", "A.COM", "U1").collect()
    want = [r for r in valid(raw) if dt.datetime(2023, 6, 1) <= r[7] < dt.datetime(2024, 1, 1) and r[2] >= 80
            and not r[4] and "a.com" in r[1].lower() and ("u1" in r[6] or r[5] == "u1")]
    assert [r.id for r in got] == [r[0] for r in sorted(want, key=lambda r: (-r[7].timestamp(), r[0]))]
    assert D.search_detections(log, risk_level="nonsense").count() == len(valid(raw))


def test_search_filters_reach_the_scan(spark, log, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    SD.append_detections(log, str(tmp_path / "log"))
    table = SD.read_detections(spark, str(tmp_path / "log"))
    plan = D.search_detections(table, "2023-06-01", None, "high-risk")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(riskScore,80)" in plan and "GreaterThanOrEqual(timestamp" in plan
    prefix = SD.scan_by_key_prefix(table, "detection:u1:")
    assert "StringStartsWith(id,detection:u1:)" in prefix._jdf.queryExecution().executedPlan().toString()


def test_date_filters_skip_months(spark, log, tmp_path):
    SD.append_detections(log, str(tmp_path / "log"))
    table = SD.read_detections(spark, str(tmp_path / "log"))
    now = F.lit(NOW)
    pairs = [(D.search_detections(t, "2023-06-01", "2023-08-31").select("id"), D.recent_scan_count(t, now),
              D.months_ascending(t, now)) for t in (table, log)]
    for pruned, whole in zip(*pairs):
        assert "PartitionFilters: [isnotnull(month" in pruned._jdf.queryExecution().executedPlan().toString()
        assert sorted(pruned.collect()) == sorted(whole.collect())


def test_equal_versions_give_one_result(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "z", 2)], "id string, url string, version int")
    first = sorted(SD.latest_by_key(rows, "version").collect())
    assert len(first) == 2 and first == sorted(SD.latest_by_key(rows.orderBy(F.desc("url")), "version").collect())


def test_monthly_stats_are_zero_filled(log, raw):
    rows = D.months_ascending(log, F.lit(NOW)).collect()
    assert [r.month for r in rows][0] == "2023-03" and len(rows) == 12 and rows[-1].label == "02/2024"
    for r in rows:
        assert r.total == sum(v[7].strftime("%Y-%m") == r.month for v in valid(raw))


def test_top_hosts(log, raw):
    rows = D.top_high_risk_hosts(log).collect()
    assert {r.host for r in rows} == {"www.a.com", "b.com", "c.org"}
    hosts = {"www.a.com": 0, "b.com": 1, "c.org": 3}
    urls = ["https://WWW.A.com:8443/x", "http://u@b.com", "not a url", "https://c.org/?a=1"]
    for r in rows:
        own = [v for v in valid(raw) if v[1] == urls[hosts[r.host]] and v[2] >= 80]
        latest = max(own, key=lambda v: (v[7], v[0]))
        assert (r.detectionCount, r.latestRiskScore) == (len(own), latest[2])
    assert [r["count"] for r in D.abused_domain_counts(log).collect()] == sorted((r.detectionCount for r in rows), reverse=True)


def test_trend_and_history(log, raw):
    days = D.daily_risk_trend(log).collect()
    assert len(days) == 7 and days == sorted(days, key=lambda r: r.date)
    history = D.recent_history(log).groupBy("userId").count().collect()
    assert {r["count"] for r in history} == {5}
    plan = D.recent_history(log)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sketch_and_exact_users_agree(log):
    now = F.lit("2024-02-01").cast("timestamp")
    assert D.global_statistics(log, now).first() == D.global_statistics(log, now, exact_users=False).first()


def test_global_statistics_is_one_scan_and_equals_its_parts(log):
    now = F.lit("2024-02-01").cast("timestamp")
    row = D.global_statistics(log, now).first()
    assert [m.asDict() for m in row.months] == [m.asDict() for m in sorted(D.monthly_stats(log, now).collect())]
    assert [h.asDict() for h in row.hosts] == [h.asDict() for h in D.top_high_risk_hosts(log).collect()]
    assert {b: row[b] for b in ("trusted", "lowRisk", "suspicious", "highRisk")} == {r.band: r.n for r in D.risk_band_counts(log).collect()}
    basic = D.basic_statistics(log).first().asDict()
    assert basic == {k: row[k] for k in basic}
    written = materialize(log, "log")
    plan = D.global_statistics(written, now)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan and "WindowGroupLimit" in plan


def test_merge_touches_only_its_months(spark, log, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = D.valid_detections(log).withColumn("version", F.lit(1))
    SD.append_detections(rows, path)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "log").glob("month=*/*.parquet")}
    before = files()
    fixes = rows.filter("timestamp >= '2024-01-01' AND timestamp < '2024-02-01' AND riskScore > 50").withColumns(
        {"riskScore": F.lit(1), "version": F.lit(2)})
    stale = rows.filter("timestamp >= '2023-12-01' AND timestamp < '2024-01-01'").withColumns({"riskScore": F.lit(7), "version": F.lit(0)})
    SD.merge_detections(fixes.unionByName(stale), path, "version")
    after = files()
    assert {p for p in before if before[p] != after.get(p)} == {p for p in before if p.parent.name in ("month=2023-12", "month=2024-01")}
    got = {r.id: (r.riskScore, r.version) for r in SD.read_detections(spark, path).collect()}
    fixed = {r.id for r in fixes.collect()}
    assert fixed and got == {r.id: (1, 2) if r.id in fixed else (r.riskScore, 1) for r in rows.collect()}
    SD.merge_detections(fixes.unionByName(stale), path, "version")
    assert got == {r.id: (r.riskScore, r.version) for r in SD.read_detections(spark, path).collect()}
    SD.merge_detections(rows.limit(0), path, "version")
    assert len(got) == SD.read_detections(spark, path).count() == rows.count()


def test_key_operations(spark, log):
    keys = log.limit(20).select("id")
    found, rest = SD.lookup_by_keys(log, keys), SD.remove_by_keys(log, keys)
    assert found.count() == 20 and rest.count() == 580
    assert SD.lookup_by_keys(log, keys.limit(0)).count() == 0
    cases = SD.export_cases(log, keys)
    assert not {"id", "userId", "userEmail"} & set(cases.columns)
    assert SD.export_header(cases, F.lit("2024")).first().totalCases == 20


def test_score_validation(spark):
    rows = spark.createDataFrame([("5",), ("101",), ("-1",), ("x",), (None,), ("NaN",)], "risk_score string")
    assert [r.valid for r in SD.validate_scores(rows).collect()] == [True, False, False, False, False, False]


def test_auc_and_metrics_equal_plain_counting(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 1), rng.randint(0, 1), float(rng.randint(0, 30))) for _ in range(500)]
    rows = spark.createDataFrame(data, "label int, prediction int, score double")
    pos, neg = [d[2] for d in data if d[0]], [d[2] for d in data if not d[0]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(rows).first().roc_auc == pytest.approx(want, abs=5e-5)
    got = E.classification_metrics(rows).first()
    assert got.tn + got.fp + got.fn + got.tp == 500
    assert got.accuracy == pytest.approx(sum(d[0] == d[1] for d in data) / 500, abs=5e-5)
    with pytest.raises(ValueError):
        E.require_quality(E.quality_gate(E.classification_metrics(rows), spark.sql("SELECT 1.0 AS pass_rate")))


def test_a_merge_sorts_no_whole_file(spark, tmp_path):
    """Records are dealt by key before any of them is sorted, so a task's memory does not grow with a file."""
    spark.range(100).selectExpr("cast(id as string) AS id", "id AS v", "id % 3 AS x").write.parquet(f"{tmp_path}/log")
    plan = newest(spark.read.parquet(f"{tmp_path}/log"), "id", F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Exchange" in plan and "Aggregate" not in plan[plan.index("Exchange"):]
