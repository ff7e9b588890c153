import pytest
from pyspark.sql import functions as F

from urlrisk.functions.text import values
from urlrisk.operators import evaluation as E
from urlrisk.operators import features as FT
from urlrisk.operators import training as TR
from urlrisk.plans.score import score_urls
from urlrisk.plans.train import generated_cases, named_cases, train


def test_generated_cases(spark):
    rows = generated_cases(spark)
    counts = {r.label: r["count"] for r in rows.distinct().groupBy("label").count().collect()}
    # 34 trusted domains in four forms and 17 further URLs.  Phishing: 20 brands * 12 terms * 4,
    # 22 tokens * (7 + 14 * 4), 16 look-alikes * 3, 14 shorteners * 13 paths * 6, 5 blocks * 3, 45 further URLs.
    assert counts[0] == 34 * 4 + 17
    assert rows.filter("label = 1").count() == 960 + 22 * 63 + 48 + 14 * 13 * 6 + 15 + 45
    assert counts[1] == 3483


@pytest.fixture(scope="module")
def trained(spark, registry):
    base = spark.range(300).select(
        F.format_string("https://site%d.example.org/page/%d", "id", "id").alias("url"), F.lit(0).alias("label"),
        F.lit("base").alias("source"), F.lit(1.0).alias("sample_weight"))
    return train(base, registry, trees=20, depth=10)


def test_training_reaches_the_target(trained):
    metrics = trained.metrics.first()
    assert metrics.accuracy > 0.95 and metrics.roc_auc > 0.95
    passed = trained.cases.filter("pass").count() / trained.cases.count()
    assert passed >= 0.8
    lines = [r.line for r in trained.report.collect()]
    assert any(line.startswith("PASS | official_google") for line in lines) and any("source base" in x for x in lines)


def test_model_scores_flow_into_the_risk_score(spark, registry, trained):
    cases = named_cases(spark)
    votes = TR.batch_predict(trained.model, FT.features_22(cases, registry))
    urls = cases.join(votes.select("name", "raw_probability", "confidence"), "name")
    rows = score_urls(urls, registry, modelled=True).collect()
    assert len(rows) == cases.count()
    assert all((r.risk_score >= 45) == bool(r.expected) for r in rows)


def test_rules_alone_pass_the_named_cases(spark, registry):
    rows = score_urls(named_cases(spark), registry).withColumn("probability", F.col("risk_score") / 100)
    assert E.regression_pass_rate(rows, 0.45).first().pass_rate == 1.0


def test_ngram_vectors_are_normalised(spark):
    from pyspark.ml.functions import vector_to_array

    urls = values(spark, {"url": "string"}, [("https://a.b/login",), ("http://x.y",)])
    vectors = FT.hashed_ngrams(urls, char_bits=10, word_bits=8).select(vector_to_array("features").alias("v")).collect()
    for r in vectors:
        chars, words = r.v[:1024], r.v[1024:1280]
        assert sum(x * x for x in chars) == pytest.approx(1) and sum(x * x for x in words) == pytest.approx(1)
        assert len(r.v) == 1024 + 256 + 30


def test_short_vector(spark):
    row = FT.features_5(values(spark, {"url": "string"}, [("HTTPS://a-b.c/Login?verify",)])).first()
    assert (row.url_length, row.uses_https, row.dot_count, row.hyphen_count, row.keyword_count) == (26, 1, 1, 1, 2)
