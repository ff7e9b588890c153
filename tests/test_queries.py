"""Registered queries beside their check SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, oracle_rows, spark_rows
from urlrisk.plans import registered

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")

NAMES = [
    "normalize_urls", "split_urls", "url_fingerprint", "features_30", "features_22", "lookalike_subdomain",
    "typo_ratio_match", "brand_like_token", "reputation_cascade", "score_urls", "override_chain", "explanations",
    "evidence_statements", "action_guidance", "append_detections", "export_cases", "global_statistics",
    "top_high_risk_hosts", "recent_history", "stratified_split", "augment_cases", "build_brand_terms", "stream_top_hosts",
    "load_domain_registry", "load_reputation_tables", "stream_dedupe", "hashed_ngrams",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert spark_rows(queries()[name](spark, SF)) == oracle_rows(con, oracle_sql()[name])


def test_hashed_models_ask_for_no_wide_features(spark, monkeypatch):
    """The hashed models read the URL alone, and learn from the rows that the wide models learn from."""
    names = ["url_id", "url", "label", "sample_weight"]
    wide = registered.training_rows(spark, SF).select(names).collect()
    monkeypatch.setattr(registered, "features", None)
    assert sorted(registered.training_urls(spark, SF).collect()) == sorted(wide)
    fitted = []
    monkeypatch.setattr(registered.TR, "train_hashed_logistic", lambda rows: fitted.append(rows.count()))
    monkeypatch.setattr(registered.TR, "batch_predict", lambda model, rows: rows)
    monkeypatch.setattr(registered, "_measured", lambda rows, **more: rows)
    with pytest.raises(AttributeError, match="settings"):
        registered.train_hashed_logistic(spark, SF)
    assert fitted == [len(wide)]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
