"""The whole training job: labelled tables in, model and evaluation out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk import constants as C
from urlrisk import training_values as V
from urlrisk.functions.text import values
from urlrisk.operators import evaluation as E
from urlrisk.operators import training as TR
from urlrisk.operators.features import features_22
from urlrisk.session import materialize
from urlrisk.sources import labelled as SL
from urlrisk.sources.registry import Registry

c = F.col


def generated_cases(spark: SparkSession) -> DataFrame:
    """Training rows generated from the fixed names and templates."""
    def words(name: str, rows) -> DataFrame:
        return values(spark, {name: "string"}, [(w,) for w in rows])

    tokens = [(brand, token) for brand, text in V.LOOKALIKE_TOKENS.items() for token in text.split()]
    made = TR.augment_cases(
        words("domain", V.SAFE_DOMAINS), words("brand", V.PHISHING_BRANDS),
        values(spark, {"brand": "string", "token": "string"}, tokens), words("fake", V.LOOKALIKE_NAMES),
        words("path", V.LURE_PATHS),
        values(spark, {"block": "string", "idx": "int"}, list(zip(V.IP_BLOCKS, range(len(V.IP_BLOCKS))))))
    return (made.unionByName(TR.labelled_rows(words("url", V.SAFE_URLS), 0, TR.SAFE_WEIGHT))
            .unionByName(TR.labelled_rows(words("url", V.PHISHING_URLS), 1, TR.PHISHING_WEIGHT)))


def named_cases(spark: SparkSession) -> DataFrame:
    return values(spark, {"name": "string", "url": "string", "expected": "int"}, list(V.REGRESSION_CASES))


@dataclass
class Trained:
    """A fitted model with its one-row evaluation tables and its report lines."""

    model: object
    metrics: DataFrame
    cases: DataFrame
    gate: DataFrame
    report: DataFrame


def train(base: DataFrame, registry: Registry, regression: DataFrame | None = None,
          trees: int = 180, depth: int = 24) -> Trained:
    """Union, duplicate removal, features, stratified split, weighted forest, holdout and named cases.

    ``base`` and ``regression`` have (url, label, source, sample_weight); later
    sources win over earlier ones.
    """
    spark = base.sparkSession
    tables = [base, generated_cases(spark)] + ([regression] if regression is not None else [])
    rows = SL.dedupe_keep_last(SL.union_sources(*tables))
    # Written once: the table feeds the split, the fit, and the distributions.
    featured = materialize(features_22(rows, registry), "training")
    parts = SL.stratified_split(featured)
    model = TR.train_tree_ensemble(E.class_weights(parts.filter("NOT is_test")), C.MODEL_FEATURES, trees, depth)
    tested = TR.batch_predict(model, parts.filter("is_test"))
    tested = materialize(tested.select("label", "prediction", c("raw_probability").alias("score")), "holdout")
    metrics = E.classification_metrics(tested).withColumn("roc_auc", E.roc_auc(tested).scalar())
    asked = features_22(named_cases(spark), registry)
    cases = materialize(E.regression_results(
        TR.batch_predict(model, asked).select("name", "url", "expected", c("raw_probability").alias("probability"))), "cases")
    gate = E.quality_gate(metrics, E.regression_pass_rate(cases))
    report = SL.report_lines(metrics, E.label_distribution(featured), E.source_distribution(featured), cases)
    return Trained(model, metrics, cases, gate, report)
