"""Label statistics, classification metrics and acceptance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.functions.text import values

c = F.col


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def source_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def pair_predictions(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return predictions.join(labels, key)


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    def cell(label, prediction):
        return F.count_if((c("label") == label) & (c("prediction") == prediction))

    return rows.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_metrics(rows: DataFrame) -> DataFrame:
    matrix = confusion_matrix(rows)
    tn, fp, fn, tp = c("tn"), c("fp"), c("fn"), c("tp")
    precision, recall = _rate(tp, tp + fp), _rate(tp, tp + fn)
    measures = {
        "accuracy": _rate(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (recall + _rate(tn, tn + fp)) / 2,
        "precision": precision,
        "recall": recall,
        "f1": _rate(tp * 2, tp * 2 + fp + fn),
    }
    return matrix.select("tn", "fp", "fn", "tp", *[F.bround(m, 4).alias(n) for n, m in measures.items()])


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by counting, exact under ties.

    Rows are reduced to one per distinct score before any ordering.  A score is
    then compared with the totals of the score ranges below it, so neither a
    global sort nor a single-task window over rows is needed.
    """
    per_score = rows.groupBy("score").agg(
        F.count_if(c("label") == 1).alias("pos"), F.count_if(c("label") == 0).alias("neg"))
    below = running_total(per_score, "score", "neg")
    pairs = F.sum(c("pos") * (c("below") + c("neg") / 2))
    return below.agg(F.bround(F.try_divide(pairs, F.sum("pos") * F.sum("neg")), 4).alias("roc_auc"))


def running_total(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Exclusive running total of ``value`` in ``order`` as column ``below``.

    Two levels: totals per value range are as few as shuffle partitions, the
    window inside a range is partitioned, and range totals come back by a small join.
    """
    from pyspark.sql.window import Window

    ranged = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    ranged = _fixed(ranged)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"), F.min(order).alias("_low"))
    # One row per range reaches this window.
    before = Window.partitionBy(F.lit(0)).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn("below", c("_in") + c("_offset")).drop("_in", "_offset", "_part")
    )


def _fixed(rows: DataFrame) -> DataFrame:
    """Write rows that carry a partition number, so that a retried task cannot renumber them."""
    from urlrisk.session import materialize

    return materialize(rows, "ranges")


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced class weight times sample weight: n / (classes * rows of the class).

    Labels are 0 and 1.  Two counts enter as scalar subqueries, so rows are not
    moved by a key that has two values.
    """
    counts = rows.agg(F.count_if(c("label") == 0).alias("zeros"), F.count_if(c("label") == 1).alias("ones"))
    zeros, ones = counts.select("zeros").scalar(), counts.select("ones").scalar()
    classes = F.when((zeros > 0) & (ones > 0), 2).otherwise(1)
    balanced = (zeros + ones) / (classes * F.when(c("label") == 0, zeros).otherwise(ones))
    return rows.withColumn("weight", balanced * c("sample_weight"))


def regression_results(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Named cases with a probability → predicted class and pass flag."""
    predicted = (c("probability") >= threshold).cast("int")
    return cases.withColumn("predicted", predicted).withColumn("pass", c("predicted") == c("expected"))


def regression_pass_rate(cases: DataFrame, threshold: float = 0.5) -> DataFrame:
    return regression_results(cases, threshold).agg(
        F.count("*").alias("cases"), F.count_if("pass").alias("passed"),
        F.bround(F.avg(c("pass").cast("double")), 4).alias("pass_rate"))


def quality_gate(metrics: DataFrame, pass_rate: DataFrame, minimum: float = 0.90) -> DataFrame:
    """One row: both measures and whether a model may be accepted."""
    return metrics.withColumn("pass_rate", pass_rate.select("pass_rate").scalar()).select(
        "accuracy", "pass_rate",
        ((c("accuracy") >= minimum) & (c("pass_rate") >= minimum)).alias("accepted"))


def require_quality(gate: DataFrame) -> None:
    row = gate.head()
    if row is None or not row["accepted"]:
        raise ValueError("the model did not reach the required validation target")


def evaluate_rules(scored: DataFrame, label: Column) -> DataFrame:
    """Metrics of the rules alone: the decision of scored URLs against their true label."""
    return classification_metrics(scored.select(label.alias("label"), "prediction"))


def importance_table(model, names: list[str], features: DataFrame) -> DataFrame:
    """(position, feature, importance) of a fitted model, which must have been fitted on these names.

    Extra-trees sum the Gini decrease of their node table; a Spark forest brings
    its own importances.  Another number of names than the model has inputs is
    an error, and so are other names where the model knows them.
    """
    known = getattr(model, "names", None)
    inputs = len(known) if known is not None else model.numFeatures
    if len(names) != inputs or (known is not None and list(known) != list(names)):
        raise ValueError(f"the model has {inputs} inputs, other than the {len(names)} features named")
    if known is not None:
        return model.importances()
    return values(features.sparkSession, {"position": "int", "feature": "string", "importance": "double"},
                  [(i, n, float(w)) for i, (n, w) in enumerate(zip(names, model.featureImportances.toArray(), strict=True))])


def feature_audit(features: DataFrame, names: list[str], model, *keys: str) -> DataFrame:
    """One row per URL and feature: value, importance in the model in use, and its percentage.

    ``features`` has an array column of that name; without a model importances are null.
    """
    if model is None:
        table = values(features.sparkSession, {"position": "int", "feature": "string", "importance": "double"},
                       [(i, n, None) for i, n in enumerate(names)])
    else:
        table = importance_table(model, names, features)
    # As many rows as features, so the optimizer broadcasts it by its size.
    long = features.select(*keys, F.posexplode("features").alias("position", "value"))
    return long.join(table, "position").select(
        *keys, "position", "feature", "value", F.bround("importance", 8).alias("importance"),
        F.bround(c("importance") * 100, 4).alias("importance_percent"))
