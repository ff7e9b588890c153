"""Incremental averaged logistic regression over sparse vectors, by stochastic gradients.

A model is a written table of weights and of their averages over all steps.  A
round reads it, deals the new rows to parts by hash, lets each part take one
step per row from the same start, adds up the parts' changes weighted by their rows,
applies the elastic-net proximal step once for the step sizes used, and writes
the next table.  Learning goes on from round to round; rows of earlier rounds are
never read again, and a repeated round replaces itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.session import drop_shared, materialize, scratch, shared_path

c = F.col
#: Rows that one part steps through; a round has as many parts as its rows fill.
PART_ROWS = 100_000
#: Sparse rows move the intercept by a hundredth of a step.
_INTERCEPT_RATE = 0.01
_ROWS, _RATES, _SQUARES = -1, -2, -3       # totals that travel with the changes of the weights
_STATE = "feature int, weight double, average double"


@dataclass(frozen=True)
class Settings:
    """``alpha`` scales the penalty and the step size, ``l1_ratio`` splits the penalty."""

    size: int
    alpha: float = 1.5e-6
    l1_ratio: float = 0.05

    def first_step(self) -> float:
        """Steps that count as done before the first: the first weight change is then of a typical weight's size."""
        typical = math.sqrt(1 / math.sqrt(self.alpha))
        return 1 / (self.alpha * typical / max(1.0, 1 / (1 + math.exp(-typical))))


class SgdModel:
    """The state after a round: ``state`` has (feature, weight, average) for all that is not 0; the intercept is feature ``size``."""

    def __init__(self, settings: Settings, path: str | None = None, steps: int = 0, state: DataFrame | None = None):
        self.settings, self.path, self.steps, self.state = settings, path, steps, state

    def vector(self, column: str = "average") -> np.ndarray:
        """The weights as one array, whose length ``settings.size`` bounds it."""
        out = np.zeros(self.settings.size + 1)
        if self.state is not None:
            table = self.state.select("feature", column).toArrow()
            out[table.column(0).to_numpy()] = table.column(1).to_numpy()
        return out

    def votes(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` with ``raw_probability`` of class 1 by the averaged weights; one narrow pass."""
        shared = rows.sparkSession.sparkContext.broadcast(self.vector())
        size = self.settings.size

        @F.pandas_udf("double")
        def probability(indices: pd.Series, values: pd.Series) -> pd.Series:
            w = shared.value
            margins = [w[size] + float(np.dot(w[i], v)) for i, v in zip(indices, values, strict=True)]
            return pd.Series(1 / (1 + np.exp(-np.clip(margins, -700, 700))), dtype="float64")

        return rows.withColumn("raw_probability", probability(*_sparse(features, size)))


def _sparse(features: str, size: int) -> list[Column]:
    """Indices and values of a vector column, dense ones included."""
    vector = F.unwrap_udt(features)
    everything = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    return [F.when(vector["type"] == 0, vector["indices"]).otherwise(everything), vector["values"]]


def load(spark: SparkSession, settings: Settings, path: str) -> SgdModel:
    """The model that a round has written to ``path``."""
    steps = spark.read.parquet(f"{path}/steps").first()[0]
    return SgdModel(settings, path, steps, spark.read.schema(_STATE).parquet(f"{path}/state"))


def _steps(start: np.ndarray, settings: Settings, before: int):
    """A function over Arrow batches of (part, label, weight, indices, values), sorted by part: the changes each part makes."""
    alpha, size, offset = settings.alpha, settings.size, settings.first_step() - 1 + before

    class Part:
        def __init__(self, number):
            self.number, self.w = number, start.copy()
            self.late = np.zeros(size + 1)       # sum of change * step, for the average
            self.touched = np.zeros(size + 1, bool)
            self.rows, self.rates = 0, 0.0

        def step(self, label, weight, indices, values):
            self.rows += 1
            rate = 1 / (alpha * (offset + self.rows))
            margin = min(max(self.w[size] + float(np.dot(self.w[indices], values)), -700.0), 700.0)
            slope = (1 / (1 + math.exp(-margin)) - label) * weight * rate
            change, at = -slope * values, self.rows - 1
            self.w[indices] += change
            self.late[indices] += change * at
            self.w[size] -= slope * _INTERCEPT_RATE
            self.late[size] -= slope * _INTERCEPT_RATE * at
            self.touched[indices] = True
            self.rates += rate

        def changes(self):
            self.touched[size] = True
            at = np.flatnonzero(self.touched)
            change = self.w[at] - start[at]
            mean = change - self.late[at] / self.rows          # of the weights after each step, less the start
            n = float(self.rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((at, [_ROWS, _RATES, _SQUARES])).astype(np.int32)),
                 pa.array(np.concatenate((change * n, [n, self.rates * n, n * n]))),
                 pa.array(np.concatenate((mean * n, [0.0, 0.0, 0.0])))], ["feature", "change", "mean"])

    def run(batches):
        part = None
        for batch in batches:
            numbers, labels, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            indices, values = batch.column(3), batch.column(4)
            for row in range(batch.num_rows):
                if part is None or numbers[row] != part.number:
                    if part is not None:
                        yield part.changes()
                    part = Part(numbers[row])
                part.step(labels[row], weights[row], indices[row].values.to_numpy(), values[row].values.to_numpy())
        if part is not None:
            yield part.changes()

    return run


def fit_round(model: SgdModel, rows: DataFrame, path: str, features: str = "features", label: str = "label",
              weight: str | None = "sample_weight", key: str = "url", part_rows: int = PART_ROWS) -> SgdModel:
    """One round over ``rows``, written to ``path``; the given model stays as it is.

    Rows with a null label or vector teach nothing.  A part takes its rows in the
    order of a hash of ``key``, so a round does not depend on partitions; without rows the
    state goes on unchanged.
    """
    with scratch(rows.sparkSession):
        return _round(model, rows, path, features, label, weight, key, part_rows)


def _round(model: SgdModel, rows: DataFrame, path: str, features: str, label: str, weight: str | None, key: str, part_rows: int) -> SgdModel:
    spark, settings = rows.sparkSession, model.settings
    indices, values = _sparse(features, settings.size)
    order = F.xxhash64(key)
    taught = materialize(rows.where(c(label).isNotNull() & c(features).isNotNull()).select(
        order.alias("order"), c(label).cast("double").alias("label"),
        (F.coalesce(c(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"),
        indices.alias("indices"), values.alias("values")), "round-rows")
    parts = max(1, -(-taught.count() // part_rows))
    ordered = (taught.withColumn("part", F.pmod("order", F.lit(parts))).repartition(parts, "part")
               .sortWithinPartitions("part", "order", "label", "w").select("part", "label", "w", "indices", "values"))
    shared = spark.sparkContext.broadcast(model.vector("weight"))
    before = model.steps

    def run(batches):
        yield from _steps(shared.value, settings, before)(batches)

    changes = materialize(ordered.mapInArrow(run, "feature int, change double, mean double")
                          .groupBy("feature").agg(F.sum("change").alias("change"), F.sum("mean").alias("mean")), "changes")
    totals = {r.feature: r.change for r in changes.where("feature < 0").collect()}
    n = totals.get(_ROWS, 0.0)
    steps = round(totals.get(_SQUARES, 0.0) / n) if n else 0
    spark.range(1).select(F.lit(before + steps).alias("steps")).write.mode("overwrite").parquet(f"{path}/steps")
    old = model.state if model.state is not None else spark.createDataFrame([], _STATE)
    share = 1 / n if n else 0.0
    both = old.join(changes.where("feature >= 0"), "feature", "full_outer").select(
        "feature", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("weight", "average", "change", "mean")])
    moved = c("weight") + c("change") * share
    rate = totals.get(_RATES, 0.0) * share
    ridge, lasso = rate * settings.alpha * (1 - settings.l1_ratio), rate * settings.alpha * settings.l1_ratio
    shrunk = F.signum(moved) * F.greatest(F.abs(moved) / (1 + ridge) - lasso, F.lit(0.0))
    penalised = F.when(c("feature") == settings.size, moved).otherwise(shrunk)
    average = c("average") if not steps else (
        c("average") * before + (c("weight") + c("mean") * share) * steps) / (before + steps)
    both.select("feature", penalised.alias("weight"), average.alias("average")).where(
        "weight <> 0 OR average <> 0").write.mode("overwrite").parquet(f"{path}/state")
    return load(spark, settings, path)


def fit(rounds: list[DataFrame], settings: Settings, start: SgdModel | None = None, **columns) -> SgdModel:
    """Rounds in their order, from ``start`` or from nothing."""
    model = start or SgdModel(settings)
    for rows in rounds:
        last = model
        model = fit_round(model, rows, shared_path(rows.sparkSession, "sgd"), **columns)
        if last.path and last is not start:
            drop_shared(rows.sparkSession, last.path)
    return model
