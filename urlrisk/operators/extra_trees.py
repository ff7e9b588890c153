"""Extremely randomised trees, grown level by level over a distributed table.

Each row of the open table is one training row in one tree at one node.  A level
takes two aggregations over (tree, node): the range of every feature, from which
a hash draws features and cut points, and the class weights left of each cut, from which the
best cut is taken.  Then every row moves to its child.  All draws come from hashes
of (seed, tree, node, feature) and of the row's key, and weights are summed as whole
numbers, so a model does not depend on partitions or retries.  Nothing passes the driver
but the number of open nodes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.session import drop_shared, shared_path

c = F.col
#: Weights are counted in units of 2^-20.
_UNIT = 1 << 20
#: Nodes that a prediction pass sends to the tasks, some 20 bytes each; more trees take more passes.
PASS_NODES = 4_000_000
_NODE = ("tree int, node bigint, feature int, cut double, n bigint, w0 bigint, w1 bigint, gain double")


@dataclass
class ExtraTrees:
    """A fitted model: a written table of nodes, the feature names in order, and the number of trees.

    ``nodes`` has a row per node: its rows and class weights, and for inner nodes
    the feature, the cut (rows up to it go to ``2 * node``, others to ``2 * node
    + 1``) and the weighted Gini decrease.  The root is node 1.
    """

    nodes: DataFrame
    names: list[str]
    trees: int

    def importances(self) -> DataFrame:
        """(position, feature, importance): Gini decrease per feature, normalised in each tree, averaged over the trees that split."""
        inner = self.nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        total = inner.groupBy("tree").agg(F.sum("gain").alias("total")).where("total > 0")
        shares = inner.join(total, "tree").select("tree", "feature", (c("gain") / c("total")).alias("share"))
        trees = shares.agg(F.count_distinct("tree")).scalar()
        mean = shares.groupBy(c("feature").alias("position")).agg((F.sum("share") / trees).alias("importance"))
        names = self.nodes.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, self.names))).alias("position", "feature"))
        return names.join(mean, "position", "left").select("position", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def _groups(self) -> list[tuple[int, int]]:
        """Ranges of trees with at most ``PASS_NODES`` nodes together, or one tree."""
        sizes = dict(self.nodes.groupBy("tree").count().collect())
        groups, start, held = [], 0, 0
        for tree in range(self.trees):
            if held and held + sizes.get(tree, 0) > PASS_NODES:
                groups.append((start, tree))
                start, held = tree, 0
            held += sizes.get(tree, 0)
        return [*groups, (start, self.trees)]

    def votes(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``raw_probability``: the mean over the trees of class 1's share of the weight in the leaf.

        A null feature counts as NaN and goes right.  One narrow pass per group of trees.
        """
        x = F.array(*[F.coalesce(c(n).cast("double"), F.lit(float("nan"))) for n in self.names])
        votes = sum((self._pass(first, last)(x) for first, last in self._groups()), F.lit(0.0))
        return rows.withColumn("raw_probability", votes / self.trees)

    def _pass(self, first: int, last: int):
        part = self.nodes.where(c("tree").between(first, last - 1)).sort("tree", "node")
        model = part.sparkSession.sparkContext.broadcast(_forest(part.select("tree", "node", "feature", "cut", "w0", "w1").toArrow()))

        @F.pandas_udf("double")
        def votes(x: pd.Series) -> pd.Series:
            return pd.Series(_walk(model.value, np.stack(x.to_list())) if len(x) else [], dtype="float64")

        return votes


def _forest(table: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """Per tree: feature (-1 in leaves), cut, place of the left and of the right child, share of class 1."""
    tree, node, cut, w0, w1 = (table.column(n).to_numpy() for n in ("tree", "node", "cut", "w0", "w1"))
    feature = table.column("feature").fill_null(-1).to_numpy()
    out = []
    for t in np.unique(tree):
        own = tree == t
        ids = node[own]                                   # in order
        left = np.searchsorted(ids, 2 * ids)
        total = (w0[own] + w1[own]).astype(float)
        share = np.divide(w1[own], total, out=np.full(len(total), 0.5), where=total > 0)
        out.append((feature[own].astype(np.int32), cut[own], left.astype(np.int32), share))
    return out


def _walk(forest: list, x: np.ndarray) -> np.ndarray:
    """Sum over the trees of the leaf's share for every row; a right child follows its left sibling in the table."""
    votes, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, cut, left, share in forest:
        at = np.zeros(len(x), np.int32)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = ~(x[rows, np.maximum(f, 0)] <= cut[at])
            at = np.where(inner, left[at] + right, at)
        votes += share[at]
    return votes


def _draw(what: str, feature: int, seed: int) -> str:
    """A number in [0, 1) for a feature of a node, from a hash."""
    return f"(crc32(concat_ws(':', '{seed}{what}', tree, node, {feature})) / {1 << 32}d)"


def bagged(rows: DataFrame, names: list[str], key: str, trees: int, sample: float, seed: int, label: str, weight: str) -> DataFrame:
    """(tree, node, label, w, x): every row in the trees that drew it, as often as a Poisson count by hash says.

    Drawing with replacement ``sample`` times the rows gives each row such a
    count; it multiplies the row's weight.
    """
    steps, chance, total = [], math.exp(-sample), 0.0
    for k in range(12):
        total += chance
        steps.append(total)
        chance *= sample / (k + 1)
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    base = rows.select(F.col(key).alias("_key"), c(label).cast("int").alias("label"), c(weight).cast("double").alias("_w"),
                       F.array(*[c(n).cast("double") for n in names]).alias("x"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "_key", "tree"), F.lit(1 << 40)) / float(1 << 40)
    count = F.expr(" + ".join(f"IF(_u >= {step!r}d, 1, 0)" for step in steps))
    return (base.select("*", tree).withColumn("_u", drawn).withColumn("_n", count).where("_n > 0")
            .select("tree", F.lit(1).cast("bigint").alias("node"), "label",
                    F.round(c("_w") * c("_n") * _UNIT).cast("bigint").alias("w"), "x"))


def candidates(open_rows: DataFrame, features: int, many: int, seed: int, least: int, last: bool) -> DataFrame:
    """Per open node its rows and weights, and up to ``many`` cuts (feature, cut) of features that vary in it.

    Features come in an order drawn by hash; constant ones are passed over.
    """
    ranges = [e for i in range(features) for e in (f"min(x[{i}]) AS lo{i}", f"max(x[{i}]) AS hi{i}")]
    nodes = open_rows.groupBy("tree", "node").agg(*map(F.expr, (
        "count(*) AS n", "sum(IF(label = 0, w, 0L)) AS w0", "sum(IF(label = 1, w, 0L)) AS w1", *ranges)))

    def cut(i: int) -> str:
        at = f"lo{i} + (hi{i} - lo{i}) * {_draw('cut', i, seed)}"
        return (f"IF(lo{i} < hi{i}, named_struct('u', {_draw('feature', i, seed)}, 'feature', {i}, "
                f"'cut', IF({at} >= hi{i}, lo{i}, {at})), NULL)")

    cuts = ", ".join(map(cut, range(features)))
    divisible = f"n >= {2 * least} AND w0 > 0 AND w1 > 0 AND {str(not last).lower()}"
    return nodes.selectExpr("tree", "node", "n", "w0", "w1",
                            f"slice(array_sort(array_compact(array({cuts}))), 1, IF({divisible}, {many}, 0)) AS cuts")


def decided(open_rows: DataFrame, nodes: DataFrame, many: int, least: int) -> DataFrame:
    """Each node with its best cut, or none: rows of the model."""
    left = [f"x[get(cuts, {k}).feature] <= get(cuts, {k}).cut" for k in range(many)]
    sums = [e for k in range(many) for e in (
        f"count_if({left[k]}) AS n{k}", f"sum(IF({left[k]} AND label = 0, w, 0L)) AS a{k}",
        f"sum(IF({left[k]} AND label = 1, w, 0L)) AS b{k}")]
    sides = (open_rows.join(nodes.where("size(cuts) > 0").select("tree", "node", "cuts"), ["tree", "node"])
             .groupBy("tree", "node").agg(*map(F.expr, sums)))

    def squares(a: str, b: str) -> str:
        """Sum of the squared weights of both classes over their total."""
        return f"coalesce(try_divide(power(double({a}), 2) + power(double({b}), 2), double(({a}) + ({b}))), 0d)"

    def option(k: int) -> str:
        gain = f"({squares(f'a{k}', f'b{k}')} + {squares(f'w0 - a{k}', f'w1 - b{k}')} - {squares('w0', 'w1')}) / {_UNIT}"
        return (f"IF(n{k} >= {least} AND n - n{k} >= {least}, named_struct('gain', {gain}, 'rank', -{k}, "
                f"'feature', get(cuts, {k}).feature, 'cut', get(cuts, {k}).cut), NULL)")

    best = f"array_max(array_compact(array({', '.join(map(option, range(many)))}))) AS best"
    return nodes.join(sides, ["tree", "node"], "left").selectExpr("*", best).selectExpr(
        "tree", "node", "best.feature AS feature", "best.cut AS cut", "n", "w0", "w1", "greatest(best.gain, 0d) AS gain")


def fit(rows: DataFrame, names: list[str], key: str, trees: int = 180, depth: int = 24, least: int = 2, sample: float = 0.75,
        seed: int = 42, label: str = "label", weight: str = "weight") -> ExtraTrees:
    """Grow the trees on rows with a unique ``key``, labels 0 and 1 and a weight; √features are tried per node.

    A node is a leaf at ``depth``, with one class, with too few rows for two
    leaves of ``least``, or where no drawn cut leaves that many on both sides.
    Null features are not allowed; an empty table gives a model without nodes.
    """
    spark, many = rows.sparkSession, max(1, math.isqrt(len(names)))
    model, held = shared_path(spark, "extra-trees"), []

    def written(table: DataFrame, name: str) -> DataFrame:
        held.append(shared_path(spark, name))
        table.write.parquet(held[-1])
        return spark.read.schema(table.schema).parquet(held[-1])

    open_rows = written(bagged(rows, names, key, trees, sample, seed, label, weight), "open")
    for level in range(depth + 1):
        nodes = written(candidates(open_rows, len(names), many, seed, least, level == depth), "nodes")
        decided(open_rows, nodes, many, least).write.parquet(f"{model}/level={level}")
        split = spark.read.schema(_NODE).parquet(f"{model}/level={level}").where("feature IS NOT NULL").select("tree", "node", "feature", "cut")
        done = split.isEmpty()
        if not done:
            child = F.expr("2 * node + IF(x[feature] <= cut, 0, 1)").alias("node")
            open_rows = written(open_rows.join(split, ["tree", "node"]).select("tree", child, "label", "w", "x"), "open")
        # Only the rows of the next level are read again.
        while len(held) > (0 if done else 1):
            drop_shared(spark, held.pop(0))
        if done:
            break
    return ExtraTrees(spark.read.schema(_NODE + ", level int").parquet(model), list(names), trees)
