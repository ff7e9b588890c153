"""Models grown and fitted on Spark beside plain versions with the same draws."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from urlrisk.operators import evaluation as E
from urlrisk.operators import extra_trees, sgd
from urlrisk.operators import training as TR
from urlrisk.operators.extra_trees import bagged, fit
from urlrisk.streaming import jobs as ST

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        a, b = rng.randint(0, 9), rng.random() * 4
        rows.append((i, float(a), b, 1.0, float(rng.randint(0, 1)), int(a + b * 2 + rng.random() > 8), rng.choice([0.5, 1.0, 3.0])))
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, label int, weight double")


def draw(what, *parts, seed=42):
    return zlib.crc32(":".join([f"{seed}{what}", *map(str, parts)]).encode()) / (1 << 32)


def plain_tree(tree, rows, depth, least, many):
    """Nodes of one tree by recursion; rows are (label, w, x)."""
    nodes = {}

    def grow(node, own, level):
        w = [sum(r[1] for r in own if r[0] == k) for k in (0, 1)]
        nodes[node] = (None, None, len(own), *w)
        if level == depth or len(own) < 2 * least or not all(w):
            return
        order = sorted((draw("feature", tree, node, i), i) for i in range(len(NAMES))
                       if min(r[2][i] for r in own) < max(r[2][i] for r in own))
        best = None
        for rank, (_, i) in enumerate(order[:many]):
            low, high = min(r[2][i] for r in own), max(r[2][i] for r in own)
            cut = low + (high - low) * draw("cut", tree, node, i)
            left = [r for r in own if r[2][i] <= cut]
            right = [r for r in own if r[2][i] > cut]
            if len(left) < least or len(right) < least:
                continue
            squares = lambda part: sum(sum(r[1] for r in part if r[0] == k) ** 2 for k in (0, 1)) / sum(r[1] for r in part)
            gain = squares(left) + squares(right) - squares(own)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, i, cut, left, right)
        if best:
            nodes[node] = (best[1], best[2], len(own), *w)
            grow(2 * node, best[3], level + 1)
            grow(2 * node + 1, best[4], level + 1)

    grow(1, rows, 0)
    return nodes


def vote(nodes, x):
    node = 1
    while nodes[node][0] is not None:
        node = 2 * node + (not x[nodes[node][0]] <= nodes[node][1])
    return nodes[node][4] / (nodes[node][3] + nodes[node][4])


@pytest.mark.parametrize("depth,least", [(24, 2), (3, 5)])
def test_trees_equal_a_plain_version(spark, points, depth, least):
    model = fit(points, NAMES, "id", trees=12, depth=depth, least=least)
    drawn = defaultdict(list)
    for r in bagged(points, NAMES, "id", 12, 0.75, 42, "label", "weight").collect():
        drawn[r.tree].append((r.label, r.w, list(r.x)))
    want = {t: plain_tree(t, rows, depth, least, 2) for t, rows in drawn.items()}
    got = {(r.tree, r.node): (r.feature, r.cut, r.n, r.w0, r.w1) for r in model.nodes.collect()}
    assert set(got) == {(t, n) for t, nodes in want.items() for n in nodes}
    for (t, n), row in got.items():
        assert (row[0], *row[2:]) == (want[t][n][0], *want[t][n][2:])
        assert row[1] is None or row[1] == pytest.approx(want[t][n][1], abs=1e-12)
    rows = model.votes(points).collect()
    for r in rows:
        assert r.raw_probability == pytest.approx(np.mean([vote(want[t], [r.a, r.b, r.c, r.d]) for t in want]), abs=1e-12)
    gains = defaultdict(float)
    for t, nodes in want.items():
        per = defaultdict(float)
        for n, (f, _, _, w0, w1) in nodes.items():
            if f is not None:
                left, right = nodes[2 * n], nodes[2 * n + 1]
                square = lambda a, b: (a * a + b * b) / (a + b)
                per[f] += square(*left[3:]) + square(*right[3:]) - square(w0, w1)
        for f, g in per.items():
            gains[f] += g / sum(per.values()) / len(want)
    shares = {r.position: r.importance for r in model.importances().collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares[2] == 0
    assert all(shares[i] == pytest.approx(gains[i], abs=1e-9) for i in range(4))


def test_trees_do_not_depend_on_partitions(points, monkeypatch):
    one = fit(points.coalesce(1), NAMES, "id", trees=5)
    other = fit(points.repartition(7), NAMES, "id", trees=5)
    assert sorted(one.nodes.collect(), key=str) == sorted(other.nodes.collect(), key=str)
    whole = sorted(one.votes(points).select("id", "raw_probability").collect())
    monkeypatch.setattr(extra_trees, "PASS_NODES", 1)          # a pass per tree
    assert len(one._groups()) == 5
    parts = sorted(one.votes(points).select("id", "raw_probability").collect())
    assert [r.id for r in whole] == [r.id for r in parts]
    assert [r.raw_probability for r in whole] == pytest.approx([r.raw_probability for r in parts])


def test_awkward_training_tables(spark, points):
    assert fit(points.limit(0), NAMES, "id", trees=3).nodes.count() == 0
    single = fit(points.filter("label = 1"), NAMES, "id", trees=3)
    assert {r.raw_probability for r in single.votes(points).collect()} == {1.0}
    same = points.withColumns({n: F.lit(1.0) for n in NAMES})
    assert fit(same, NAMES, "id", trees=3).nodes.filter("feature IS NOT NULL").count() == 0


def test_audit_follows_the_model(spark, points):
    model = TR.train_tree_ensemble(points, NAMES, trees=6, key="id")
    arrays = points.select("id", F.array(*NAMES).alias("features"))
    rows = E.feature_audit(arrays, NAMES, model, "id").collect()
    shares = {r.feature: r.importance for r in model.importances().collect()}
    assert len(rows) == 4 * points.count() and all(r.importance == pytest.approx(shares[r.feature], abs=1e-8) for r in rows)
    for wrong in (NAMES[:3], NAMES[::-1]):
        with pytest.raises(ValueError):
            E.feature_audit(arrays, wrong, model, "id")
    forest = TR.train_random_forest(points, NAMES, trees=3, depth=3)
    own = E.feature_audit(arrays, NAMES, forest, "id").filter("id = 0").orderBy("position").collect()
    assert [r.importance for r in own] == pytest.approx(list(forest.featureImportances.toArray()), abs=1e-8)
    assert {r.importance for r in E.feature_audit(arrays, NAMES, None, "id").collect()} == {None}


# --- incremental gradients ---------------------------------------------------

SIZE = 40


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        places = sorted(rng.sample(range(SIZE), 5))
        values = [rng.random() for _ in places]
        label = int(sum(v for p, v in zip(places, values) if p < 15) > 0.9)
        rows.append((f"u{i}", Vectors.sparse(SIZE, places, values), label, rng.choice([1.0, 2.0]), i % 3))
    return spark.createDataFrame(rows, ["url", "features", "label", "sample_weight", "part"])


def plain_rounds(rounds, settings):
    """One row after the other, the averages as plain means of the weights after each step."""
    w, average, done = np.zeros(SIZE + 1), np.zeros(SIZE + 1), 0
    for rows in rounds:
        total, rates, offset = np.zeros(SIZE + 1), 0.0, settings.first_step() - 1 + done
        for t, (x, label, weight) in enumerate(rows, 1):
            rate = 1 / (settings.alpha * (offset + t))
            slope = (1 / (1 + math.exp(-(w[:SIZE] @ x + w[SIZE]))) - label) * weight * rate
            w[:SIZE] -= slope * x
            w[SIZE] -= slope * 0.01
            total += w
            rates += rate
        n = len(rows)
        rate = rates
        average = (average * done + total) / (done + n)
        body = w[:SIZE]
        ridge, lasso = rate * settings.alpha * (1 - settings.l1_ratio), rate * settings.alpha * settings.l1_ratio
        w[:SIZE] = np.sign(body) * np.maximum(np.abs(body) / (1 + ridge) - lasso, 0)
        done += n
    return w, average, done


@pytest.mark.parametrize("alpha", [1.5e-6, 1e-2])
def test_rounds_equal_plain_steps(spark, vectors, alpha):
    settings = sgd.Settings(SIZE, alpha)
    batches = [vectors.filter(F.col("part") == p) for p in range(3)]
    model = sgd.fit(batches, settings)
    ordered = [[(r.features.toArray(), r.label, r.sample_weight) for r in b.orderBy(F.xxhash64("url")).collect()] for b in batches]
    w, average, steps = plain_rounds(ordered, settings)
    assert model.steps == steps == 240
    assert model.vector("weight") == pytest.approx(w, rel=1e-9, abs=1e-9)
    assert model.vector() == pytest.approx(average, rel=1e-9, abs=1e-9)
    for r in model.votes(vectors).collect():
        assert r.raw_probability == pytest.approx(1 / (1 + math.exp(-(average[:SIZE] @ r.features.toArray() + average[SIZE]))), abs=1e-9)


def test_learning_goes_on(spark, vectors):
    """Two batches, one after the other from a stored state, are one run over both."""
    settings = sgd.Settings(SIZE)
    batches = [vectors.filter(F.col("part") == p) for p in (0, 1)]
    first = sgd.fit(batches[:1], settings)
    again = sgd.load(spark, settings, first.path)
    later, once = sgd.fit(batches[1:], settings, again), sgd.fit(batches, settings)
    assert later.steps == once.steps and later.vector() == pytest.approx(once.vector())
    assert sgd.fit([vectors.limit(0)], settings, first).vector() == pytest.approx(first.vector())


def test_parts_are_averaged(spark, vectors):
    """Parts by hash, so partitions change nothing; the mean of parts still learns."""
    settings = sgd.Settings(SIZE)
    models = [sgd.fit([rows], settings, part_rows=50) for rows in (vectors.coalesce(1), vectors.repartition(6))]
    assert models[0].vector() == pytest.approx(models[1].vector()) and 30 < models[0].steps < 80
    rows = TR.batch_predict(models[0], vectors).collect()
    assert sum(r.prediction == r.label for r in rows) > 0.75 * len(rows)


def test_stream_learns_batch_by_batch_and_restarts(spark, vectors, tmp_path):
    settings, folder = sgd.Settings(SIZE), f"file://{tmp_path}/model"
    source = str(tmp_path / "rows.parquet")
    plain = vectors.select("url", "label", "sample_weight", "part")
    read = lambda rows: rows.join(vectors.select("url", "features"), "url")
    plain.filter("part = 0").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: ST.read_stream(spark, source, plain.schema, 1)
    ST.stream_mini_batch_fit(stream(), read, settings, folder)
    plain.filter("part = 1").coalesce(1).write.mode("append").parquet(source)
    model = ST.stream_mini_batch_fit(stream(), read, settings, folder)
    once = sgd.fit([vectors.filter(F.col("part") == p) for p in (0, 1)], settings)
    assert model.steps == once.steps == 160 and model.vector() == pytest.approx(once.vector())
