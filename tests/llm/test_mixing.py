"""Mixing beside its definition: targets by plain rounds, sums, bounds and expectations of the rounding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlrisk.llm import mixing, registered
from urlrisk.llm.mixing import meet, mix, ordered, targets, word_count

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Deal, cut what is above, deal the excess again among the rest, until none is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, target, active = share * sum(sizes.values()), {}, set(names)
    while active:
        level = left / sum(weight[k] for k in active)
        over = {k for k in active if level * weight[k] > most * sizes[k]}
        if not over:
            target |= {k: level * weight[k] for k in active}
            break
        target |= {k: float(most * sizes[k]) for k in over}
        left -= sum(target[k] for k in over)
        active -= over
    return target


def check(rows, docs):
    """Rows of ``mixed`` against documents (doc_id, source, text)."""
    size = lambda t: len((t or "").encode().split())
    sources = {}
    for _, source, text in docs:
        sources[source] = sources.get(source, 0) + size(text)
    target = plain_targets(sources)
    want = sorted((str(d), size(t), sources[s], round(target[s], 6)) for d, s, t in docs)
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in rows) == want
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken // max(r["size"], 1) == r.copies for r in rows if r["size"])
    by_target = {}
    for r in rows:
        key = (r.source_size, round(r.target, 6))
        by_target[key] = by_target.get(key, 0) + r.taken
    many = {}
    for s, n in sources.items():
        many[(n, round(target[s], 6))] = many.get((n, round(target[s], 6)), 0) + 1
    for key, taken in by_target.items():
        assert abs(taken - key[1] * many[key]) <= 0.5 * many[key] + 1e-6


def test_counts_words():
    for text in ("", " ", "a", " a", "a ", "a\x0bb\x0c c\r\nd", "é 東 x", "a" * 9 + "\t" * 9):
        assert word_count(text.encode()) == len(text.encode().split())
    assert word_count(None) == 0


def test_meetings_keep_mass_and_expectation():
    rng = np.random.default_rng(1)
    sizes, shares = np.array([900, 500, 40, 33, 7, 3, 1, 1]), np.array([0.3, 0.9, 0.5, 0.25, 0.6, 0.1, 0.8, 0.5])
    total = np.zeros(len(sizes))
    for _ in range(20_000):
        out, one = meet(sizes, shares, rng.random(len(sizes)))
        assert abs((out * sizes).sum() - (sizes * shares).sum()) < 1e-6
        assert sum(0 < x < 1 for x in out) == (one >= 0) and (out >= 0).all() and (out <= 1).all()
        total += out
    assert np.abs(total / 20_000 - shares).max() < 0.015


def test_given_documents(spark, documents):
    docs = [tuple(r) for r in documents.select("doc_id", "source", "text").collect()]
    rows = registered.op12_mixing(spark, SF).collect()
    check(rows, docs)
    again = mixing.mixed(documents.repartition(13)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("leaf", [2, 5])
def test_deep_trees(spark, monkeypatch, leaf):
    """Small leaves make several levels; a hot source and a hot repeated row among them."""
    monkeypatch.setattr(mixing, "LEAF", leaf)
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i * i % 37)) for i in range(150)] + [(7, "copy", "a b c")] * 60
    docs += [(None, None, None), (None, None, "x y"), (None, "", "z"), (1, "empty", ""), (2, "lone", "w " * 90)]
    table = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("size", F.lit("clash"))
    check(mixing.mixed(table).collect(), docs)


def test_targets_and_order(spark):
    sizes = {"b": 100, "a": 10, "é": 3, "Z": 1000, None: 50, "": 0, "東": 7}
    table = spark.createDataFrame(list(sizes.items()), "_source string, size bigint")
    rows = targets(ordered(table, "_source")).collect()
    assert {r._source: round(r.target, 9) for r in rows} == {k: round(v, 9) for k, v in plain_targets(sizes).items()}
    assert [r._source for r in sorted(rows, key=lambda r: r.source_no)] == ["", "Z", "a", "b", "é", "東", None]


def test_empty_and_odd(spark, odd):
    table = odd.withColumn("source", F.lit("s"))
    docs = [tuple(r) for r in table.select("doc_id", "source", "text").collect()]
    check(mixing.mixed(table).collect(), docs)
    assert mixing.mixed(table.limit(0)).count() == 0
    blank = mix(spark.createDataFrame([(1, "s", 0), (2, None, 0)], "_key bigint, _source string, size bigint")).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)]
