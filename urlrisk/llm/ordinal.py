"""Cumulative-link ordinal regression on hashed text features.

P(grade > k) = sigmoid(x . w - t_k): one weight vector for all grades and ordered
thresholds t_0 < t_1 < ...  A bounded sample of labelled rows is hashed once and
written.  Each feature is first tested against the model without weights; the
penalty on its weight falls with the excess of its z-score, and features below
are left out, so that a few rare telling words outweigh thousands of others.
Every step of the fit sums loss and gradient over the partitions, and only those
sums reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import Memo, list_rows, lists, map_arrow, materialize, word_lists

_EDGE = b"\"'.,;:!?()[]{}<>|*#$%&-_=+~`\\/"
#: Classes of bytes for the shape of a word: capitals, small letters and beyond ASCII, digits; the rest stands for itself.
_SHAPE = bytes(ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i >= 128 else ord("0") if 48 <= i <= 57 else i
               for i in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_FIT_PARTS = 8


def _bucket(name: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(name) >> (64 - bits)


class WordFeatures:
    """Which words a text has: each distinct word and its beginnings of 4 and 5 bytes, without marks around it."""

    def __init__(self, bits: int = 18):
        self.bits = bits
        self.memo = Memo(self._of_word)

    def _of_word(self, word: bytes) -> tuple[int, ...]:
        word = word.strip(_EDGE)
        return tuple({_bucket(word, self.bits), *(_bucket(word[:n] + b"-", self.bits) for n in (4, 5) if len(word) >= n)})

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found: set[int] = set()
        for words in word_lists(text):
            for buckets in map(self.memo.__getitem__, set(words)):
                found.update(buckets)
        index = np.fromiter(found, np.int32, len(found))
        index.sort()
        return index, np.ones(len(index), np.float32)


class ShapeFeatures:
    """How a text is written: shares of word shapes and of pairs of them, of repeats and of words met before."""

    def __init__(self, bits: int = 18):
        self.bits = bits
        self.shapes = Memo(self._shape)
        self.bucket = Memo(lambda name: _bucket(name, bits))

    def _shape(self, word: bytes) -> bytes:
        return _RUNS.sub(rb"\1", word.translate(_SHAPE))[:12]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.array([_bucket(b"\0empty", self.bits)], np.int32), np.ones(1, np.float32)
        shapes = list(map(self.shapes.__getitem__, words))
        counts = Counter(shapes)
        pairs = Counter(zip(shapes, shapes[1:]))
        found: dict[int, float] = {}
        for name, count in counts.items():
            found[self.bucket[name]] = found.get(self.bucket[name], 0.0) + count / len(words)
        for (a, b), count in pairs.items():
            bucket = self.bucket[a + b" " + b]
            found[bucket] = found.get(bucket, 0.0) + count / len(words)
        same = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        told = 1 - len(set(words)) / len(words)
        for name, share in ((b"\0same", same), (b"\0told", told)):
            found[_bucket(name, self.bits)] = share
            found[_bucket(name + b"%d" % int(share * 10), self.bits)] = 1.0
        index = np.array(sorted(found), np.int32)
        return index, np.sqrt(np.array([found[i] for i in index.tolist()], np.float32))


@dataclass(frozen=True)
class Model:
    """Weights by bucket, and the thresholds between grades 0, 1, 2, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        score = float(self.weights[index] @ value)
        return 1 / (1 + np.exp(-np.clip(score - self.thresholds, -500, 500)))


def _loss(model_weights: np.ndarray, free: np.ndarray, rows, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood and its gradient for the weights and the free parameters of the thresholds.

    t_0 = free_0 and each further threshold lies exp(free_k) above the one before.
    """
    thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    index, value, start = rows
    at = np.repeat(np.arange(len(grades)), np.diff(start))
    scores = np.bincount(at, model_weights[index] * value, minlength=len(grades))
    low, high = edges[grades] - scores, edges[grades + 1] - scores
    below, above = (1 / (1 + np.exp(-np.clip(x, -500, 500))) for x in (low, high))
    chance = np.maximum(above - below, 1e-12)
    slope_low, slope_high = below * (1 - below) / chance, above * (1 - above) / chance
    by_score = slope_high - slope_low  # derivative of the loss by the score
    weights = np.bincount(index, by_score[at] * value, minlength=len(model_weights))
    by_edge = np.bincount(grades, slope_low, minlength=len(edges)) - np.bincount(grades + 1, slope_high, minlength=len(edges))
    by_threshold = by_edge[1:-1]
    tail = np.cumsum(by_threshold[::-1])[::-1]
    return float(-np.log(chance).sum()), weights, np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])


def _minimise(function: Callable, start: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """L-BFGS with a halving line search."""
    x = start
    value, slope = function(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, used = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ way) / (s @ y)
            way -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        size, down = 1.0, float(slope @ way)
        if down < 1e-9:
            break
        for _ in range(12):
            after, after_slope = function(x - size * way)
            if after <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = -size * way, after_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - after < 1e-5 * max(1.0, abs(after))
        x, value, slope = x + s, after, after_slope
        if done:
            break
    return x


def sample(labelled: DataFrame, limit: int, key: str) -> DataFrame:
    """At most ``limit`` labelled rows, the same for the same rows: those whose hashed keys are smallest."""
    return labelled.orderBy(F.xxhash64(key), key).limit(limit)


def fit(labelled: DataFrame, features: Callable[[], Callable], grade: str = "grade", text: str = "text", bits: int = 18,
        penalty: float = 0.3, steps: int = 40, unlabelled: int = 0) -> Model:
    """Fit on rows of text and grade 0, 1, 2, ...; rows without a grade take no part.

    ``labelled`` must be bounded (see ``sample``).  A grade that no row has is
    passed over: its threshold lies where the next lower one does.  With one grade
    alone, every text is of that grade; with no labelled row, of grade ``unlabelled``.
    """
    spark = labelled.sparkSession

    def hashed(batches):
        extract = features()
        for batch in batches:
            found = [extract(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), lists([i for i, _ in found], pa.int32()),
                 lists([v for _, v in found], pa.float32())], ["grade", "index", "value"])

    rows = (labelled.where(F.col(grade).isNotNull()).select(F.col(grade).cast("int").alias("grade"), text)
            .repartition(_FIT_PARTS).mapInArrow(hashed, "grade int, index array<int>, value array<float>"))
    rows = materialize(rows, "features")
    counted = {r[0]: r[1] for r in rows.groupBy("grade").count().collect()}
    present = sorted(counted)
    if len(present) < 2:
        only = present[0] if present else unlabelled
        return Model(np.zeros(1 << bits), np.where(np.arange(max(1, only)) < only, -20.0, 20.0))
    place = np.zeros(present[-1] + 1, np.int64)
    place[present] = np.arange(len(present))

    def summed(table: DataFrame, x: np.ndarray, size: int, squares: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, slope and, if asked for, the sum of squares of every feature over all rows."""
        shared = spark.sparkContext.broadcast(x)

        def part(batches):
            loss, slope, square = 0.0, np.zeros(len(shared.value)), np.zeros(size if squares else 0)
            for batch in batches:
                index, value = list_rows(batch.column("index")), list_rows(batch.column("value"))
                if not index:
                    continue
                start = np.concatenate([[0], np.cumsum([len(i) for i in index])])
                index, value = np.concatenate(index), np.concatenate(value)
                more, weights, edges = _loss(shared.value[:size], shared.value[size:], (index, value, start),
                                             place[batch.column("grade").to_numpy()])
                loss += more
                slope[:size] += weights
                slope[size:] += edges
                if squares:
                    square += np.bincount(index, value.astype(float) ** 2, minlength=size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([slope.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())],
                ["loss", "slope", "square"])

        # One row of a fixed size per partition, and a fixed number of partitions.
        sums = table.mapInArrow(part, "loss double, slope binary, square binary").collect()
        shared.destroy()
        return (sum(r["loss"] for r in sums), np.sum([np.frombuffer(r["slope"]) for r in sums], axis=0),
                np.sum([np.frombuffer(r["square"]) for r in sums], axis=0))

    # The model without weights: thresholds from the shares of the grades, and the score test of every feature.
    all_ = 1 << bits
    counts = np.array([counted[g] for g in present], float)
    above = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    thresholds = np.log((1 - above) / above)
    free = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-6))])
    one = np.array([0, 1])
    residuals = np.array([_loss(np.zeros(1), free, (np.zeros(1, int), np.ones(1), one), np.array([g]))[1][0]
                          for g in range(len(present))])
    spread = float((counts * residuals ** 2).sum() / counts.sum())
    _, slope, square = summed(rows, np.concatenate([np.zeros(all_), free]), all_, squares=True)
    scale = np.clip(np.abs(slope[:all_]) / np.sqrt(spread * square + 1e-9) - 2, 0, 10)
    kept = np.flatnonzero(scale)
    scale, size = scale[kept], len(kept)
    number = np.full(all_, -1, np.int32)
    number[kept] = np.arange(size)
    renumber = spark.sparkContext.broadcast(number)

    def narrowed(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [(renumber.value[i], v) for i, v in zip(list_rows(batch.column(1)), list_rows(batch.column(2)), strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), lists([i[i >= 0] for i, _ in pairs], pa.int32()),
             lists([v[i >= 0] for i, v in pairs], pa.float32())], ["grade", "index", "value"])

    few = materialize(map_arrow(rows, narrowed, "grade int, index array<int>, value array<float>"), "features")

    def value_and_slope(x: np.ndarray):
        loss, slope, _ = summed(few, np.concatenate([x[:size] * scale, x[size:]]), size)
        slope[:size] = slope[:size] * scale + penalty * x[:size]
        return loss + penalty / 2 * float(x[:size] @ x[:size]), slope

    x = _minimise(value_and_slope, np.concatenate([np.zeros(size), free]), steps)
    weights = np.zeros(all_)
    weights[kept] = x[:size] * scale
    free = x[size:]
    found = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    # Threshold k lies between grades k and k + 1, also where grades are passed over.
    thresholds = [found[np.searchsorted(present, k, "right") - 1] if k >= present[0] else -20.0 for k in range(present[-1])]
    return Model(weights, np.array(thresholds))


def score(docs: DataFrame, model: Model, features: Callable[[], Callable], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, expected double, tails array<double>): expected grade and P(grade > k) for k = 0, 1, ... of every text.

    Null and empty texts have the features of an empty text.  Every row stays,
    with repeated and null keys; an empty table gives an empty table; other
    columns are not read.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        extract, fitted = features(), shared.value
        for batch in batches:
            tails = [fitted.tails(*extract(v.as_py())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()), lists(tails, pa.float64())],
                [key, "expected", "tails"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, expected double, tails array<double>")


def keep(docs: DataFrame, model: Model, features: Callable[[], Callable], above: int, least: float,
         text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose P(grade > above) is at least ``least``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        extract, fitted = features(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([fitted.tails(*extract(v.as_py()))[above] >= least for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
