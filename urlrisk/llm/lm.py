"""Scores of texts under a hidden Markov language model.

A word is drawn from its class, a class from a hidden state, and a state from the
one before.  Classes are hashes of words into a fixed number of buckets, so the
tables that tasks need do not grow with the vocabulary; the share of a word in
its class comes from counts of all training words, kept as a table and joined.
Every round of Baum-Welch adds up expected counts over the partitions of the
training texts, and the scaled forward recursion gives the exact likelihood of a
whole text, summed over all sequences of states.

A token is a word or the end of a text, one per text.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import Memo, materialize, word_lists

STATES, CLASS_BITS, ROUNDS = 8, 14, 3
SMOOTHING = 0.1
#: The most frequent words, which tasks count in memory; all others are joined.  Longer words are always joined.
HEAD_WORDS, HEAD_BYTES = 131_072, 32
#: The end of a text is a token of its own class.
END = 1 << CLASS_BITS
#: Cells of (text, place) that are held at once.
_CELLS = 400_000
_FLUSH = 400_000
#: Tokens whose numbers wait to be counted.
_WAITING = 1 << 20
#: Places after which the scoring recursion is scaled; no chance of a class is small enough to leave double precision before.
_SCALED = 8

_CLASS = Memo(lambda word: zlib.crc32(word) >> (32 - CLASS_BITS))


class _Numbers(dict):
    """Numbers of words in the order they are met, and the class of each."""

    def __init__(self):
        super().__init__()
        self.classes = array("H")

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.classes)
        self.classes.append(zlib.crc32(word) >> (32 - CLASS_BITS))
        return number


class _Places(dict):
    """Places of the most frequent words in a table; any other word has that of its class behind them."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + _CLASS[word]


def is_held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves no remainder by ten; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def classes_of(text: str | None) -> np.ndarray:
    """The class of every token."""
    parts = [np.fromiter(map(_CLASS.__getitem__, words), np.int32, len(words)) for words in word_lists(text)]
    return np.concatenate([*parts, [END]]).astype(np.int32)


@dataclass(frozen=True)
class Hmm:
    """Chances of first states, of next states, and of classes by state."""

    first: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # (classes, states)


def initial(counts: np.ndarray, states: int = STATES) -> Hmm:
    """A start that tells the states apart: counts of classes tilted by fixed random factors, and states that last."""
    tilt = np.random.default_rng(20).gamma(0.5, size=(len(counts), states)) + 0.05
    emit = (counts[:, None] + SMOOTHING) * tilt
    step = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    return Hmm(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _batches(texts: Iterator[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Numbered texts in groups of like length with a bounded number of cells; a longer text is a group of its own."""
    waiting: list[tuple[int, np.ndarray]] = []
    size = 0

    def groups():
        group, widest = [], 0
        for item in sorted(waiting, key=lambda x: -len(x[1])):
            if group and widest * (len(group) + 1) > _CELLS:
                yield group
                group = []
            widest = widest if group else len(item[1])
            group.append(item)
        if group:
            yield group

    for number, classes in enumerate(texts):
        waiting.append((number, classes))
        size += len(classes)
        if size > 4 * _CELLS:
            yield from groups()
            waiting, size = [], 0
    yield from groups()


def _grid(group: list[tuple[int, np.ndarray]], begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes by place and text for places begin..end, and how many texts (longest first) reach each place."""
    sizes = np.array([len(c) for _, c in group])
    alive = len(group) - np.searchsorted(sizes[::-1], np.arange(begin, end), "right")
    grid = np.zeros((end - begin, len(group)), np.int32)
    for column, (_, classes) in enumerate(group):
        part = classes[begin:end]
        grid[:len(part), column] = part
    return grid, alive


def _forward(model: Hmm, group, begin: int, end: int, state: np.ndarray, scales: np.ndarray | None, keep: bool):
    """Scaled forward recursion over places begin..end; adds to the log scales of the texts, where they are asked for."""
    grid, alive = _grid(group, begin, end)
    kept = np.empty((end - begin, len(group), model.step.shape[0]), model.emit.dtype) if keep else None
    norms = np.ones((end - begin, len(group)), model.emit.dtype)
    for t in range(end - begin):
        many = alive[t]
        emitted = model.emit.take(grid[t, :many], 0)
        if begin + t:
            emitted *= state[:many] @ model.step
        else:
            emitted *= model.first
        state = emitted
        # A place that is not scaled leaves it to the next one that is, or to the last one of a text.
        if scales is None or (begin + t) % _SCALED == _SCALED - 1 or t == end - begin - 1:
            norm = state.sum(1)
            state /= norm[:, None]
            norms[t, :many] = norm
            if keep:
                kept[t, :many] = state
        elif alive[t + 1] < many:
            norms[t, alive[t + 1]:many] = state[alive[t + 1]:].sum(1)
    if scales is not None:
        scales += np.log10(norms).sum(0)
    return grid, alive, kept, norms, state


def _spans(group) -> list[tuple[int, int]]:
    """Stretches of places of which one fits in memory."""
    longest, step = len(group[0][1]), max(1, _CELLS // len(group))
    return [(a, min(a + step, longest)) for a in range(0, longest, step)]


def likelihoods(model: Hmm, texts: Iterator[np.ndarray]) -> list[float]:
    """log10 of the chance of every text's classes, over all sequences of states."""
    out: dict[int, float] = {}
    for group in _batches(texts):
        scales = np.zeros(len(group))
        state = None
        for begin, end in _spans(group):
            state = _forward(model, group, begin, end, state, scales, False)[4]
        out.update((number, float(s)) for (number, _), s in zip(group, scales, strict=True))
    return [out[i] for i in range(len(out))]


class Expected:
    """Expected counts of first states, of steps between states and of classes by state.

    Recursions run in numbers of ``kind``, the sums in double precision.
    """

    def __init__(self, model: Hmm, kind: type = np.float64):
        states = len(model.first)
        self.model = Hmm(*(x.astype(kind) for x in (model.first, model.step, model.emit)))
        self.first, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape)

    def add(self, group) -> None:
        """Forward and backward over one group; of a very long text only one stretch is held at a time."""
        model, spans = self.model, _spans(group)
        state, before = None, []
        for begin, end in spans[:-1]:
            before.append(state)
            state = _forward(model, group, begin, end, state, None, False)[4]
        before.append(state)
        states = len(model.first)
        back = np.ones((0, states), model.emit.dtype)  # the backward message of the texts that go on, scaled
        for (begin, end), entry in zip(reversed(spans), reversed(before), strict=True):
            grid, alive, kept, norms, _ = _forward(model, group, begin, end, entry, None, True)
            shares = np.empty_like(kept)
            for t in range(end - begin - 1, -1, -1):
                many = alive[t]
                if len(back) < many:  # texts that end here
                    back = np.concatenate([back, np.ones((many - len(back), states), back.dtype)])
                shares[t, :many] = kept[t, :many] * back
                carried = back * model.emit[grid[t, :many]] / norms[t, :many, None]
                if begin + t:
                    previous = kept[t - 1, :many] if t else entry[:many]
                    self.step += model.step * (previous.T @ carried)
                    back = carried @ model.step.T
                else:
                    self.first += shares[t, :many].sum(0)
            live = np.arange(len(group)) < alive[:, None]
            seen, weight = grid[live], shares[live]
            for k in range(states):
                self.emit[:, k] += np.bincount(seen, weight[:, k], minlength=len(self.emit))


def _next(model: Hmm, first: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Hmm:
    """The model of expected counts, each with a little of a flat one, so that no class is impossible."""
    first, step, emit = first + SMOOTHING, step + SMOOTHING, emit + SMOOTHING / len(first)
    return Hmm(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Rounds of Baum-Welch over the ``classes`` of all texts, as ``read_once`` gives them.

    A partition gives its expected counts as rows by class; Spark adds them up,
    and what reaches the driver has the size of the model.  Expected counts stem from
    single precision, which changes them in the seventh digit; scores are exact for the model.
    """
    spark = encoded.sparkSession
    model = initial(counts, states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def part(batches, shared=shared):
            expected = Expected(shared.value, np.float32)
            for group in _batches(np.frombuffer(v.as_py(), "<u2") for batch in batches for v in batch.column(0)):
                expected.add(group)
            rows = np.concatenate([expected.first[None], expected.step, expected.emit])
            used = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), *(pa.array(rows[used, k]) for k in range(states))],
                ["row", *(f"s{k}" for k in range(states))])

        columns = ", ".join(f"s{k} double" for k in range(states))
        sums = (encoded.select("classes").mapInArrow(part, f"row int, {columns}").groupBy("row")
                .agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states))).toArrow())
        rows = np.zeros((1 + states + len(counts), states))
        rows[sums.column("row").to_numpy()] = np.stack([sums.column(f"s{k}").to_numpy() for k in range(states)], 1)
        shared.destroy()
        model = _next(model, rows[0], rows[1:1 + states], rows[1 + states:])
    return model


def read_once(docs: DataFrame, text: str = "text") -> DataFrame:
    """One pass over the texts: rows (word, n) of counts added up in the task, and a row with ``classes`` per text.

    Classes are 16-bit numbers, the end of the text last; rows of the other kind hold null.
    """

    def part(batches):
        numbers, counts, waiting, tokens = _Numbers(), np.zeros(0, np.int64), [], 0

        def counted():
            sums = np.bincount(np.concatenate([np.empty(0, np.int32), *waiting]), minlength=len(numbers)).astype(np.int64)
            sums[:len(counts)] += counts
            return sums

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers.keys(), pa.binary()), pa.array(counted(), pa.int64()), pa.nulls(len(numbers), pa.binary())],
                ["word", "n", "classes"])

        for batch in batches:
            encoded = []
            for value in batch.column(0):
                parts = []
                for words in word_lists(value.as_py()):
                    own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    if words:
                        parts.append(np.frombuffer(numbers.classes, np.uint16)[own].astype("<u2", copy=False))
                    waiting.append(own)
                    tokens += len(own)
                    if len(numbers) > _FLUSH:
                        yield flush()
                        numbers, counts, waiting, tokens = _Numbers(), np.zeros(0, np.int64), [], 0
                    elif tokens > _WAITING:
                        counts, waiting, tokens = counted(), [], 0
                encoded.append(np.concatenate([*parts, np.array([END], "<u2")]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(encoded), pa.binary()), pa.nulls(len(encoded), pa.int64()), pa.array(encoded, pa.binary())],
                ["word", "n", "classes"])
        yield flush()

    return docs.select(text).mapInArrow(part, "word binary, n bigint, classes binary")


def _class_column():
    return F.shiftright(F.crc32("word"), 32 - CLASS_BITS).cast("int")


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from the texts that are not held out (see ``is_held_out``).
    ``base_score`` is log10 of the smoothed chances of single tokens, ``score``
    that of the hidden Markov model.  A null or empty text has the end as its only
    token.  Every row stays, with repeated keys too; a null key is held out.  With
    no training text all words are unknown.  Other columns are not read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), is_held_out(key).alias("held_out"))
    learning = named.where("NOT held_out").select("text")
    once = materialize(read_once(learning), "read-once")
    encoded = once.where("classes IS NOT NULL")
    words = materialize(once.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    by_class = words.groupBy(_class_column().alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    texts = encoded.count()
    class_counts, class_words = np.zeros(END + 1), np.zeros(END + 1)
    at = by_class.column("class").to_numpy()
    class_counts[at], class_words[at] = by_class.column("n").to_numpy(), by_class.column("v").to_numpy()
    class_counts[END], class_words[END] = texts, min(texts, 1)
    total, distinct = int(class_counts.sum()), int(class_words.sum())
    model = train(encoded, class_counts, rounds)

    head = words.where(F.length("word") <= HEAD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow()
    places = _Places(zip(head.column("word").to_pylist(), range(head.num_rows), strict=True))
    # log10 of what a class divides by; the share of an unknown word takes one more place, and the end is all of its class.
    divide = np.log10(class_counts + SMOOTHING * (class_words + 1))
    # By place in the head, and behind it by class: the class, and what a word of the head adds to the score.
    class_at = np.concatenate([np.array([zlib.crc32(w) >> (32 - CLASS_BITS) for w in places], np.int32), np.arange(END, dtype=np.int32)])
    log_at = np.log10(head.column("n").to_numpy() + SMOOTHING)
    shared = spark.sparkContext.broadcast((model, places, class_at, log_at, divide, texts))

    def part(batches):
        model, places, class_at, log_at, divide, texts = shared.value
        for batch in batches:
            tokens, sure, logs, of_class, tails = [], [], [], [], []

            def read(value, tokens=tokens, sure=sure, logs=logs, of_class=of_class, tails=tails):
                many, found, log, rest = 1, int(texts > 0), float(np.log10(texts + SMOOTHING)), Counter()
                parts = []
                for words in word_lists(value):
                    many += len(words)
                    own = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                    parts.append(class_at[own])
                    inside = own < len(places)
                    found += int(inside.sum())
                    log += float(log_at[own[inside]].sum())
                    rest.update([words[i] for i in np.flatnonzero(~inside).tolist()])
                classes = np.concatenate([*parts, [END]]).astype(np.int32)
                tokens.append(many)
                sure.append(found)
                logs.append(log)
                of_class.append(float(divide[classes].sum()))
                tails.append([{"word": w, "times": c} for w, c in rest.items()])
                return classes

            hidden = likelihoods(model, (read(v.as_py()) for v in batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(sure, pa.int64()), pa.array(logs),
                 pa.array(np.array(hidden) - of_class), pa.array(tails, pa.list_(pa.struct(
                     [("word", pa.binary()), ("times", pa.int64())])))],
                ["key", "held_out", "n_tokens", "sure", "logs", "hidden", "tail"])

    kind = named.schema["key"].dataType.simpleString()
    read = named.select("key", "text", "held_out").mapInArrow(part, f"key {kind}, held_out boolean, n_tokens bigint, "
                            "sure bigint, logs double, hidden double, tail array<struct<word: binary, times: bigint>>")
    read = materialize(read.withColumn("row", F.monotonically_increasing_id()), "read")
    # Words beyond the head, by text: their counts come from the whole vocabulary; unknown ones find none.
    tail = (read.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), "t.times")
            .join(words, "word", "left"))
    tail = tail.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(SMOOTHING))).alias("more_logs"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = float(np.log10(total + SMOOTHING * (distinct + 1)))
    return read.join(tail, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("hidden") + logs).alias("score"))
