"""The nearest term of every label, for term lists of any size.

Terms are kept as a table of blocks, each of terms of one length.  Labels are
gathered in chunks of one length and walked through the blocks band by band: a
band of terms can only matter while the lengths alone allow a higher ratio or a
smaller distance than what a label already has.  Within a block the common
subsequences of a label and all terms, found together by bit operations,
bound the sequence-match ratio from above and the edit distance from below, so the
exact measures run for few pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.session import materialize

c = F.col
#: Terms of a block and labels of a chunk; both bound what one task holds at a time.
BLOCK_TERMS, CHUNK_LABELS = 2048, 512
#: The first walk compares labels with terms of lengths up to so many letters away.
FIRST_BAND = 2
#: Distances count up to here.
FAR = 10
_RESULT = "label string, ratio double, distance int, near boolean, equal boolean"
_FIELDS = ["label", "ratio", "distance", "near", "equal"]


def chunks(words: DataFrame, column: str, most: int, *others: str) -> DataFrame:
    """(size, part, words array of (column, others)): distinct words by length, dealt by hash into parts of about ``most``."""
    sized = words.withColumn("size", F.length(column))
    parts = sized.groupBy("size", *[o for o in others if o == "band"]).agg(F.ceil(F.count("*") / most).alias("parts"))
    keys = [k for k in ("size", "band") if k in parts.columns]
    dealt = sized.join(parts, keys).withColumn("part", F.pmod(F.xxhash64(column), c("parts")))
    fields = [column, *[o for o in others if o != "band"]]
    item = F.struct(*fields) if len(fields) > 1 else c(column)
    return dealt.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(item)).alias("words"))


def term_index(terms: DataFrame, column: str = "term") -> DataFrame:
    """Blocks (size, block, terms) of the distinct terms, as a written table."""
    distinct = materialize(terms.select(column).where(F.length(column) > 0).distinct(), "terms")
    return materialize(chunks(distinct, column, BLOCK_TERMS).select(
        "size", c("part").alias("block"), c("words").alias("terms")), "term-index", keep=True)


class TermBlock:
    """Terms of one length as columns of letter numbers."""

    def __init__(self, terms: tuple[str, ...]):
        self.terms, self.size = terms, len(terms[0])
        codes = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(terms), self.size)
        letters, places = np.unique(codes, return_inverse=True)
        self.rows = places.reshape(codes.shape)
        self.columns = np.ascontiguousarray(self.rows.T)
        self.numbers = {chr(x): i for i, x in enumerate(letters)}
        self._matchers: dict[int, SequenceMatcher] = {}

    def ratio(self, label: str, term: int) -> float:
        if term not in self._matchers:
            self._matchers[term] = SequenceMatcher(None, "", self.terms[term])
        self._matchers[term].set_seq1(label)
        return self._matchers[term].ratio()

    def common(self, label: str) -> np.ndarray:
        """Length of the longest common subsequence of the label with every term."""
        if len(label) > 64:
            return self._common_of_long(label)
        masks = np.zeros(len(self.numbers) + 1, np.uint64)
        for place, letter in enumerate(label):
            masks[self.numbers.get(letter, -1)] |= np.uint64(1 << place)
        masks[-1] = 0
        state = np.full(len(self.terms), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for column in self.columns:
            match = masks[column]
            state = (state + (state & match)) | (state & ~match)
        used = np.uint64((1 << len(label)) - 1)
        return np.bitwise_count(~state & used).astype(np.int64)

    def _common_of_long(self, label: str) -> np.ndarray:
        row = np.zeros((len(self.terms), self.size + 1), np.int32)
        for letter in label:
            step = row[:, :-1] + (self.rows == self.numbers.get(letter, -1))
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], step), axis=1)
        return row[:, -1].astype(np.int64)

    def distances(self, label: str, some: np.ndarray) -> np.ndarray:
        """Edit distances of the label to some of the terms."""
        ramp = np.arange(self.size + 1, dtype=np.int32)
        letters, row = self.rows[some], np.tile(ramp, (len(some), 1))
        for letter in label:
            step = row[:, :-1] + (letters != self.numbers.get(letter, -1))
            row = row + 1
            row[:, 1:] = np.minimum(row[:, 1:], step)
            row = np.minimum.accumulate(row - ramp, axis=1) + ramp
        return row[:, -1]

    def best(self, label: str, ratio: float, distance: int, near_ratio: float) -> tuple[float, int, bool, bool]:
        """(ratio to unequal terms, distance, look-alike, equal) when this much is known already."""
        common = self.common(label)
        longer = max(len(label), self.size)
        bounds = 2.0 * common / (len(label) + self.size)
        same = (common == longer)                      # only an equal term has all letters of both in common
        equal, close = bool(same.any()), 1 if self.size <= 6 else 2
        order = np.flatnonzero((bounds > ratio) & ~same)
        for at in order[np.argsort(-bounds[order], kind="stable")]:
            if bounds[at] <= ratio:
                break
            ratio = max(ratio, self.ratio(label, int(at)))
        least, near = longer - common, False
        if equal:
            distance = 0
        for _ in range(2):                             # the nearest bound first, then whoever can still be nearer
            wanted = np.flatnonzero(~same & (least <= (least[~same].min() if _ == 0 and (~same).any() else max(distance - 1, close))))
            wanted = wanted[least[wanted] <= max(distance - 1, close)]
            if len(wanted):
                found = self.distances(label, wanted)
                distance = min(distance, int(found.min()))
                near = near or bool((found <= close).any())
        return ratio, distance, near or ratio >= near_ratio, equal


@lru_cache(maxsize=32)
def _block(terms: tuple[str, ...]) -> TermBlock:
    return TermBlock(terms)


def _compared(pairs: DataFrame, near_ratio: float) -> DataFrame:
    """One row per label and block from rows of (labels array of (label, ratio, distance), terms array)."""

    def run(batches):
        for batch in batches:
            for labels, terms in zip(batch.column(0), batch.column(1), strict=True):
                block = _block(tuple(terms.as_py()))
                out = [(x["label"], *block.best(x["label"], x["ratio"], x["distance"], near_ratio)) for x in labels.as_py()]
                columns = list(zip(*out, strict=True))
                types = [pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], _FIELDS)

    return pairs.select("labels", "terms").mapInArrow(run, _RESULT)


def _reduced(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.max("ratio").alias("ratio"), F.min("distance").alias("distance"),
                                     F.max("near").alias("near"), F.max("equal").alias("equal"))


def _worth(ratio: Column, distance: Column, size: Column, other: Column) -> Column:
    """Whether terms of another length can still be nearer than what a label has."""
    return ((2.0 * F.least(size, other) / (size + other)) > ratio) | (F.abs(size - other) < distance)


def nearest_terms(labels: DataFrame, index: DataFrame, near_ratio: float, column: str = "label") -> DataFrame:
    """(label, ratio, distance, near, equal) per distinct label, against all terms of the index.

    ``ratio`` is the highest sequence-match ratio with an unequal term,
    ``distance`` the smallest edit distance (at most ``FAR``), ``equal`` says
    whether the label is a term, and ``near`` whether an unequal term lies within
    one edit (two beyond six letters) or reaches ``near_ratio``.  A label that
    nothing resembles keeps ratio 0; without terms all do.  Null labels go.

    Two walks: the first over lengths nearby, the second only for labels and
    lengths that the first has not ruled out.  Each pairs chunks with blocks by an
    equi-join on the length of the terms; the driver holds only the distinct lengths.
    """
    given = materialize(labels.select(c(column).alias("label")).where("label IS NOT NULL").distinct(), "labels")
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())
    bands = F.array(*[F.lit(s) for s in sizes]).cast("array<int>")

    def walk(known: DataFrame) -> DataFrame:
        """``known`` has (label, ratio, distance, band)."""
        parts = chunks(known, "label", CHUNK_LABELS, "ratio", "distance", "band")
        pairs = parts.select("band", c("words").alias("labels")).join(index.withColumnRenamed("size", "band"), "band")
        return _reduced(_compared(pairs, near_ratio))

    start = given.withColumns({"ratio": F.lit(0.0), "distance": F.lit(FAR)})
    size = F.length("label")
    nearby = F.filter(bands, lambda b: F.abs(b - size) <= FIRST_BAND)
    first = walk(materialize(start.withColumn("band", F.explode(nearby)), "first-bands"))
    known = materialize(given.join(first, "label", "left").select(
        "label", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("distance", F.lit(FAR)).alias("distance"),
        F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("equal", F.lit(False)).alias("equal")), "first-walk")
    rest = F.filter(bands, lambda b: (F.abs(b - size) > FIRST_BAND) & _worth(c("ratio"), c("distance"), size, b))
    second = walk(materialize(known.select("label", "ratio", "distance", F.explode(rest).alias("band")), "second-bands"))
    return _reduced(known.select(*_FIELDS).unionByName(second.select(*_FIELDS)))
