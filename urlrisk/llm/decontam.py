"""Documents that hold items of a benchmark.

A window of a document is as long as the item it is held against.  Windows and
items are fingerprinted by SimHash over their shingles, each as often as it
occurs.  Item fingerprints are indexed by eight blocks of eight bits, each
entered under every value within two bits: two fingerprints within a radius of
23 bits agree in some block up to two, so the lookup of the eight blocks of a
window finds all items within the radius.  The exact weighted similarity of the
shingles decides.

Items are taken in groups of a bounded size, each sent to the tasks once.
Windows too few of whose shingles occur in any item of the group cannot reach
the threshold and are not fingerprinted.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import list_rows, lists, map_arrow, materialize, shingles, word_hashes

RADIUS = 23
#: Item words that one group holds about; it bounds what is sent to the tasks.
GROUP_WORDS = 1_000_000
_FILTER_BITS = 22
_WITHIN_TWO = [v for v in range(256) if v.bit_count() <= 2]


def fingerprints(runs: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit SimHash of every window of ``width`` shingle hashes."""
    signs = np.unpackbits(runs.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(runs) + 1, 64), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    bits = sums[width:] - sums[:-width] > 0
    return np.packbits(bits, axis=1).view("<u8").ravel()


class ItemIndex:
    """A group of items: shingles, fingerprints and their blocks, by the number of words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], words: int, percent: int, radius: int = RADIUS):
        if not 0 <= radius <= 23:
            raise ValueError("eight blocks within two bits guarantee a radius of at most 23")
        self.words, self.percent, self.radius = words, percent, radius
        self.ids = [i for i, _ in items]
        runs = [shingles(h, words) for _, h in items]
        self.bags = [Counter(r.tolist()) for r in runs]
        self.prints = np.array([fingerprints(r, len(r))[0] for r in runs], np.uint64)
        self.known = np.unique(np.concatenate(runs))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.blocks: dict[int, list[dict[int, list[int]]]] = {}
        for number, (_, h) in enumerate(items):
            blocks = self.blocks.setdefault(len(h), [{} for _ in range(8)])
            for block, value in zip(blocks, int(self.prints[number]).to_bytes(8, "little"), strict=True):
                for near in _WITHIN_TWO:
                    block.setdefault(value ^ near, []).append(number)

    def within(self, length: int, print_: int) -> list[int]:
        """All items of this length whose fingerprint lies within the radius."""
        found: set[int] = set()
        for block, value in zip(self.blocks[length], print_.to_bytes(8, "little"), strict=True):
            found.update(block.get(value, ()))
        return [n for n in found if (int(self.prints[n]) ^ print_).bit_count() <= self.radius]

    def similarity(self, number: int, window: np.ndarray) -> tuple[int, int]:
        """Shingles in common and in the union, each as often as it occurs."""
        bag, other = self.bags[number], Counter(window.tolist())
        common = sum((bag & other).values())
        return common, bag.total() + other.total() - common

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the most similar window for every item that one reaches."""
        best: dict[int, tuple[float, int, int]] = {}
        runs_by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in self.blocks if len(hashes) else ():
            span = min(length, len(hashes))
            size = min(self.words, span)
            if size not in runs_by_size:
                runs = shingles(hashes, size)
                hit = self.filter[(runs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
                if hit.any():
                    at = np.flatnonzero(hit)
                    place = np.minimum(np.searchsorted(self.known, runs[at]), len(self.known) - 1)
                    hit[at] = self.known[place] == runs[at]
                runs_by_size[size] = runs, np.concatenate([[0], np.cumsum(hit)])
            runs, before = runs_by_size[size]
            if not before[-1]:
                continue
            width = span - size + 1
            starts = np.flatnonzero(100 * (before[width:] - before[:-width]) >= self.percent * width)
            if not len(starts):
                continue
            # Runs of neighbouring windows are fingerprinted together.
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
                prints = fingerprints(runs[part[0]:part[-1] + width], width)
                for start in part.tolist():
                    window = runs[start:start + width]
                    for number in self.within(length, int(prints[start - part[0]])):
                        common, union = self.similarity(number, window)
                        if 100 * common >= self.percent * union:
                            rank = (common / union, -start, span)
                            best[number] = max(best.get(number, rank), rank)
        return [(self.ids[n], -start, span, share) for n, (share, start, span) in sorted(best.items())]


def _groups(items: DataFrame, words: int, percent: int, key: str, text: str, group_words: int):
    """Indexes of the items, group by group."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [word_hashes(v.as_py()).view(np.int64) for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists(found, pa.int64())], ["id", "words"])

    rows = items.where(F.col(key).isNotNull()).select(key, text)
    table = materialize(map_arrow(rows, hashed, "id bigint, words array<bigint>").where("size(words) > 0"), "items")
    total = table.agg(F.sum(F.size("words"))).first()[0] or 0
    groups = -(-total // group_words)
    for group in range(groups):
        part = table.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == group).orderBy("id", "words").toArrow()
        if part.num_rows:
            found = [w.view(np.uint64) for w in list_rows(part.column("words"))]
            yield ItemIndex(list(zip(part.column("id").to_pylist(), found, strict=True)), words, percent)


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id",
                 text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 group_words: int = GROUP_WORDS) -> DataFrame:
    """(key, item_id, start_word, n_words, similarity): one row per document and item that it holds.

    The similarity of two bags of word shingles is 100 * common / union >= percent;
    of several windows the most similar is given, of equals the first.  A document
    shorter than an item is one window.  Items or texts that are null or empty
    match nothing; items that repeat an id are held against one by one, and rows
    that repeat a document each give their rows; null item ids are left out, null
    keys stay null.  Other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id bigint, start_word bigint, n_words bigint, similarity double"
    out = None
    for index in _groups(items, words, percent, item_key, item_text, group_words):
        shared = spark.sparkContext.broadcast(index)

        def rows(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = [(row, *m) for row, v in enumerate(batch.column(1)) for m in shared.value.matches(word_hashes(v.as_py()))]
            columns = list(zip(*found, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:4]),
                 pa.array(columns[4], pa.float64())], [key, "item_id", "start_word", "n_words", "similarity"])

        part = map_arrow(docs.select(key, text), rows, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """The documents, with all their columns, that hold no item; cases as in ``contaminated``; nothing is shuffled."""
    at = docs.columns.index(text)
    for index in _groups(items, words, percent, item_key, item_text, group_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            clean = [not shared.value.matches(word_hashes(v.as_py())) for v in batch.column(at)]
            return batch.filter(pa.array(clean, pa.bool_()))

        docs = map_arrow(docs, rows, docs.schema)
    return docs
