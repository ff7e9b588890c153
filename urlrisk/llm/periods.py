"""Periodic runs of words: squares caught by completed power-of-two blocks, merged into maximal runs.

Words are the runs of bytes other than ASCII white space; case counts.  A run is
a stretch of consecutive words with smallest period q that is at least
``LEAST`` words and ``TIMES`` periods long and that no neighbouring word extends
with the same period.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import map_arrow

#: Least words of a run, and least periods of it.  The catchers find every run of four periods and more.
LEAST, TIMES = 6, 4
#: Texts beyond so many bytes are split in pieces and their equal words are held once.
_PIECE = 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"
_PRIME, _BASE = (1 << 61) - 1, 0x5851F42D4C957F2D % ((1 << 61) - 1)
_POWERS = [1]
#: Up to this size a block of a long run always has a copy behind it as well, so it need not wait for one ahead.
_LOOKS_BACK = 8


def _powers(size: int) -> list[int]:
    while len(_POWERS) <= size:
        _POWERS.append(_POWERS[-1] * _BASE % _PRIME)
    return _POWERS


class Catchers:
    """The runs of a sequence that grows word by word.

    Whenever the sequence completes an aligned block of 1, 2, 4, ... words, the
    block becomes a catcher: it looks for its nearest copy behind, and, if
    large, waits for its nearest copy ahead, at a distance of more than half
    its size and at most its size.  A run of four periods q holds an aligned
    block of the least power of two that is not below q together with one of
    the two copies, and within a run the nearest copy of q words and more is q
    words away; so every such run is caught.  The comparison of suffixes at
    that distance then gives the start of the square; each appended word
    carries the comparison on, and what a later square of the same period
    would report is part of the open run.  Copies are proposed by
    fingerprints of the prefixes and confirmed word by word.  Time is
    O(log n) a word, memory a few numbers a word.
    """

    def __init__(self, least: int = LEAST, times: int = TIMES):
        if times < 4:
            raise ValueError("catchers promise runs of four periods and more")
        self.least, self.times = least, times
        self._words: list[int] = []
        self._sums = array("Q", [0])
        self._same = array("q")                                # the place before with the same word
        self._last: dict[int, int] = {}
        self._waiting: dict[int, list[tuple[int, int, int]]] = {}
        self._open: list[tuple[int, int]] = []                # (period, start)
        self._closed: dict[tuple[int, int], int] = {}         # (start, length) -> least period

    def append(self, word: int) -> None:
        """Let the sequence grow by one word, given as a number from 0."""
        words, sums = self._words, self._sums
        place = len(words)
        words.append(word)
        if self._open:
            self._advance(place, word)
        total = (sums[place] * _BASE + word + 1) % _PRIME
        sums.append(total)
        behind = self._last.get(word, -1)
        self._last[word] = place
        self._same.append(behind)
        if behind >= 0 and word in self._waiting:
            self._ahead(place, total, word)
        length, size = place + 1, 1
        while not length & (size - 1) and size <= length:
            self._completed(place, size, total, behind)
            size += size

    def _advance(self, place: int, word: int) -> None:
        words, still = self._words, []
        for run in self._open:
            if words[place - run[0]] == word:
                still.append(run)
            else:
                self._close(run, place)
        self._open = still

    def _completed(self, place: int, size: int, total: int, behind: int) -> None:
        """The block that ends here becomes a catcher."""
        power, sums, same = _powers(size)[size], self._sums, self._same
        own = (total - sums[place + 1 - size] * power) % _PRIME
        least = max(place - size, size - 1)
        while behind >= least:
            if (sums[behind + 1] - sums[behind + 1 - size] * power) % _PRIME == own:
                if 2 * (place - behind) > size:
                    self._catch(place - behind, place)
                break
            behind = same[behind]
        if size > _LOOKS_BACK:
            self._waiting.setdefault(self._words[place], []).append((place, size, own))

    def _ahead(self, place: int, total: int, word: int) -> None:
        """Catchers whose block ends in this word may meet their nearest copy ahead."""
        powers, sums, still = _POWERS, self._sums, []
        for catcher in self._waiting[word]:
            end, size, own = catcher
            apart = place - end
            if apart > size:
                continue
            if (total - sums[place + 1 - size] * powers[size]) % _PRIME == own:
                if 2 * apart > size:
                    self._catch(apart, place)
            else:
                still.append(catcher)
        if still:
            self._waiting[word] = still
        else:
            del self._waiting[word]

    def _catch(self, period: int, place: int) -> None:
        """A square of this period ends here, unless its run is open already."""
        if any(run[0] == period for run in self._open):
            return
        words, at = self._words, place
        while at >= period and words[at] == words[at - period]:
            at -= 1
        start = at + 1 - period
        if place + 1 - start >= 2 * period:
            self._open.append((period, start))

    def _close(self, run: tuple[int, int], end: int) -> None:
        period, start = run
        length = end - start
        if length >= self.least and length >= self.times * period:
            key = (start, length)
            self._closed[key] = min(period, self._closed.get(key, period))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs so far as (start, length, period), by start, then period."""
        for run in self._open:
            self._close(run, len(self._words))
        return sorted(((start, length, period) for (start, length), period in self._closed.items()),
                      key=lambda r: (r[0], r[2]))


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a list of words, by start, then period.

    Each word of a run occurs ``times`` times in it, so a rarer word ends every
    run; the catchers see only the stretches between such words.
    """
    counts = Counter(words)
    codes = {w: i for i, (w, n) in enumerate(counts.items()) if n >= times}
    if not codes:
        return []
    out, start, stretch = [], 0, []
    for place, code in enumerate([*map(codes.get, words), None]):
        if code is not None:
            stretch.append(code)
            continue
        if len(stretch) >= least:
            catchers = Catchers(least, times)
            for word in stretch:
                catchers.append(word)
            out += [(start + s, length, period) for s, length, period in catchers.finish()]
        if stretch:
            stretch = []
        start = place + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def split_words(data: bytes | None) -> list[bytes]:
    """The words of a text; in a huge text equal words are one object, so the list costs a reference each."""
    data = data or b""
    if len(data) <= _PIECE:
        return data.split()
    words, held, start = [], {}, 0
    while start < len(data):
        end = min(start + _PIECE, len(data))
        while end < len(data) and data[end] not in _WHITE:
            end += 1
        piece = data[start:end].split()
        words.extend(map(held.setdefault, piece, piece))
        start = end
    return words


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    kept, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if end > at:
            kept += words[at:max(at, start)]
            at = end
    return kept + words[at:]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  rewrite: Callable[[object, list], list] | None = None,
                  least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, n_words, runs array of (start, length, period), collapsed) of every whole text.

    ``runs`` are in order of start, then period; ``collapsed`` is the kept words
    joined by one space, where words after the first period of a run go.
    ``rewrite`` may replace the words of a row before the search.  A null text,
    an empty one and one of white space have no words, no runs and an empty
    ``collapsed``.  Rows stay as they are, repeated and null keys included; an
    empty table gives an empty table; other columns are not read, whatever their
    names.  No row leaves its partition; memory is bounded by a text.
    """
    schema = docs.select(key).schema
    kind = schema[0].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, found, collapsed = [], [], []
        for name, value in zip(batch.column(0), batch.column(1), strict=True):
            words = split_words(value.as_py())
            if rewrite is not None:
                words = rewrite(name.as_py(), words)
            runs = runs_of(words, least, times)
            sizes.append(len(words))
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            collapsed.append(b" ".join(without_repeats(words, runs) if runs else words))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.binary())],
            ["_key", "n_words", "runs", "collapsed"])

    found = map_arrow(docs.select(key, F.col(text).cast("binary")), rows,
                      f"_key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
    return found.select(F.col("_key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One flat row per text: number of runs, the run of the greatest exponent, digests of all runs and of the kept words.

    Exponents are compared exactly, as products of whole numbers; ties go to
    the smaller start, then the smaller period.  Without runs the four columns
    of the greatest one are null.
    """
    best = F.expr("""
        aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), (a, r) ->
            IF(a IS NULL OR cast(r.length AS decimal(38,0)) * a.period > cast(a.length AS decimal(38,0)) * r.period, r, a))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
