"""Exact token counts at every prefix of a text, by dynamic programming.

For each prefix exactly one token ends its encoding: the one that may stand
beside the last token of the prefix before it.  Going from left to right, the
count of a prefix is one more than that of the prefix without its last token.
One pass therefore answers every question about truncation and budgets.

No piece goes on from a word into the space after it, so a text falls into
units of spaces and a word; the counts of units are memoised and added up.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import Memo, lists, map_arrow
from urlrisk.llm.merges import Merges

_SPACE = "▁"
_UNIT = re.compile("▁+[^▁]*")


class PrefixCounter:
    """Counts for a sentencepiece BPE model with byte fallback, a dummy space in front and no normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        symbols = {p for p in pieces if len(p) == 1}
        merged = sorted((p for p in pieces if len(p) > 1 and set(p) != {_SPACE}), key=lambda p: -pieces[p])
        if any(_SPACE in p[1:] or not symbols.issuperset(p) for p in merged):
            raise ValueError("pieces that go on past a space, or hold letters without a piece, are not supported")
        self.merges = Merges({p: i for i, p in enumerate(merged)}, symbols)
        self.widest = max(map(len, merged))
        #: Spaces that no word takes merge last and from the left, so a run fills pieces of this many.
        self.run = max(len(p) for p in pieces if set(p) == {_SPACE})
        self.automaton = ahocorasick.Automaton()
        self.names = [*sorted(symbols), *(p for p in merged if self.merges.usable(p))]
        for number, piece in enumerate(self.names):
            self.automaton.add_word(piece, (number, len(piece)))
        self.automaton.make_automaton()
        many, names = len(self.names), self.names
        self.beside = Memo(lambda pair: self.merges.fits[names[pair // many], names[pair % many]])
        self.unknown = re.compile("([^" + re.escape("".join(symbols)) + "])")
        self.units = Memo(self._count)
        self.words = Memo(lambda word: self._count(_SPACE + word)[-1])

    def _count(self, unit: str) -> list[int]:
        """Counts at prefixes of 1, 2, ... characters of a unit."""
        if self.merges.symbols.issuperset(unit):
            return self._known(unit)
        counts: list[int] = []
        for part, text in enumerate(self.unknown.split(unit)):  # known letters and one unknown in turn
            base = counts[-1] if counts else 0
            if part % 2:  # stands as its bytes, and nothing merges with it
                counts.append(base + len(text.encode("utf-8", "surrogatepass")))
            elif text:
                counts.extend([base + c for c in self._known(text)])
        return counts

    def _known(self, text: str) -> list[int]:
        """The same where every letter has a piece."""
        many, beside = len(self.names), self.beside
        last, counts, done = [-1], [0], 0
        for end, (piece, size) in self.automaton.iter(text):  # all pieces that end here, longest first
            if end == done:
                before = last[end + 1 - size]
                if before < 0 or beside[before * many + piece]:
                    last.append(piece)
                    counts.append(counts[end + 1 - size] + 1)
                    done += 1
        if text[1:2] == _SPACE:  # a run of spaces: those that stayed alone merge among themselves
            spaces = next((i for i, piece in enumerate(last[1:]) if self.names[piece] != _SPACE), len(text))
            alone = [-(-i // self.run) for i in range(spaces + 1)]
            at = [0, *(end - len(self.names[piece]) for end, piece in enumerate(last[1:], 1))]
            for end in range(1, len(text) + 1):
                counts[end] = alone[end] if end <= spaces else counts[at[end]] + 1
        return counts[1:]

    def _split(self, text: str) -> list[str]:
        return _UNIT.findall((_SPACE + text).replace(" ", _SPACE)) if text else []

    def prefixes(self, text: str | None) -> np.ndarray:
        """Counts at prefixes of 1, 2, ... characters."""
        parts, base = [np.empty(0, np.int64)], 0
        for unit in self._split(text or ""):
            parts.append(np.array(self.units[unit]) + base)
            base = int(parts[-1][-1])
        return np.concatenate(parts)[1:].astype(np.int32)  # the dummy space is no character of the text

    def total(self, text: str | None) -> int:
        """Tokens of the whole text."""
        text = text or ""
        words = text.split(" ")
        if "" in words or _SPACE in text:
            return sum(self.units[unit][-1] for unit in self._split(text))
        return sum(map(self.words.__getitem__, words))

    def longest(self, text: str | None, limit: int) -> int:
        """The most characters from the start whose encoding has no more tokens than the limit."""
        units = self._split(text or "")
        base = np.concatenate([[0], np.cumsum([self.units[u][-1] for u in units])]).astype(np.int64)
        if limit <= 0 or not units:
            return 0
        # The first character of a unit always adds one token, so the last unit that begins below the limit decides.
        at = min(int(np.searchsorted(base, limit, "left")) - 1, len(units) - 1)
        inside = np.flatnonzero(np.array(self.units[units[at]]) + base[at] <= limit)
        return sum(map(len, units[:at])) + int(inside[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """The counter of this Python process; the file is small and installed on every machine."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts array<int>): the token count of every prefix of the whole text, by characters.

    ``counts[i]`` (from 0) belongs to the first i + 1 characters, as they would be
    encoded alone.  A null or empty text has no prefix.  Repeated and null keys
    stay as rows; an empty table gives an empty table; other columns are not read.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        dp = counter(path)
        found = [dp.prefixes(value.as_py()) for value in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), lists(found, pa.int32())], [key, "counts"])

    return map_arrow(docs.select(key, text), rows, f"`{key}` {kind}, counts array<int>")


def tokens_at(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from stored counts; null beyond the text, 0 for none."""
    return F.when(n_chars <= 0, 0).otherwise(F.try_element_at(counts, n_chars.cast("int")))


def longest_within(counts: Column, limit: int) -> Column:
    """The most characters within a token budget, from stored counts; they need not rise, so the last one that fits."""
    fits = F.reverse(F.transform(counts, lambda c: c <= limit))
    place = F.array_position(fits, True)
    return F.when(place > 0, F.size(counts) - place + 1).otherwise(0).cast("long")


def budgets(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars): every whole text against a token budget.

    ``fit_chars`` is the most characters from the start that encode to no more than
    ``limit`` tokens.  The counts of prefixes are used where they arise and not
    stored.  A null text counts as empty: no bytes, no tokens, not over the limit.
    Other cases as in ``prefix_counts``.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        dp = counter(path)
        sizes, totals, fits = [], [], []
        for value in batch.column(1):
            value = value.as_py() or ""
            sizes.append(len(value.encode("utf-8", "surrogatepass")))
            totals.append(dp.total(value))
            fits.append(len(value) if totals[-1] <= limit else dp.longest(value, limit))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
             pa.array([t > limit for t in totals], pa.bool_()), pa.array(fits, pa.int64())],
            [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return map_arrow(docs.select(key, text), rows,
                     f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
