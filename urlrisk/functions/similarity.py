"""Blocking keys for edit-distance joins, and the sequence-match ratio."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cut(text: Column) -> Column:
    """All strings one deletion away; an empty text has none."""
    return F.when(
        F.length(text) > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def deletions(text: Column, depth: int = 1) -> Column:
    """Deletion neighbourhood of a text.

    Two texts within edit distance k share at least one string of their
    k-deletion neighbourhoods, so an equi-join on these keys misses no pair.
    """
    keys = F.concat(F.array(text), _cut(text))
    for _ in range(depth - 1):
        keys = F.concat(keys, F.flatten(F.transform(_cut(text), _cut)))
    return F.array_distinct(keys)


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; shorter texts have none."""
    return F.when(
        F.length(text) >= n,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                lambda i: F.substring(text, i, F.lit(n)),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


# Names of at most this length are found through deletion keys, longer ones through trigrams.
SHORT = 8


def short_keys(text: Column, reach: int = 1) -> Column:
    """Deletion keys of a text that can be within ``reach`` edits of a short name."""
    return F.when(F.length(text) <= SHORT + reach, deletions(text)).otherwise(F.array().cast("array<string>"))


def long_keys(text: Column, reach: int = 1) -> Column:
    """Trigrams of a text that can be within reach of a long name.

    One edit cuts a name of nine letters into two parts with eight letters left,
    so one part keeps a trigram.  A ratio of at least 0.9 with two edits or more
    needs twenty letters in both names together and leaves a common block of
    three or more as well.
    """
    return F.when(F.length(text) > SHORT - reach, grams(text, 3)).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


# Sequence-match ratio of candidate pairs; order of the pair matters.  Marked
# non-deterministic so that the optimizer evaluates it once, not again in each filter.
ratio = _ratio.asNondeterministic()
