"""Column expressions over text: Unicode folding, skeletons, rounding."""

from __future__ import annotations

import string

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from urlrisk import constants as C

_FROM = "".join(C.CONFUSABLES.values()) + "Σ"
_TO = "".join(letter * len(chars) for letter, chars in C.CONFUSABLES.items()) + "σ"


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def nfkc(text: Column) -> Column:
    """Unicode NFKC on the JVM; ASCII text, which NFKC never changes, skips the call."""
    folded = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(is_ascii(text), text).otherwise(F.coalesce(folded, text))


def idna(host: Column) -> Column:
    """ASCII (``xn--``) form of a Unicode host; a host that cannot be encoded is kept."""
    encoded = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))
    return F.when(is_ascii(host), host).otherwise(F.coalesce(encoded, host))


def skeleton(text: Column) -> Column:
    """Comparison skeleton: look-alike characters folded onto one ASCII letter."""
    folded = F.lower(F.translate(text, _FROM, _TO))
    for pair, letter in C.CONFUSABLE_PAIRS:
        folded = F.replace(folded, F.lit(pair), F.lit(letter))
    return folded


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one character.  Cheaper than a regular-expression count, which builds every match."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_class(text: Column, char_class: str) -> Column:
    """Characters of a regular-expression class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))


def count_special(text: Column) -> Column:
    """Characters that are not ASCII letters or digits."""
    return F.length(F.translate(text, string.ascii_letters + string.digits, ""))


def has_marker(label: Column) -> Column:
    return label.rlike(C.CONFUSABLE_MARKER)


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding of halves upward, as front-end arithmetic does."""
    scale = 10 ** digits
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + 0.5)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.rint(value) if digits == 0 else F.bround(value, digits)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def values(spark: SparkSession, ddl: dict[str, str], rows: list[tuple]):
    """A small literal table.

    SQL ``VALUES`` becomes a LocalRelation, so the optimizer knows its exact size.
    """
    def literal(value):
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(ddl)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in ddl.items())
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
