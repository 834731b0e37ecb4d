"""Column functions that several operators share. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null for an empty whole."""
    return F.when(whole > 0, part / whole)


def capped(value: Column) -> Column:
    """A value up to 1; null stays null, where ``least`` alone would give 1."""
    return F.when(value.isNotNull(), F.least(F.lit(1.0), value))


def weighted_mean(pairs: list[tuple[float, Column]], digits: int = 6) -> Column:
    """Mean of the values that are known, by their weights; null if none is."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in pairs[1:]), F.when(pairs[0][1].isNotNull(), F.lit(pairs[0][0])).otherwise(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for w, c in pairs[1:]), F.coalesce(pairs[0][1] * pairs[0][0], F.lit(0.0)))
    return F.when(total > 0, F.round(value / total, digits))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a camel- or snake-case name."""
    split = F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_extract_all(split, F.lit("[a-z]+"), F.lit(0))


def mentions(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def stable_id(*parts: Column, length: int = 12) -> Column:
    """First hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, length)


def source_kind(path: Column) -> Column:
    """test, example or production from a path. A stem that holds ``test`` anywhere counts as a test, also ``latest.c``."""
    return F.when(path.rlike(r"(?i)(^|/)tests?/|tests?[^/]*$"), "test").when(path.rlike(r"(?i)(^|/)(examples?|demos?|samples?)/"), "example").otherwise("production")
