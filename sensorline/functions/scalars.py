"""Numbers, times and vectors as column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The number as a double, or null where it is null, NaN or infinite."""
    x = _column(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bad(c: Column | str) -> Column:
    """Whether a number is null, NaN or infinite."""
    return finite(c).isNull()


def epoch_ns(c: Column | str) -> Column:
    """A timestamp column as exact nanoseconds since 1970 (long)."""
    return F.unix_micros(_column(c).cast("timestamp")) * 1000


def clip(c: Column | str, low: float, high: float) -> Column:
    """The number held between two bounds; null stays null."""
    x = _column(c)
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Rounded with ties to the even digit."""
    return F.bround(_column(c), digits)


def number(c: Column | str) -> Column:
    """A double, or null where a text holds no number."""
    return _column(c).try_cast("double")


def short_hash(c: Column | str, digits: int = 6) -> Column:
    """The first digits of the SHA-1 of a text."""
    return F.substring(F.sha1(_column(c)), 1, digits)


def array_norm(c: Column | str) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(_column(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
