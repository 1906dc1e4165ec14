"""Numeric expressions: coercion of text to double, missing and finite tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_double(c, dtype: DataType | None = None) -> Column:
    """Text or number -> double; text that is not a number -> NULL (PRJ-8).

    Spark's cast accepts what a strict numeric parser rejects: a Java ``d``/``f`` suffix
    and hexadecimal floats. Those are guarded so ``'1d'`` and ``'0x1p3'`` become NULL.
    """
    c = _col(c)
    if dtype is not None and isinstance(dtype, NumericType):
        return c.cast("double")
    if dtype is not None and not isinstance(dtype, StringType):
        return c.cast("string").try_cast("double")
    t = F.trim(c)
    # the first character of a number, an infinity or a NaN; a cast of other text would fail, which costs far more
    likely = t.rlike(r"^[\x00-\x20]*[0-9+.iInN-]")
    bad = (t.rlike(r"[dDfF]$") & ~t.rlike(r"(?i)^[+-]?inf$")) | t.rlike(r"^[+-]?0[xX]")
    return F.when(~likely | bad, F.lit(None).cast("double")).otherwise(t.try_cast("double"))


def is_missing(c) -> Column:
    """NULL or NaN is missing; +-inf is not (N4)."""
    c = _col(c)
    return c.isNull() | F.isnan(c)


def not_missing(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c)


def is_finite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def invert(c, flag: bool) -> Column:
    """Sign flip of an angle or height (PRJ-9), or the value itself."""
    return -_col(c) if flag else _col(c)
