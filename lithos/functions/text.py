"""Text expressions: missing-value words, text cleaning, attribute keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a CSV reader of the pandas family treats as missing by
# default (public pandas documentation of ``read_csv(na_values=...)``), plus the empty field.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """Raw CSV text -> NULL when it is one of the missing-value words (exact match)."""
    c = _col(c)
    return F.when(c.isin(*NA_WORDS), F.lit(None).cast("string")).otherwise(c)


def clean_text(c, dtype=None) -> Column:
    """Null text -> '' and everything else -> its text form (PRJ-7).

    Booleans are spelled ``True``/``False`` as a pandas ``astype(str)`` would; Spark's own
    cast would give ``true``/``false``.
    """
    c = _col(c)
    from pyspark.sql.types import BooleanType

    if isinstance(dtype, BooleanType):
        txt = F.when(c, F.lit("True")).when(~c, F.lit("False"))
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit(""))


def attribute_key(c) -> Column:
    """Attribute key from an attribute name: lower case, blanks and '-' -> '_' (SCL-1)."""
    return F.regexp_replace(F.lower(_col(c)), "[ -]", "_")


def attribute_key_of(name: str) -> str:
    """Driver-side twin of :func:`attribute_key` for names known from the schema."""
    return re.sub(r"[ -]", "_", name.lower())
