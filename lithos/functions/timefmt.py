"""Time formatting (SCL-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def iso_timestamp(c) -> Column:
    """Timestamp -> ISO-8601 text as Python's ``isoformat`` writes it: the fraction
    ``.ffffff`` only when the microseconds are not zero. NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    micros = F.date_format(c, "SSSSSS")
    base = F.date_format(c, ISO_SECONDS)
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
