"""Numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """floor(x * 10^places + 1/2) / 10^places: halves go up, also below zero."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def tolerant_number(x: Column) -> Column:
    """A number, or text that holds one; blank or other text is null, never zero."""
    return F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")
