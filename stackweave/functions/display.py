"""How values are shown: rounded numbers, sizes, a dash for what is not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
UNITS = ("B", "KB", "MB", "GB")


def number(value: Column, places: int = 0) -> Column:
    return F.coalesce(F.format_number(value, places), F.lit(DASH))


def size(value: Column) -> Column:
    """Bytes in the largest unit that leaves one or more."""
    out = F.concat(value.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[1:], 1):
        out = F.when(value >= 1024**i, F.concat(F.format_number(value / 1024**i, 1), F.lit(f" {unit}"))).otherwise(out)
    return F.coalesce(out, F.lit(DASH))


def second(value: Column) -> Column:
    """A timestamp to the second."""
    return F.date_trunc("second", value)


def epoch_ms(value: Column) -> Column:
    return F.unix_millis(value)


def rfc3339(text: Column) -> Column:
    """A timestamp of UTC text ``…Z`` or ``…+00:00``; other offsets are null."""
    return F.when(text.rlike(r"(Z|\+00:00)$"), F.try_to_timestamp(text))
