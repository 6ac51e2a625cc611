"""Which labelled rows teach, and which only test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3; a null id does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
