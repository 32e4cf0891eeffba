"""Joins of wide rows with narrow tables, by way of the narrow table's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint

#: Rows of a few numbers that may be broadcast: about 40 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def narrow(df: DataFrame) -> DataFrame:
    """A checkpointed table of a few numbers a row, to be broadcast up to BROADCAST_ROWS and shuffled beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of ``df`` with distinct ``ids``."""
    return df.join(narrow(checkpoint(ids)), key, how)
