"""Row counts, size-checked broadcasts and distinct identifiers, shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few longs a row) is sent to every executor.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has few rows, else unchanged (shuffled join)."""
    return F.broadcast(df) if df.count() <= rows else df
