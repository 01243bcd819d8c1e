"""Text helpers for display columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(c: Column | str, n: int, ellipsis: bool = True) -> Column:
    """First ``n`` characters, plus '...' when the text was longer."""
    col = F.col(c) if isinstance(c, str) else c
    cut = F.substring(col, 1, n)
    if not ellipsis:
        return cut
    return F.when(F.length(col) > n, F.concat(cut, F.lit("..."))).otherwise(col)
