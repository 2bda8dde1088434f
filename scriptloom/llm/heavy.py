"""The rows of the largest counts, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest(df: DataFrame, count_col: str, most: int) -> DataFrame:
    """The rows of ``df`` whose count reaches a threshold: the lowest of a fixed scale that at most ``most`` rows reach.

    The scale has eight steps for each doubling, so the rows of each step are
    few numbers to bring together.
    """
    step = F.floor(F.log2(count_col) * 8)
    steps = sorted(((r[0], r[1]) for r in df.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, None
    for s, n in steps:
        if total + n > most:
            break
        total, least = total + n, s
    return df.limit(0) if least is None else df.where(step >= least)
