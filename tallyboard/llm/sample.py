"""Samples of a bounded size whose cost doesn't grow with the number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, by: Column, size: int) -> DataFrame:
    """At most `size` rows, those of the smallest `by`, a hash.

    After a count, rows are cut to about twice as many by the hash alone, so that the sort gets no
    more from all tasks together. What is picked depends on the rows only, not on their layout.
    """
    n = rows.count()
    share = min(1.0, 2.0 * size / max(1, n))
    low = F.pmod(by, F.lit(1 << 40))
    return rows.where(low < int(share * (1 << 40))).orderBy(low, by).limit(size)
