"""Scans in random order that end early."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaline.operators.sampling import uniform

#: How much larger each slice of the order is than all before it together.
GROWTH = 3
#: Rows of the first slice, as a multiple of what is asked for.
FIRST = 2


def accepted_in_order(rows: DataFrame, key: str, count: int, judge: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """The first ``count`` accepted rows in hash order of the key, with ``order``: their place in it.

    ``judge`` takes rows and returns the accepted ones, with their columns and any it adds; it may be
    costly (rendering, a model), so it runs on slices of the order only, each a few times larger than
    those before, until enough are accepted. ``store`` writes a slice's result and reads it
    again, so that nothing is judged twice. The rows are the same for any partitioning; where fewer
    are accepted than asked for, all rows were judged. Null keys take no part; of equal keys the rows tie.
    """
    placed = rows.where(F.col(key).isNotNull()).withColumn("order", uniform(F.col(key), seed))
    n = placed.count()
    found, low, have = None, 0.0, 0
    high = FIRST * count / n if n else 1.0
    while have < count and low < 1.0:
        high = min(1.0, high)
        piece = placed.where((F.col("order") >= low) & (F.col("order") < high)) if high < 1.0 else placed.where(F.col("order") >= low)
        judged = store(judge(piece))
        have += judged.count()
        found = judged if found is None else found.unionByName(judged)
        low, high = high, high * (1 + GROWTH)
    found = found if found is not None else judge(placed.limit(0))
    return found.orderBy("order", key).limit(count)
