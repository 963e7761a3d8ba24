"""Repeats of a key: which rows are not the first occurrence of their key.

A window partitioned by the key would pull a hot key - one value may hold a
third of all rows, nulls included - into a single task, and so would a join
on the key.  Instead:

1. rows are counted for each (key, order value), then the first one of each
   key is taken; both are aggregated map-side, so a hot key costs one
   partial row per task and order value;
2. rows are joined to these firsts on *(key, order value)*.  A hot key's
   rows differ in their order value, so they spread over all partitions like
   any others: no salt, no broadcast and no switch on sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_repeats(df: DataFrame, keys, order_col: str, out_col: str, lookup: DataFrame | None = None) -> DataFrame:
    """``df`` plus ``out_col``: true for every row but the first of its key.

    Null key values are one key, as duplicate detection treats missing
    values as equal.  Where rows of one key tie in ``order_col``, the first
    in the frame's own order (``monotonically_increasing_id``) counts as the
    first; that needs a frame whose rows come in the same order each time it
    is read, such as a file scan.  Without ties the frame's order is not used.
    ``lookup`` is a frame of the same rows to find the firsts in, for callers
    that count the rows of ``df`` as they pass.
    """
    keys = list(keys)
    rid = out_col + "_rid"
    rows = df.withColumn(rid, F.monotonically_increasing_id())
    seen = (df if lookup is None else lookup).withColumn(rid, F.monotonically_increasing_id())
    names = [f"_k{i}" for i in range(len(keys))]
    places = seen.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
                          F.col(f"`{order_col}`").alias("_order")).agg(
        F.count(F.lit(1)).alias("_ties"), F.min(rid).alias("_rid"))
    firsts = places.groupBy(*names).agg(F.min(F.struct("_order", "_ties", "_rid")).alias("_first")).select(
        *names, "_first.*")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    same.append(F.col(f"`{order_col}`").eqNullSafe(F.col("_order")))
    joined = rows.join(firsts, reduce(lambda a, b: a & b, same), "left")
    repeat = F.col("_ties").isNull() | ((F.col("_ties") > 1) & (F.col(rid) != F.col("_rid")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], repeat.alias(out_col))
