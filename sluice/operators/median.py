"""Exact median per group, safe for hot groups, hot values and one global group.

The built-in ``median`` keeps every distinct value of a group in one
aggregation buffer, so a group holding a third of 100 TB - or a whole-column
median - would sit in one task.  Instead the values become a histogram:

1. equal (group, value) pairs are counted, with a map-side partial
   aggregate, so a value that holds a third of all rows is one row from here;
2. the distinct pairs are range-partitioned by (group, value) and written
   once with their partition number, so every reader sees the same parts;
3. a small table of chunks - one row per (partition, group), at most
   partitions + groups rows - gives each chunk's offset inside its group and
   the group size, hence the chunks that hold the middle ranks;
4. only those chunks are numbered by running counts, each at most one
   partition long, and the middle value or pair is averaged.

NaN and null values are skipped.  There is one plan for every input size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def exact_median(df: DataFrame, value: str, group_by=(), alias: str = "median") -> DataFrame:
    keys = [f"`{k}`" for k in group_by]
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    key_cols = [F.col(k) for k in keys]
    v = F.col(f"`{value}`").cast("double")
    data = df.select(*key_cols, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))

    pairs = data.groupBy(*key_cols, "_v").agg(F.count(F.lit(1)).alias("_n"))
    pairs = materialize(pairs.repartitionByRange(parts, *keys, "_v").withColumn("_p", F.spark_partition_id()))

    chunks = pairs.groupBy("_p", *key_cols).agg(F.sum("_n").alias("_rows"))
    group = Window.partitionBy(*key_cols)
    upto = F.sum("_rows").over(group.orderBy("_p"))
    chunks = chunks.withColumn("_off", upto - F.col("_rows")).withColumn("_all", F.sum("_rows").over(group))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = chunks.withColumn("_lo", low).withColumn("_hi", high).filter(
        (F.col("_hi") >= F.col("_off")) & (F.col("_lo") < F.col("_off") + F.col("_rows")))

    chunk_cols = [f"_c{i}" for i in range(len(keys))]
    middle = middle.select(F.col("_p").alias("_cp"), *[F.col(k).alias(c) for k, c in zip(keys, chunk_cols)],
                           "_off", "_lo", "_hi")
    same = [F.col("_p") == F.col("_cp"), *(F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, chunk_cols))]
    picked = pairs.join(middle, reduce(lambda a, b: a & b, same))
    last = F.col("_off") + F.sum("_n").over(Window.partitionBy("_p", *key_cols).orderBy("_v"))
    picked = picked.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))

    def at(rank: str):
        return F.max(F.when((F.col("_first") <= F.col(rank)) & (F.col(rank) < F.col("_last")), F.col("_v")))

    return picked.groupBy(*key_cols).agg(((at("_lo") + at("_hi")) / 2).alias(alias))
