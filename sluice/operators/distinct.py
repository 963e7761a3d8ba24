"""Distinct counts of many columns at once, and top values, from partial sets and summaries held in the tasks.

``count_distinct`` over several columns makes Spark copy every row once for
each column.  Here a task keeps a partial set of each column's values, in
bounded memory, and sends only values it has not sent lately; the sets are
counted in two stages, by value and then by column, so a hot group or value is
never held by one task.  The sketches are Spark's own mergeable ones.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..session import materialize

#: Values of all columns that a task's partial sets hold before they are sent.
SET_VALUES = 1 << 18
#: Counters of a task's summary for top values, and candidates that are counted exactly.
COUNTERS = 1 << 13
#: Buckets (as a power of two) of a sketch; the standard error is 1.04 / sqrt(2 ** SKETCH_BITS), 1.6 %.
SKETCH_BITS = 12


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def value_key(df: DataFrame, name: str) -> Column:
    """A column as what its values are told apart by: text by its digest, NaN missing, both zeros one."""
    c, kind = _q(name), df.schema[name].dataType
    if isinstance(kind, casts.FLOATING_TYPES):
        return F.when(~F.isnan(c), c + F.lit(0).cast(kind))
    if casts.is_string(kind):
        return F.sha2(c.cast("binary"), 256)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(c.isNotNull(), F.sha2(F.to_json(F.struct(c.alias("v"))).cast("binary"), 256))
    return c


def _partial_sets(n_keys: int, n_columns: int, most: int):
    """(key columns, number of the column, value as text) of the values of a task, most of them once."""
    def run(batches):
        held: list[list[pa.Table]] = [[] for _ in range(n_columns)]
        size = 0

        def table_of(batch, i):
            names = [f"k{j}" for j in range(n_keys)]
            columns = [batch.column(j) for j in range(n_keys)] + [batch.column(n_keys + i)]
            part = pa.table(columns, names=[*names, "v"])
            part = part.filter(pc.is_valid(part["v"]))
            return part.group_by([*names, "v"]).aggregate([])

        def flush():
            for i in range(n_columns):
                if held[i]:
                    whole = pa.concat_tables(held[i])
                    whole = whole.group_by(whole.column_names).aggregate([])
                    for part in whole.to_batches(max_chunksize=10_000):
                        keys = [part.column(j) for j in range(n_keys)]
                        text = part.column(n_keys)
                        yield pa.RecordBatch.from_arrays(
                            [*keys, pa.array([i] * len(part), pa.int32()), text.cast(pa.string())],
                            names=[*(f"k{j}" for j in range(n_keys)), "i", "v"])
                held[i] = []

        for batch in batches:
            for i in range(n_columns):
                held[i].append(table_of(batch, i))
                size += held[i][-1].num_rows
            if size >= most:
                # values that repeat a lot melt here; what stays large is sent
                for i in range(n_columns):
                    whole = pa.concat_tables(held[i])
                    held[i] = [whole.group_by(whole.column_names).aggregate([])]
                size = sum(h[0].num_rows for h in held)
                if size >= most // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def distinct_counts(df: DataFrame, columns, group_by=(), prefix: str = "d") -> DataFrame:
    """(group keys, d0, d1, ...): exact numbers of different non-missing values of each column, by group.

    Columns may be of any type; without ``group_by`` there is one row, also
    for an empty table.  Groups that have no value in any column are missing.
    """
    columns, keys = list(columns), list(group_by)
    staged = df.select(*[_q(k).alias(f"k{j}") for j, k in enumerate(keys)],
                       *[value_key(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    # what is told apart by text travels as text, timestamps as numbers
    plain = [F.col(f"v{i}").cast("string") if not isinstance(staged.schema[f"v{i}"].dataType, (T.NumericType, T.BooleanType))
             else F.col(f"v{i}") for i in range(len(columns))]
    staged = staged.select(*[f"k{j}" for j in range(len(keys))], *plain)
    kinds = "".join(f"k{j} {staged.schema[f'k{j}'].dataType.simpleString()}, " for j in range(len(keys)))
    sets = staged.mapInArrow(_partial_sets(len(keys), len(columns), SET_VALUES), f"{kinds}i int, v string")
    names = [f"k{j}" for j in range(len(keys))]
    counted = sets.distinct().groupBy(*names, "i").agg(F.count(F.lit(1)).alias("n"))
    wide = counted.groupBy(*names).agg(*[F.coalesce(F.sum(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).cast("long").alias(f"{prefix}{i}")
                                         for i in range(len(columns))])
    return wide.select(*[F.col(f"k{j}").alias(k) for j, k in enumerate(keys)], *[f"{prefix}{i}" for i in range(len(columns))])


def distinct_sketches(df: DataFrame, columns, group_by=()) -> DataFrame:
    """(group keys, column_name, sketch): mergeable sketches, to be kept for each partition of a table."""
    columns, keys = list(columns), list(group_by)
    each = df.groupBy(*map(_q, keys)).agg(*[
        F.hll_sketch_agg(value_key(df, c).cast("string"), F.lit(SKETCH_BITS)).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return each.select(*map(_q, keys), F.inline(rows))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """(column_name, distinct) of sketches put together, within about 5 % (three standard errors of 1.6 %)."""
    return sketches.groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def _summaries(counters: int):
    """(value, n, lost): a task's Misra-Gries summary; ``lost`` is what any count may lack, on a row without a value."""
    def run(batches):
        held, lost = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.table({"value": batch.column(0)}).group_by("value").aggregate([([], "count_all")]).rename_columns(["value", "n"])
            held = part if held is None else pa.concat_tables([held, part]).group_by("value").aggregate([("n", "sum")]).rename_columns(
                ["value", "n"])
            if held.num_rows > counters:
                least = pc.sort_indices(held["n"], sort_keys=[("", "descending")])[counters].as_py()
                less = held["n"][least].as_py()
                lost += less
                held = held.filter(pc.greater(held["n"], less))
                held = held.set_column(1, "n", pc.subtract(held["n"], less))
        kinds = pa.schema([("value", pa.string()), ("n", pa.int64()), ("lost", pa.int64())])
        rows = held if held is not None else pa.table({"value": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        out = rows.append_column("lost", pa.array([0] * rows.num_rows, pa.int64())).cast(kinds)
        yield from out.to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([lost], pa.int64())],
                                         schema=kinds)

    return run


def heavy_values(values: DataFrame, k: int, counters: int | None = None) -> tuple[DataFrame, str]:
    """((value, count) of the ``k`` most frequent values, how they were found); ties by value.

    ``values`` has one text column without nulls.  The summaries of all tasks
    give each value a count that lacks at most ``lost`` in total.  If the k-th
    largest is above ``lost``, no value outside the summaries can be among the
    first k, and those that can are counted exactly in a second pass (none is
    needed if nothing was lost).  Else the values are too even for summaries,
    and all are counted.
    """
    counters = counters or COUNTERS
    name = values.columns[0]
    texts = values.select(_q(name).cast("string").alias("value"))
    parts = materialize(texts.mapInArrow(_summaries(counters), "value string, n long, lost long"))
    merged = parts.filter("value is not null").groupBy("value").agg(F.sum("n").alias("n"))
    lost = parts.agg(F.sum("lost")).first()[0] or 0
    order = [F.desc("count"), F.asc("value")]
    if lost == 0:
        return merged.select("value", F.col("n").alias("count")).orderBy(*order).limit(k), "summaries"
    first = [r["n"] for r in merged.orderBy(F.desc("n")).limit(k).collect()]  # k numbers
    floor = first[-1] if len(first) == k else 0
    wanted = merged.filter(F.col("n") + lost >= floor).select("value")
    if floor > lost and wanted.limit(counters + 1).count() <= counters:
        found = texts.join(F.broadcast(wanted), "value").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        return found.orderBy(*order).limit(k), "candidates"
    return texts.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(*order).limit(k), "all"


def join_counts(left: DataFrame, counts: DataFrame, keys) -> DataFrame:
    """``left`` with the columns of ``counts``: by group keys (not null), or the one row of each."""
    if not keys:
        return left.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")
    names = [f"_d{j}" for j in range(len(keys))]
    named = reduce(lambda d, x: d.withColumnRenamed(*x), zip(keys, names), counts)
    same = reduce(lambda a, b: a & b, [_q(k) == F.col(n) for k, n in zip(keys, names)])
    return left.join(named, same, "left").drop(*names)
