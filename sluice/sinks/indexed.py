"""Range-clustered tables with a small index of their files, and lookups that open few of them.

A table is written sorted by its key, each file a range of keys.  The index has
one row a file: for each indexed column the smallest and largest value and a
Bloom filter.  A lookup reads the index, and then only files whose range and
filter allow one of the wanted values; the footers of other files are not
opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a file's filter, and places that a value sets.  For n different values in a file about
#: (1 - exp(-3 n / BLOOM_BITS)) ** 3 of the absent values are not ruled out: 2 % at 100,000.
BLOOM_BITS = 1 << 20
PLACES = 3
INDEX = "_index"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _places(value: Column) -> list[Column]:
    """Places of a value in a filter; values of one text form are one."""
    return [F.pmod(F.xxhash64(value.cast("string"), F.lit(k)), F.lit(BLOOM_BITS)).cast("long") for k in range(PLACES)]


def write_indexed(df: DataFrame, path: str, key: str, index_columns=(), files: int | None = None) -> None:
    """Writes ``df`` sorted by ``key`` into ``files`` ranges, and the index of ``key`` and ``index_columns``.

    Rows with equal keys are dealt on by the index columns, so that a hot key may fill several files.
    """
    columns = list(dict.fromkeys([key, *index_columns]))
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [_q(c) for c in columns]
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    build_index(df.sparkSession, path, columns)


def build_index(spark: SparkSession, path: str, columns) -> None:
    """One pass over the indexed columns.  A filter is gathered as its non-zero words, at most BLOOM_BITS / 64 a file."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), *map(_q, columns))
    ranges = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *[
        f(_q(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))])
    marks = []
    for i, c in enumerate(columns):
        place = rows.filter(_q(c).isNotNull()).select("file", F.explode(F.array(*_places(_q(c)))).alias("p"))
        words = place.groupBy("file", F.shiftright("p", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        marks.append(words.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(f"bloom_{i}")))
    index = reduce(lambda a, b: a.join(b, "file", "left"), marks, ranges)
    index.write.mode("overwrite").parquet(f"{path}/{INDEX}")


def files_with(spark: SparkSession, path: str, columns, column: str, values: list) -> list[str]:
    """Files that may hold one of ``values`` (a list that the caller holds anyway) in an indexed column."""
    i = list(columns).index(column)
    index = spark.read.parquet(f"{path}/{INDEX}")

    def may_hold(value) -> Column:
        wanted = F.lit(value).cast(index.schema[f"low_{i}"].dataType)
        words = [F.coalesce(F.element_at(f"bloom_{i}", F.shiftright(p, 6)), F.lit(0).cast("long")) for p in _places(wanted)]
        bits = [F.getbit(w, (p % 64).cast("int")) == 1 for w, p in zip(words, _places(wanted))]
        return reduce(lambda a, b: a & b, bits, (F.col(f"low_{i}") <= wanted) & (F.col(f"high_{i}") >= wanted))

    if not values:
        return []
    return [r[0] for r in index.filter(reduce(lambda a, b: a | b, map(may_hold, values))).select("file").orderBy("file").collect()]


def lookup(spark: SparkSession, path: str, columns, column: str, values: list) -> DataFrame:
    """Rows whose ``column`` is one of ``values``, from the files that may hold one."""
    files = files_with(spark, path, columns, column, values)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(path).limit(0)
    return rows.filter(_q(column).isin(values) if values else F.lit(False))
