"""Dense row numbers and equal-depth ranges, without sorting a table in one task.

Both range-partition the rows, write them once with their place in their
partition, and count the partitions.  The counts - one row a partition -
give each partition's offset; a row's number is its offset and its place.
What is written is read by all later steps, so a retried task changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bits of monotonically_increasing_id below the partition's number.
PLACE_BITS = 33


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _offsets(placed: DataFrame, part: str, rows) -> DataFrame:
    """(part, offset): rows before each partition.  At most one row a partition, so one small task adds them up."""
    counts = placed.groupBy(part).agg(rows.alias("_rows"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))


def number_rows(df: DataFrame, order_by, out_col: str, start: int = 1) -> DataFrame:
    """``df`` with the dense numbers ``start``, ``start`` + 1, ... in the order of ``order_by`` (nulls first), written.

    Rows that tie are numbered in the frame's own order.  That order also
    splits a hot value over partitions, so no value makes a task grow.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    rid, place, part = (_fresh(df, n) for n in ("_rid", "_place", "_part"))
    keys = [F.col(f"`{c}`") for c in order] + [F.col(rid)]
    ranged = df.withColumn(rid, F.monotonically_increasing_id()).repartitionByRange(_partitions(df), *keys)
    placed = materialize(ranged.sortWithinPartitions(*keys).drop(rid).withColumn(place, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(place, PLACE_BITS))
    offsets = _offsets(placed, part, F.count(F.lit(1)))
    within = F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    number = F.col("_offset") + within + F.lit(start)
    return placed.join(F.broadcast(offsets), part).select(*[F.col(f"`{c}`") for c in df.columns if c != out_col],
                                                          number.cast("long").alias(out_col))


def fill_keys(df: DataFrame, key: str, order_by, largest: int | None = None) -> DataFrame:
    """``df`` whose missing integer keys are numbered on from the largest one, as an auto-increment column does.

    ``key`` may be absent from ``df``.  Given keys stay; the others get dense
    numbers, in the order of ``order_by``, from one above the largest of
    ``largest`` (that of the target) and the given keys.
    """
    if key not in df.columns:
        return number_rows(df, order_by, key, (largest or 0) + 1)
    given = df.filter(F.col(f"`{key}`").isNotNull())
    top = given.agg(F.max(F.col(f"`{key}`").cast("long"))).first()[0]
    start = max(x for x in (top, largest, 0) if x is not None) + 1
    kind = df.schema[key].dataType
    numbered = number_rows(df.filter(F.col(f"`{key}`").isNull()).drop(key), order_by, key, start)
    columns = [F.col(f"`{c}`").cast(kind) if c == key else F.col(f"`{c}`") for c in df.columns]
    return given.unionByName(numbered.select(*[c.alias(n) for c, n in zip(columns, df.columns)]))


def equal_ranges(df: DataFrame, column: str, k: int) -> DataFrame:
    """(tile, low, high, rows) of ``k`` ranges with equally many rows: exact, for any ordered type, as ``ntile`` deals them.

    All ranks are found at once.  Equal values are counted first, so a value
    that a third of all rows hold is one row from there on; the distinct
    values are range-partitioned and written, and only rows of partitions that
    hold a wanted rank are numbered.  Nulls are left out; with fewer rows than
    ``k`` there are as many ranges as rows.
    """
    if k < 1:
        raise ValueError("the number of ranges must be 1 or more")
    values = df.select(F.col(f"`{column}`").alias("_v")).filter(F.col("_v").isNotNull())
    counted = values.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    pairs = materialize(counted.repartitionByRange(_partitions(df), "_v").withColumn("_p", F.spark_partition_id()))
    chunks = pairs.groupBy("_p").agg(F.sum("_n").alias("_rows"))
    everything = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunks = chunks.select("_p", "_rows", F.coalesce(F.sum("_rows").over(everything), F.lit(0)).alias("_off"),
                           F.sum("_rows").over(whole).alias("_all"))
    # the first n % k tiles have one row more; a chunk's tiles lie near its share of the rows
    base, more = F.floor(F.col("_all") / k), F.col("_all") % k
    near = F.sequence(F.greatest(F.floor(F.col("_off") * F.lit(float(k)) / F.col("_all")) - 1, F.lit(0)),
                      F.least(F.ceil((F.col("_off") + F.col("_rows")) * F.lit(float(k)) / F.col("_all")) + 1, F.lit(k - 1)))
    ends = chunks.select("_p", "_rows", "_off", base.alias("_base"), more.alias("_more"), F.explode(near).alias("_tile"))
    first = F.col("_tile") * F.col("_base") + F.least("_tile", "_more")
    size = F.col("_base") + (F.col("_tile") < F.col("_more")).cast("long")
    ends = ends.select("_p", "_rows", "_off", "_tile", first.alias("_first"), (first + size - 1).alias("_last"))
    inside = [(F.col(r) >= F.col("_off")) & (F.col(r) < F.col("_off") + F.col("_rows")) for r in ("_first", "_last")]
    wanted = ends.filter((F.col("_last") >= F.col("_first")) & (inside[0] | inside[1]))
    # a chunk has at most k tiles: its wanted ranks go with its values as one array
    wanted = wanted.groupBy("_p", "_off").agg(F.collect_list(F.struct("_tile", "_first", "_last")).alias("_ranks"))
    upto = F.col("_off") + F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
    numbered = pairs.join(F.broadcast(wanted), "_p").withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))

    def holds(rank):
        return (rank >= F.col("_from")) & (rank < F.col("_to"))

    hits = numbered.select("_v", "_from", "_to", F.explode(F.filter(
        "_ranks", lambda r: holds(r["_first"]) | holds(r["_last"]))).alias("r"))
    tiles = hits.groupBy(F.col("r._tile").alias("_tile"), (F.col("r._last") - F.col("r._first") + 1).alias("rows")).agg(
        F.max(F.when(holds(F.col("r._first")), F.col("_v"))).alias("low"), F.max(F.when(holds(F.col("r._last")), F.col("_v"))).alias("high"))
    return tiles.select((F.col("_tile") + 1).cast("long").alias("tile"), "low", "high", "rows")
