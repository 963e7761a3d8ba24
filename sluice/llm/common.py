"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the Arrow batches in which texts go to Python and back.
#: Texts are long: Spark's default of 10,000 rows may be gigabytes.
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to the bounds above, where it is larger."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        current = spark.conf.get(key).removesuffix("b")
        if not current.isdigit() or not 0 < int(current) <= most:
            spark.conf.set(key, most)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(columns: Iterable[Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for the values of ``columns``.

    Null flags are hashed too, as Spark's hash skips nulls.  Rows with equal
    values share a key, so whatever depends on those values alone can be
    joined back by it without carrying texts through the join.
    """
    cols = list(columns)
    flags = [c.isNull() for c in cols]
    return F.xxhash64(*cols, *flags), F.xxhash64(F.lit(0x5BD1E995), *flags, *reversed(cols))


def blocks(batches: Iterable, text: int, max_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """(first-column values, texts) of consecutive rows, cut after ``max_bytes`` of text.

    Bounds what a task holds: a block has at most ``max_bytes`` plus one
    text.  A null text counts as empty.
    """
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(text).to_pylist()):
            t = t or ""
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= max_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
