"""CSV files whose quoted cells hold line breaks, read in many tasks.

Whether a line starts a record depends on every quote before it, so such a
file is usually parsed by one task from its first byte.  Here Spark reads the
lines in splits as they come, and record starts are found by speculation:

1. each split runs the quote automaton over its lines twice, once as if it
   began outside and once as if it began inside a quoted cell, and gives the
   pair of states it would end in (the two runs mostly meet soon);
2. the pairs of a file's splits, in order, are functions; applying them one
   after the other from "outside" gives the true state at each split's start;
3. each split is cut into records from its true state.  The lines before its
   first record start and its last, unfinished record are fragments, at most
   two a split, which are put together by their order in the file;
4. records are parsed one by one by Spark's own CSV expression.

The cut records are written once to the checkpoint folder, so that type
inference and the read itself see the same splits.  What the tasks get of
step 2 is one 64-bit number for each split (6.4 MB for 100 TB in splits of
128 MB), refused above ``MOST_SPLITS``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Splits of one scan; beyond it the split size should be raised.
MOST_SPLITS = 16_000_000
#: Encodings in which a byte of a line break or quote is no part of another character, and which Spark decodes.
SPLITTABLE = ("utf-8", "iso8859-1", "ascii")


def open_at_end(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted cell is open after ``line``, given whether one was open before it.

    A quote opens a cell only as its first character; two quotes inside stand
    for one; after a closing quote the cell goes on to the next separator.
    """
    at = 0
    while True:
        if inside:
            close = line.find('"', at)
            while close >= 0 and line.startswith('"', close + 1):
                close = line.find('"', close + 2)
            if close < 0:
                return True
            at = line.find(sep, close + 1) + 1
            if at == 0:
                return False
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
        else:
            at = line.find(sep + '"', at) + 1
            if at == 0:
                return False


def _lines(spark: SparkSession, paths, codec: str) -> DataFrame:
    value = F.col("value")
    if codec.lower() not in ("utf-8", "utf8"):
        value = F.decode(value.cast("binary"), codec)
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def _parts(batches):
    """(file, block, values) of consecutive lines of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield int(where[0, a]), int(where[1, a]), batch.column(2).slice(a, b - a)


def _split_functions(sep: str):
    """(file, block, state at the end if begun outside, if begun inside) of each split of a task."""
    def run(batches):
        now, states = None, (False, True)
        done: list = []
        for file, block, values in _parts(batches):
            if (file, block) != now:
                if now is not None:
                    done.append((*now, *states))
                now, states = (file, block), (False, True)
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                first = open_at_end(line, states[0], sep)
                states = (first, first if states[0] == states[1] else open_at_end(line, states[1], sep))
        if now is not None:
            done.append((*now, *states))
        columns = list(zip(*done)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["file", "block", "from_outside", "from_inside"])

    return run


def split_starts(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(file, block, inside) of every split: whether it starts in a quoted cell."""
    functions = lines.mapInArrow(_split_functions(sep), "file long, block long, from_outside boolean, from_inside boolean")
    # one small row a split, gathered by file as Spark's own listing of it is
    by_file = functions.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "from_outside", "from_inside"))).alias("s"))
    nothing = F.struct(F.lit(False).alias("at"), F.array().cast("array<boolean>").alias("starts"))
    walked = F.aggregate("s", nothing, lambda got, f: F.struct(
        F.when(got["at"], f["from_inside"]).otherwise(f["from_outside"]).alias("at"),
        F.array_append(got["starts"], got["at"]).alias("starts")))
    return by_file.select("file", F.inline(F.arrays_zip(F.col("s.block").alias("block"), walked["starts"].alias("inside"))))


def _keys(files: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Even numbers that stand for splits."""
    mixed = files.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + blocks.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(29))) << np.uint64(1)


def _cut_records(states: np.ndarray, sep: str):
    """(file, block, kind, first, record) of whole records and fragments; ``states`` are sorted keys with the state in the last bit."""
    def start(file: int, block: int) -> bool:
        key = _keys(np.array([file]), np.array([block]))[0]
        at = int(np.searchsorted(states, key))
        if at == len(states) or states[at] & ~np.uint64(1) != key:
            raise RuntimeError(f"a split at byte {block} that the first pass did not have")
        return bool(states[at] & np.uint64(1))

    def batch_of(file, block, kinds, firsts, records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(kinds, pa.string()),
             pa.array(firsts, pa.bool_()), records if isinstance(records, pa.Array) else pa.array(records, pa.string())],
            names=["file", "block", "kind", "first", "record"])

    def run(batches):
        now, inside, held, kind, top = None, False, [], "", False

        def rest():
            """What is left of a split at its end: the head of a record or the middle of one."""
            return batch_of(*now, [kind], [top and kind == "tail"], ["\n".join(held)])

        for file, block, values in _parts(batches):
            if (file, block) != now:
                if held:
                    yield rest()
                now, inside, held = (file, block), start(file, block), []
                kind, top = ("head" if inside else "tail"), block == 0
            quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
            if not inside and not len(quoted):  # each line is a record
                firsts = [top] + [False] * (len(values) - 1)
                yield batch_of(file, block, ["record"] * len(values), firsts, values)
                top = False
                continue
            lines = values.to_pylist()
            out: list[list] = [[], [], []]
            quotes = set(quoted.tolist())
            for k, line in enumerate(lines):
                held.append(line)
                if k in quotes:
                    inside = open_at_end(line, inside, sep)
                if not inside:
                    out[0].append("record" if kind == "tail" else "head")
                    out[1].append(top and kind == "tail")
                    out[2].append("\n".join(held))
                    top = top and kind != "tail"
                    held, kind = [], "tail"
            if out[0]:
                yield batch_of(file, block, *out)
        if held:
            yield rest()

    return run


def _stitched(fragments: DataFrame) -> DataFrame:
    """Records put together from the fragments of a file's splits: an unfinished one and all heads up to the next."""
    in_file = Window.partitionBy("file").orderBy("block", F.col("kind") == "tail")
    numbered = fragments.withColumn("number", F.sum((F.col("kind") == "tail").cast("long")).over(in_file))
    parts = numbered.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p"), F.bool_or("first").alias("first"))
    return parts.select("file", F.array_join("p.record", "\n").alias("record"), "first")


def read_records(spark: SparkSession, paths, codec: str, sep: str = ",") -> DataFrame:
    """(file, record, first) of the CSV files: every record's text, and whether it is its file's first one."""
    lines = _lines(spark, paths, codec)
    starts = split_starts(lines, sep)
    found = starts.limit(MOST_SPLITS + 1).toArrow()  # one row a split
    if found.num_rows > MOST_SPLITS:
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes")
    states = np.sort(_keys(*(found[c].to_numpy() for c in ("file", "block"))) | found["inside"].to_numpy().astype(np.uint64))
    cut = materialize(lines.mapInArrow(_cut_records(states, sep),
                                       "file long, block long, kind string, first boolean, record string"))
    whole = cut.filter("kind = 'record'").select("file", "record", "first")
    return whole.unionByName(_stitched(cut.filter("kind != 'record'")))


def parse_records(records: DataFrame, schema: T.StructType, sep: str = ",") -> DataFrame:
    """The cells of records below the header: short records are padded with nulls, surplus cells dropped."""
    text: Column = F.regexp_replace("record", "\r$", "")
    body = records.filter(~F.col("first") & (F.trim(text) != ""))
    # the parser must see the same column names as the frame, whatever characters they hold
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.fields)
    options = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    cells = body.select(F.from_csv(text, ddl, options).alias("r"))
    return cells.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])
