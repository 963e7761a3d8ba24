"""File scans: CSV (header, quoted newlines, missing-value tokens, encoding
fallback, type inference), Parquet, dispatch by extension, file listing."""

from __future__ import annotations

import codecs
import csv
import os
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from . import inference, split_csv


class UnsupportedFileError(ValueError):
    pass


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    # multiLine reads each file in one task; read_csv turns it on only for
    # encodings that can't be cut into lines.
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
    )


def has_multiline_records(spark: SparkSession, path: str) -> bool:
    """True when some record spans lines: only then does a physical line
    hold an odd number of quote characters (an escaped quote is a pair).

    A splittable, parallel scan of the raw lines that stops at the first
    such line."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return bool(lines.filter(quotes % 2 == 1).limit(1).count())


def _file_verdicts(spark: SparkSession, path: str, encoding: str | None) -> list[dict]:
    """What one splittable pass over the raw lines says of each file.

    ``encoding``: UTF-8 unless some line does not decode (then ISO-8859-1,
    which decodes any byte); ``multi_line``: some line has an odd number of
    quotes; ``names``: the header; ``cells``: the most cells of a line.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("top"), "value",
        F.monotonically_increasing_id().alias("n"))
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    unquoted = F.regexp_replace("value", '"[^"]*"', "")
    cells = F.length(unquoted) - F.length(F.translate(unquoted, ",", "")) + 1
    files = lines.groupBy("file").agg(
        # a set has the lines hashed by file as they come; with flags alone the header's text would have them all sorted first
        F.array_contains(F.collect_set(~F.is_valid_utf8("value")), True).alias("bad"),
        F.bool_or(quotes % 2 == 1).alias("multi_line"),
        F.hex(F.min_by(F.col("value").cast("binary"), F.when(F.col("top"), F.col("n")))).alias("header"),
        F.max(cells).alias("cells"),
    ).orderBy("file").collect()  # one row a file, as Spark's own listing holds
    out = []
    for r in files:
        codec = encoding or ("ISO-8859-1" if r["bad"] else "UTF-8")
        if r["multi_line"]:
            # reads no further than the header; with no value options it gives the names that a whole read would
            names = _reader(spark, codec, True).csv(_escaped(r["file"])).columns
        else:
            names = next(csv.reader([bytes.fromhex(r["header"]).decode(codec, "replace").removeprefix("\ufeff")]), [])
        out.append({"file": r["file"], "encoding": codec, "multi_line": r["multi_line"], "names": tuple(names), "cells": r["cells"]})
    return out


def _group(spark: SparkSession, files: list[str], codec: str, whole: bool, names: tuple) -> DataFrame:
    """Text cells of files with one encoding and header."""
    if whole and names and codecs.lookup(codec).name in split_csv.SPLITTABLE:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return split_csv.parse_records(split_csv.read_records(spark, files, codec), schema)
    return _reader(spark, codec, whole).csv(files)


def _escaped(file: str) -> str:
    """The path of a file's URL, with the characters escaped that a path pattern reads as wildcards."""
    return re.sub(r"([][{}*?\\])", r"\\\1", unquote(file))


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    multi_line: bool | None = None,
    infer_types: bool = True,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV files with a header row each.

    One pass over the raw lines decides for every file on its own: its
    encoding, whether records span lines (such files are cut into records by
    ``split_csv``, in as many tasks as others) and its header.  Files are
    grouped by these and put together by column name, so a folder may mix
    them.  A line with more cells than its header is an error, a short one is
    padded with nulls; in files whose records span lines surplus cells cannot
    be told apart by lines and are dropped.  A second pass infers the types.
    Only encodings other than UTF-8 and ISO-8859-1 are parsed whole by one
    task a file (``multiLine``).

    With ``schema``, or with both ``encoding`` and ``multi_line`` given, the
    first pass is left out and all files must have the same header.
    """
    if schema is not None:
        codec = encoding or "UTF-8"
        whole = has_multiline_records(spark, path) if multi_line is None else multi_line
        if whole and codecs.lookup(codec).name in split_csv.SPLITTABLE:
            typed = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            return split_csv.parse_records(split_csv.read_records(spark, path, codec), typed)
        return _reader(spark, codec, whole).schema(schema).csv(path)
    if encoding is not None and (multi_line is not None or codecs.lookup(encoding).name.startswith(("utf-16", "utf-32"))):
        raw = _reader(spark, encoding, bool(multi_line)).csv(path)
    else:
        groups: dict[tuple, list[str]] = {}
        for v in _file_verdicts(spark, path, encoding):
            whole = v["multi_line"] if multi_line is None else multi_line
            if not whole and v["cells"] > len(v["names"]):
                raise ValueError(f"{v['file']}: a line has {v['cells']} cells, the header {len(v['names'])}")
            groups.setdefault((v["encoding"], whole, v["names"]), []).append(_escaped(v["file"]))
        parts = [_group(spark, files, codec, whole, names) for (codec, whole, names), files in groups.items()]
        if not parts:
            return spark.read.option("header", True).csv(path)
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = inference.null_tokens(raw)
    return inference.infer_and_cast(df)[0] if infer_types else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null (missing values are null)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def scan(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file or folder by its extension (.csv, .parquet)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_csv(spark, path, **options)
    if ext == ".parquet":
        return read_parquet(spark, path)
    raise UnsupportedFileError(f"no reader for {ext or 'a path without extension'}; .csv and .parquet can be read")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def output_of(path: Column) -> Column:
    """The folder with an allowed extension that a file is a part of, as Spark writes a CSV or Parquet output; else the path."""
    kinds = "|".join(re.escape(e) for e in C.ALLOWED_EXTENSIONS)
    folder = F.regexp_extract(path, f"(?i)^(.*(?:{kinds}))/", 1)
    return F.when(folder == "", path).otherwise(folder)


def list_files(spark: SparkSession, directory: str, outputs: bool = False) -> DataFrame:
    """name, extension, size_bytes, modified for files with allowed
    extensions.  Only file metadata is read (the content column is pruned).

    ``outputs``: a folder with an allowed extension is one entry, of the size
    of all its parts, as :func:`scan` reads it as one table."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "length", "modificationTime")
    )
    if outputs:
        files = files.groupBy(output_of(F.col("path")).alias("path")).agg(
            F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    ext = extension_of(F.col("path"))
    return files.filter(ext.isin(*C.ALLOWED_EXTENSIONS)).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        ext.alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        F.col("path"),
    )
