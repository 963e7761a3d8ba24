"""Line dedup: windows of three consecutive lines that occur again are removed.

DataFrame operations only.  Every document is cut into lines at ``\\n``;
three lines that follow one another (blank lines between them are passed
over) form a window, known by two 64-bit hashes.  For each window the
occurrence of the smallest (document id, row key, line) is the first.  Of all
others the covered line positions, blanks inside included, are merged for
each document and taken out.

Windows of one document are few numbers a line, so what is shuffled to find
the repeats is narrow and pre-aggregated in each task.  The repeated windows
are written once, which lets Spark split a window that holds a large share
of all rows when it is joined back.

Defined cases: null texts stay null, and texts with under three lines that
aren't blank stay as they are.  A null id sorts before others.  Rows with
equal id and text count as one document and come back as often as they came.
A window that overlaps its own first occurrence is a later occurrence too.
A document may lose all its lines; its text is then empty.  Texts of any length
are read whole, an empty table gives no rows, and the names of the added
columns are the caller's to choose where a table has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, fresh, row_key, table

NOT_BLANK = "[^ \\t\\n\\x0B\\f\\r]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, not at each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _windows(text: Column) -> Column:
    """Array of (start, stop, h1, h2), one for each window of a text."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    filled = F.filter(numbered, lambda s: s["x"].rlike(NOT_BLANK))

    def window(lines: Column, j: Column) -> Column:
        three = [F.get(lines, j + k) for k in range(3)]
        texts = [s["x"] for s in three]
        return F.struct(three[0]["i"].alias("start"), three[2]["i"].alias("stop"),
                        F.xxhash64(*texts).alias("h1"), F.xxhash64(F.lit(0x27D4EB2F), *texts).alias("h2"))

    return _let(filled, lambda lines: F.when(
        F.size(lines) >= 3, F.transform(F.sequence(F.lit(0), F.size(lines) - 3), lambda j: window(lines, j))))


def later_windows(keyed: DataFrame) -> DataFrame:
    """(k1, k2, start, stop) of every window occurrence but the first, from (id, k1, k2, text)."""
    windows = keyed.select("id", "k1", "k2", F.explode(_windows(F.col("text"))).alias("w")).select(
        "id", "k1", "k2", "w.start", "w.stop", "w.h1", "w.h2")
    place = F.struct("id", "k1", "k2", "start")
    spread = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(spread.filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"))
    found = windows.join(repeated.hint("merge"), ["h1", "h2"])
    return found.filter(~place.eqNullSafe(F.col("first"))).select("k1", "k2", "start", "stop")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines",
                removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with its text less later occurrences, and two counts of lines added.

    Columns of these two names that ``docs`` has already are replaced.
    """
    docs = docs.drop(lines_col, removed_col)
    k1, k2 = row_key([col(id_col), col(text_col)])
    covered = later_windows(docs.select(col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"),
                                        col(text_col).alias("text")))
    spans = covered.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    a, b, s = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "spans")
    spans = spans.select(F.col("k1").alias(a + "_of"), F.col("k2").alias(b + "_of"), F.col("spans").alias(s))
    joined = docs.withColumns({a: k1, b: k2}).join(
        spans.hint("merge"), (col(a) == col(a + "_of")) & (col(b) == col(b + "_of")), "left")

    lines = F.split(col(text_col), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform(col(s), lambda x: F.sequence(x["start"], x["stop"]))))
    left = _let(lines, lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"))
    n_lines = F.when(F.length(col(text_col)) > 0, F.size(lines)).otherwise(0).cast("long")
    counted = joined.withColumns({
        lines_col: n_lines,
        removed_col: F.when(col(s).isNotNull(), F.size(gone)).otherwise(0).cast("long"),
        text_col: F.when(col(s).isNotNull(), left).otherwise(col(text_col)),
    })
    return counted.select(*[col(c) for c in docs.columns], col(lines_col), col(removed_col))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT * FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), windows AS (
  SELECT doc_id, i AS start, lead(i, 2) OVER w AS stop,
         line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS nth
  FROM windows WHERE stop IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM later WHERE nth > 1
), rest AS (
  SELECT l.doc_id, count(c.i) AS n_removed,
         coalesce(string_agg(CASE WHEN c.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
)
SELECT d.doc_id,
       CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END::BIGINT AS n_lines,
       coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       r.text
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id
"""
