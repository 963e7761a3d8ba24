"""Quality rules: counts of words, symbols and repeats, and robust multivariate outliers.

Every document gets base counts from its whole text.  Documents that pass the
base rules are then compared with their own language and source: five
statistics are transformed, their centre and scatter are estimated by the
minimum covariance determinant (the ``SUPPORT`` share of rows whose
covariance has the smallest determinant), and rows whose Mahalanobis distance
is beyond ``CUTOFF`` are rejected.

The estimate runs as Spark aggregates.  A concentration step is one join of
the (narrow) statistics with the groups' current estimates, a histogram of
distances for each group that finds the distance of the nearest ``SUPPORT``
of its rows, and exact integer sums over those rows.  Statistics are held in
integer thousandths, so sums do not depend on the order of tasks.  No group
is ever held by one task: a group costs one partial row a task and histogram
bin.

Defined cases: a null text has no words and fails the base rules.  Null
languages or sources are values of their own.  A language and source with
fewer than ``MIN_ROWS`` passing rows is judged with its whole language, large sources
included, and a language with fewer with all rows of all languages; with fewer than that in all, nothing
beyond the base rules is rejected.  Repeated rows get equal verdicts, every
one of them is returned.  An empty table gives an empty result.  Texts of any length are counted whole;
columns with the names used inside keep their values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, col, fresh, row_key

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

STATS = ("x_word_len", "x_symbols", "x_repeats", "x_dup_lines", "x_upper")
P = len(STATS)
#: Smallest standard deviation of each statistic, in thousandths: rates that are
#: zero in most rows would else have no spread at all.
FLOOR = (40, 60, 120, 120, 60)
#: Words and lines without repeats that each text is taken to have besides its own, in the rates of repeats:
#: these are zero in most texts, and one repeated line of a short text would else be an outlier.
PRIOR_WORDS = 50
PRIOR_LINES = 5
SUPPORT = 0.75
#: 0.75 quantile of chi-squared with 5 degrees of freedom, to which distances are scaled.
CHI2_SUPPORT = 6.6257
#: Squared distance beyond which a row is an outlier: 0.999 quantile of chi-squared with 5 degrees of freedom.
CUTOFF = 20.515
MIN_ROWS = 60
C_STEPS = 4
#: Histogram bins for each doubling of the distance.
BINS = 16

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``."""
    if not text:
        return (0,) * len(_COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at exactly the six SPACES
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines, dup = 0, 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text.encode().translate(None, _NOT_LETTERS))
    lower = text.lower()
    upper = 0 if lower == text else sum(a != b for a, b in zip(text, lower)) if len(lower) == len(text) else sum(
        map(str.isupper, text))
    return (len(words), chars, symbols, dup, _repeat_words(words), lines, upper, letters)


_NOT_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k == n:
        return 0
    if k < 2_000_000:  # k ** 3 fits into 63 bits
        codes = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        codes = pairs * k + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def _count_batches(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        counts = np.array([text_counts(t) for t in texts], np.int64).reshape(len(texts), len(_COUNTS))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(counts[:, j]) for j in range(len(_COUNTS)))],
            names=[*batch.schema.names[:-1], *_COUNTS])


def _statistics() -> list[Column]:
    """The transformed statistics, as integer thousandths."""
    words, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    exprs = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_repeat_words") / (words + PRIOR_WORDS)),
        F.sqrt(F.col("n_dup_lines") / (n_lines + PRIOR_LINES)),
        F.sqrt(F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))),
    )
    return [F.round(e * 1000).cast("long").alias(name) for e, name in zip(exprs, STATS)]


def _estimates(moments: pd.DataFrame) -> pd.DataFrame:
    """Centre and inverse scatter for each row of integer moments."""
    out = []
    for row in moments.itertuples(index=False):
        r = row._asdict()
        n = float(r["n"])
        mean = np.array([r[f"s{i}"] / n for i in range(P)])
        cov = np.empty((P, P))
        for i in range(P):
            for j in range(i, P):
                cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / n - mean[i] * mean[j]
        out.append((r["g"], mean.tolist(), np.linalg.inv(cov + np.diag(np.square(FLOOR).astype(float))).ravel().tolist()))
    return pd.DataFrame(out, columns=["g", "mean", "inv"])


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)),
            *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P))]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    diff = [F.col(s) - F.col("mean")[i] for i, s in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1 if i == j else 2) * diff[i] * diff[j] * F.col("inv")[i * P + j]
    return total


def _nearest(rows: DataFrame) -> DataFrame:
    """For each group g, the bin of the distance within which ``SUPPORT`` of its rows lie."""
    bins = rows.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")  # a bounded number of bins a group, not its rows
    bins = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    return bins.filter(F.col("upto") >= SUPPORT * F.col("all")).groupBy("g").agg(F.min("bin").alias("edge"))


def _binned(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    near = rows.join(estimates, "g").withColumn("d2", F.greatest(_distance(), F.lit(1e-6)))
    return near.withColumn("bin", F.floor(F.log2("d2") * BINS).cast("int"))


def fit_mcd(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant for each group: (g, mean, inv, scale).

    ``rows`` has g and ``STATS`` and should be cheap to read again.  Starts
    from the median and the median absolute deviation of each statistic
    (both exact: the statistics are integers of a small range, so Spark's
    percentile holds a bounded count of values).
    """
    middle = rows.groupBy("g").agg(*(F.percentile(s, 0.5).alias(f"m{i}") for i, s in enumerate(STATS)))
    spread = rows.join(middle, "g").groupBy("g").agg(
        F.array(*(F.first(f"m{i}") for i in range(P))).alias("mean"),
        *(F.percentile(F.abs(F.col(s) - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i, s in enumerate(STATS)))
    inv = [F.lit(0.0) if i != j else 1.0 / (F.pow(F.col(f"d{i}") * 1.4826, 2) + float(FLOOR[i] ** 2))
           for i in range(P) for j in range(P)]
    estimates = materialize(spread.select("g", "mean", F.array(*inv).alias("inv")))
    for _ in range(C_STEPS):
        near = _binned(rows, estimates)
        inner = near.join(_nearest(near), "g").filter(F.col("bin") <= F.col("edge"))
        moments = inner.groupBy("g").agg(*_moments())
        estimates = materialize(moments.mapInPandas(
            lambda parts: (_estimates(p) for p in parts), "g string, mean array<double>, inv array<double>"))
    edges = _nearest(_binned(rows, estimates))
    # at least 1: where most rows are alike, the floors of the scatter are the unit of distance
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("edge") + 1) / BINS) / CHI2_SUPPORT)
    return estimates.join(edges, "g").select("g", "mean", "inv", scale.alias("scale"))


def _groups(passed: DataFrame) -> DataFrame:
    """For each language and source, the group that its rows are judged with (null: too few rows at all).

    ``fits`` has every group that its rows are fed to: their own, and those of the whole language and
    of all rows wherever some small source or language is judged with them.
    """
    n = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    lang = Window.partitionBy("lang")
    counted = n.withColumns({"n_lang": F.sum("n").over(lang), "least": F.min("n").over(lang), "k": F.lit(1)})
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.min("n_lang").alias("least_lang"),
                        F.lit(1).alias("k"))
    # arrays, as a struct's JSON leaves out nulls: a null source would be its whole language
    own, whole, every = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("all")
    few, few_lang = F.col("n") < MIN_ROWS, F.col("n_lang") < MIN_ROWS
    g = F.when(~few, own).when(~few_lang, whole).when(F.col("n_all") >= MIN_ROWS, every)
    fits = F.array_compact(F.array(F.when(~few, own), F.when(~few_lang & (F.col("least") < MIN_ROWS), whole),
                                   F.when(F.col("least_lang") < MIN_ROWS, every)))
    return counted.join(total, "k").select("lang", "source", g.alias("g"), fits.alias("fits"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: its id, counts, statistics, squared distance and verdict.

    Returns ``doc_id``, the counts, ``base_failed``, ``distance`` (null where
    the base rules decide alone) and ``kept``, and ``k1``/``k2``, the key of
    (id, language, source, text) that :func:`keep` joins on.
    """
    values = [col(c) for c in (id_col, lang_col, source_col, text_col)]
    k1, k2 = row_key(values)
    narrow = docs.select(col(id_col).alias("doc_id"), col(lang_col).cast("string").alias("lang"),
                         col(source_col).cast("string").alias("source"), k1.alias("k1"), k2.alias("k2"),
                         col(text_col).alias("text"))
    schema = ", ".join([f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang string, source string, "
                        "k1 long, k2 long", *(f"{c} long" for c in _COUNTS)])
    bound_batches(docs.sparkSession)
    counted = narrow.mapInArrow(_count_batches, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed).select("*", *_statistics()))

    passed = counted.filter(~F.col("base_failed"))
    groups = materialize(_groups(passed)).filter(F.col("g").isNotNull()).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g", "fits")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    member = passed.select("lang", "source", *STATS).join(groups, same).select(F.explode("fits").alias("g"), *STATS)
    estimates = fit_mcd(member)

    grouped = counted.join(groups, same, "left").drop("g_lang", "g_source", "fits")
    far = grouped.join(estimates, "g", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance() / F.col("scale")))
    kept = ~F.col("base_failed") & (F.col("distance").isNull() | (F.col("distance") <= CUTOFF))
    return far.withColumn("kept", kept).select("doc_id", *_COUNTS[:5], "base_failed", "kept", "distance", "k1", "k2")


def keep(docs: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    cols = [names.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("lang", "lang"), ("source", "source"),
                                                  ("text", "text"))]
    verdicts = judge(docs, **names)
    gone = verdicts.filter(~F.col("kept")).select("k1", "k2").distinct()
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    k1, k2 = row_key([col(c) for c in cols])
    keyed = docs.withColumns({a: k1, b: k2})
    gone = gone.withColumnsRenamed({"k1": a + "_gone", "k2": b + "_gone"})
    return keyed.join(gone.hint("merge"), (col(a) == col(a + "_gone")) & (col(b) == col(b + "_gone")), "left_anti").drop(a, b)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *_COUNTS[:5], "base_failed", "kept", F.round("distance", 3).alias("distance"))
