"""Benchmark decontamination by templates: copied passages and re-parameterised questions.

Words of documents and benchmark items become a template: numbers, names
(words with an initial capital) and units after a number are replaced by
typed placeholders, other words stay in lower case without the punctuation
around them.  Windows of ``WINDOW`` template words are hashed and joined; one
with fewer than ``LITERALS`` plain words is hashed by its words as written, so
dense passages (arithmetic, tables, names) match exact copies only.  Matches of one document and
item at one offset form an alignment; it is a leak if it covers
``MIN_COVER`` words (or the whole of a shorter item) and its slots are
consistent: each value of the item stands for one value of the document (two
values of the item may get the same one).  So "Ann has 3 apples and eats 3"
matches "Bob has 5 apples and eats 5" but not "Bob has 5 apples and eats 7".
Whatever the other slots hold, a run of ``MIN_COVER`` equal words (or the
whole of a shorter item) is a leak.  Words are counted once, however many
windows cover them.

Document windows are tested in their task against a Bloom filter of the
benchmark's windows, which has ``BLOOM_BITS`` bits whatever the benchmark's
size; only windows that pass it are shuffled, and the join on the hash
decides.  The filter never loses a window, so it changes the volume but not
the result.

Defined cases: null and empty texts match nothing; an item of fewer words than
a window is one window of its own length; one of under ``SHORTEST`` words, which
any text may hold by chance, matches a document that consists of its words
alone.  Texts of any length are read whole.  Null ids are kept as they are.
Rows with equal id and text are one document.  An empty benchmark matches
nothing, an empty table gives no rows.  Columns that are not named are not
read, or are renamed where they clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, col, fresh, row_key, table

WINDOW = 8
LITERALS = 4
SHORTEST = 5
MIN_COVER = 13
BLOOM_BITS = 1 << 24
PROBES = 3
#: Added to the seed of windows that are hashed as written, and of short texts that are.
DENSE, WHOLE = 1 << 32, 1 << 33

EDGE = ".,;:!?\"'()[]{}<>*_`«»„“”‘’…¿¡"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*%?")
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
    "million billion".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds "
    "ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees "
    "meter meters metre metres kilometer kilometers kilometre kilometres".split())

# Codes of template words: even for placeholders, odd for plain words.
NUM, NAME, UNIT = 2, 4, 6


def word_code(word: str) -> int:
    """Code of one word on its own; a unit is a plain word until it follows a number."""
    bare = word.strip(EDGE) or word
    if NUMBER.fullmatch(bare) or bare.lower() in NUMBER_WORDS:
        return NUM
    if bare[0].isupper():
        return NAME
    return xxhash.xxh3_64_intdigest(bare.lower().encode("utf-8", "surrogatepass")) | 1


_UNIT_CODES = np.array(sorted(word_code(u) for u in UNITS), np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Templates:
    """Template codes of texts; remembers the codes of up to ``memory`` words, and of their spellings."""

    def __init__(self, memory: int = 300_000):
        self.memory = memory
        self.known: dict[str, int] = {}
        self.spelt: dict[str, int] = {}

    def spellings(self, words: list[str]) -> np.ndarray:
        """Codes of the words as they are written, placeholders or not."""
        spelt = self.spelt
        if len(spelt) > self.memory:
            spelt.clear()
        out = []
        for w in words:
            c = spelt.get(w)
            if c is None:
                c = spelt[w] = xxhash.xxh3_64_intdigest((w.strip(EDGE) or w).lower().encode("utf-8", "surrogatepass"))
            out.append(c)
        return np.array(out, np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        out = []
        for w in words:
            c = known.get(w)
            if c is None:
                c = known[w] = word_code(w)
            out.append(c)
        codes = np.array(out, np.uint64)
        number = codes == NUM
        if number.any():
            after = np.flatnonzero(number[:-1]) + 1
            codes[after[np.isin(codes[after], _UNIT_CODES)]] = UNIT
        return codes


def _folded(codes: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = len(codes) - width + 1
    total = np.full(max(n, 0), seed, np.uint64)
    for k in range(width if n > 0 else 0):
        total = (total ^ codes[k:k + n]) * _STEP
        total ^= total >> np.uint64(29)
    return total


def window_hashes(words: list[str], codes: np.ndarray, width: int, templates: Templates) -> np.ndarray:
    """Hash of each window: of its template, or of its words as written if it holds too few plain ones."""
    total = _folded(codes, width, width)
    plain = np.concatenate([[0], np.cumsum(codes & np.uint64(1))])
    dense = np.flatnonzero(plain[width:] - plain[:len(plain) - width] < min(LITERALS, width - 1))
    if 0 < len(dense) < len(total) // 8:  # a few windows: only their words
        at = dense[:, None] + np.arange(width)
        used, place = np.unique(at, return_inverse=True)
        spelt = templates.spellings([words[i] for i in used.tolist()])[place.reshape(at.shape)]
        exact = np.full(len(dense), width + DENSE, np.uint64)
        for k in range(width):
            exact = (exact ^ spelt[:, k]) * _STEP
            exact ^= exact >> np.uint64(29)
        total[dense] = exact
    elif len(dense):
        total[dense] = _folded(templates.spellings(words), width, width + DENSE)[dense]
    return total


def hashes_of(words: list[str], codes: np.ndarray, width: int, templates: Templates) -> np.ndarray:
    """Window hashes, of a text under ``SHORTEST`` words only the one of all its words as written."""
    if width < SHORTEST:
        return _folded(templates.spellings(words), width, width + WHOLE)
    return window_hashes(words, codes, width, templates)


def bloom_places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes * np.uint64(m) >> np.uint64(20)) % np.uint64(BLOOM_BITS)
            for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[:PROBES]]


def _slots(words: list[str], codes: np.ndarray, at: int, width: int) -> list[str]:
    """Values of the placeholders of a window, in order."""
    return [(words[at + k].strip(EDGE) or words[at + k]).lower() for k in range(width) if not codes[at + k] & np.uint64(1)]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _item_windows(batches):
    templates = Templates()
    for batch in batches:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").split()
            if not words:
                continue
            codes = templates(words)
            width = min(WINDOW, len(words))
            hashes = hashes_of(words, codes, width, templates)
            places = np.stack(bloom_places(hashes), 1).astype(np.int64)
            signed = _signed(hashes)
            out += [(item, len(words), width, int(at), int(signed[at]), _slots(words, codes, at, width),
                     places[at].tolist()) for at in range(len(hashes))]
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()),
                 pa.list_(pa.int64())]
        names = ["item_id", "item_words", "width", "item_at", "h", "item_slots", "places"]
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], names=names)


def _matching(bits: np.ndarray, widths: list[int]):
    """Reads (doc_id, k1, k2, text) and returns the windows whose hash the filter may hold."""
    def run(batches):
        templates = Templates()
        for batch in batches:
            row, out = [], []
            for r, text in enumerate(batch.column(3).to_pylist()):
                words = text.split() if text else []
                if not words:
                    continue
                codes = templates(words)
                for width in widths:
                    if len(words) < width or width < SHORTEST and len(words) != width:
                        continue
                    hashes = hashes_of(words, codes, width, templates)
                    good = np.ones(len(hashes), bool)
                    for place in bloom_places(hashes):
                        good &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    signed = _signed(hashes)
                    for at in np.flatnonzero(good).tolist():
                        row.append(r)
                        out.append((at, int(signed[at]), _slots(words, codes, at, width)))
            taken = batch.take(pa.array(row, pa.int64()))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns[:3], pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.list_(pa.string()))], names=["doc_id", "k1", "k2", "at", "h", "slots"])

    return run


def _covered(places: str) -> Column:
    """Words that the windows at the sorted places cover together."""
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-1 << 30).alias("end")), lambda acc, at: F.struct(
        (acc["n"] + at + F.col("width") - F.greatest(acc["end"], at)).alias("n"), (at + F.col("width")).alias("end")),
        lambda acc: acc["n"])


def _longest_run(places: str) -> Column:
    """(words, start) of the longest stretch that the windows at the sorted places cover without a gap."""
    def step(acc, at):
        first = F.when(at <= acc["end"], acc["first"]).otherwise(at)
        end = at + F.col("width")
        longer = end - first > acc["words"]
        return F.struct(F.when(longer, end - first).otherwise(acc["words"]).alias("words"),
                        F.when(longer, first).otherwise(acc["start"]).alias("start"), first.alias("first"), end.alias("end"))

    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("start"), F.lit(0).alias("first"), F.lit(-1 << 30).alias("end"))
    return F.aggregate(places, none, step)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds.

    (doc_id, item_id, k1, k2, start, n_windows, n_words, reparameterised): the
    longest alignment, its first word in the document, the windows and words
    it covers, and whether any slot holds another value than the item's.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(col(item_col).alias("item_id"), col(item_text_col).alias("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    windows = materialize(items.mapInArrow(
        _item_windows, f"item_id {item_type}, item_words int, width int, item_at int, h long, "
                       "item_slots array<string>, places array<long>"))

    # the filter: at most BLOOM_BITS / 32 numbers come to the driver, whatever the benchmark's size
    place = windows.select(F.explode("places").alias("p"))
    mask = F.expr("shiftleft(1L, cast(p % 32 as int))")
    words = place.groupBy(F.expr("cast(p div 32 as int)").alias("at")).agg(F.bit_or(mask).alias("bits")).toPandas()
    bits = np.zeros(BLOOM_BITS // 32, np.uint32)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # 1 to WINDOW

    k1, k2 = row_key([col(id_col), col(text_col)])
    keyed = docs.select(col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), col(text_col).alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    # the bits go to each task as bytes of the function, BLOOM_BITS / 8 of them
    seen = keyed.mapInArrow(_matching(bits.view(np.uint8), widths),
                            f"doc_id {id_type}, k1 long, k2 long, at int, h long, slots array<string>")
    met = seen.join(windows.drop("places"), "h").withColumn("offset", F.col("at") - F.col("item_at"))
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
    literal = F.when(F.col("item_slots") == F.col("slots"), F.col("at"))
    aligned = met.groupBy("doc_id", "k1", "k2", "item_id", "offset").agg(
        F.sort_array(F.collect_set("at")).alias("places"), F.sort_array(F.collect_set(literal)).alias("literal"),
        F.max("width").alias("width"), F.max("item_words").alias("item_words"), pairs.alias("pairs"))
    consistent = F.size(F.array_distinct(F.col("pairs.item_slots"))) == F.size("pairs")
    aligned = aligned.select("*", F.size("places").alias("n_windows"), consistent.alias("consistent"),
                             _covered("places").alias("covered"), _longest_run("literal").alias("run"))
    # an alignment whose values are torn still holds a copy if one run of equal words is long enough
    whole = F.col("consistent") & (F.col("covered") >= F.least(F.lit(MIN_COVER), F.col("item_words") - 1))
    copied = F.col("run.words") >= F.least(F.lit(MIN_COVER), F.col("item_words") - 1)
    changed = whole & F.exists("pairs", lambda p: p["item_slots"] != p["slots"])
    leaks = aligned.filter(whole | copied).withColumns({
        "start": F.when(whole, F.element_at("places", 1)).otherwise(F.col("run.start")),
        "n_words": F.when(whole, F.col("covered")).otherwise(F.col("run.words"))})
    best = F.max_by(F.struct("start", "n_windows", "n_words", changed.alias("reparameterised")),
                    F.struct("n_words", -F.col("start"))).alias("best")
    return leaks.groupBy("doc_id", "item_id", "k1", "k2").agg(best).select(
        "doc_id", "item_id", "k1", "k2", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are."""
    a, b = fresh(docs, "k1"), fresh(docs, "k2")
    gone = find_leaks(docs, benchmark, id_col, text_col).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = row_key([col(id_col), col(text_col)])
    return docs.withColumns({a: k1, b: k2}).join(gone.hint("merge"), [a, b], "left_anti").drop(a, b)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_windows", "n_words", "reparameterised")
