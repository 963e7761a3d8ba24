"""Phrase collocations for each language: frequent n-grams by Misra-Gries summaries, counted exactly in a second pass.

**Blocks.**  Texts are split into pieces and words in blocks of one language,
written as the block's distinct words and the words' numbers, few blocks to a
row group, as readers hold a row group at once.

**First pass.**  Every n-gram of 1 to 5 words has a hash partition, which holds
n-grams of one length, and a 32-bit key in it.  A block's summary of a partition holds its keys and counts.  A task
merges the summaries of one partition: counts of equal keys add up, and when
more than ``capacity`` counters are left, the next largest count is taken off
all of them.  The capacity exceeds the partition's mass divided by the
threshold, so less than the threshold is ever taken off any key, and each
frequent n-gram survives (keys that collide only add up).  Survivors may
be too many, never too few.  Partitions are as many as the mass asks for, so
a task's counters have the same bound at every size; a phrase that is a third
of all rows is one counter a block.

**Second pass.**  Surviving keys are sorted in front of the blocks in which they
occur; a block's phrases behind them are counted by their words, and the counts
are summed by phrase.  No set of candidates is broadcast or collected, and a task
holds one block with its keys and the phrases of one share that may be frequent,
also where all n-grams survive.

**Scores** are exact decimals; parts of a frequent phrase are frequent, so all
counts come from the same table.  As a phrase is at least as frequent as any
longer one, one that is dropped for a longer candidate is dropped for one that
is longer by a single word, so two shorter phrases of each candidate are enough
to look at.

Defined cases: a null text is empty, a null language ``und``; empty texts and
texts of separators have no words; repeated rows count each time; very long
texts are cut nowhere (a block holds at least one text); ties go by
phrase; no rows give no phrases.  Only the two named columns are read, so
others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, col, table

THRESHOLD = 100
LONGEST = 5
TOP = 2000
#: Bytes of text in a block, blocks in a row group, words whose n-grams of one length a hash partition holds.
BLOCK_BYTES = 4 << 20
GROUP_BLOCKS = 8
PARTITION_WORDS = 4 << 20
#: Bits of the table that skips most n-grams before the search in the survivors, n-grams that are looked up at once.
SKIP_BITS = 22
SLICE = 1 << 18
#: Phrases in a batch, phrases that are added up at once.
BATCH_PHRASES = 1 << 16
SUM_PHRASES = 1 << 18
#: Shares whose first phrases are ranked together in the end.
LAST_SHARES = 16

#: Separators of pieces become ".", upper-case ASCII letters lower case.
_CHARS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r" + bytes(range(65, 91)), b"." * 10 + bytes(range(97, 123)))


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(words, numbers) of texts; the words by falling frequency, -1 between pieces."""
    whole = b".".join(texts).translate(_CHARS).replace(b".", b" . ")
    found = pc.ascii_split_whitespace(pa.array([whole], pa.large_string())).flatten().dictionary_encode()
    words, numbers = found.dictionary.cast(pa.large_binary()).to_pylist(), found.indices.to_numpy()
    times = np.bincount(numbers, minlength=len(words))
    for k, word in enumerate(words):
        if word in (b".", b""):  # the split gives empty words at both ends
            times[k] = 0
    order = np.argsort(-times, kind="stable")
    order = order[times[order] > 0]
    new = np.full(len(words), -1, np.int32)
    new[order] = np.arange(len(order), dtype=np.int32)
    return [words[k] for k in order], new[numbers] if len(numbers) else np.empty(0, np.int32)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress where the numbers are small."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _write_blocks(block_bytes: int):
    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang):
            words, numbers = numbered_words(held.pop(lang))
            del sizes[lang]
            n = int((numbers >= 0).sum())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([n], pa.int64()), pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
                     pa.array([planes(numbers + 1)], pa.binary())], names=["lang", "n", "words", "numbers"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= block_bytes:
                    yield from flush(lang)
            if sum(sizes.values()) >= 3 * block_bytes:  # many languages
                for lang in list(held):
                    yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    return run


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_keys(lang: str, words: pa.Array, numbers: np.ndarray, partitions: int, longest: int):
    """(n, places, keys) for n = 1 to ``longest``: where n words stand in a piece, and their partition << 32 | key.

    Each n has ``partitions`` partitions of its own, numbered from (n - 1) * ``partitions``.
    """
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    parts = (words.slice(k, SLICE).cast(pa.binary()).to_pylist() for k in range(0, len(words), SLICE))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for part in parts for w in part), np.uint64, len(words))
    of_word = hashes[numbers]  # at separators some word's, never used
    places = np.flatnonzero(numbers >= 0)
    so_far = of_word[places]
    for n in range(1, longest + 1):
        if n > 1:
            go_on = places + n - 1 < len(numbers)
            places, so_far = places[go_on], so_far[go_on]
            inside = numbers[places + n - 1] >= 0
            places, so_far = places[inside], so_far[inside]
            so_far = _mixed(so_far * _MIX + of_word[places + n - 1])
        h = _mixed(so_far + np.uint64(n))
        partition = (((h >> np.uint64(32)) * np.uint64(partitions)) >> np.uint64(32)) + np.uint64((n - 1) * partitions)
        yield n, places, (partition << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _unpack_block(batch, k: int) -> tuple[str, pa.Array, np.ndarray]:
    words = batch.column("words")[k].values
    return batch.column("lang")[k].as_py(), words, from_planes(batch.column("numbers")[k].as_py()).astype(np.int32) - 1


def _summaries(partitions: int, longest: int):
    """Each block's summaries: (partition, block, mass, keys as differences, counts, counts of 255 and more)."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                lang, words, numbers = _unpack_block(batch, k)
                block = batch.column("block")[k].as_py()
                for _, _, keys in ngram_keys(lang, words, numbers, partitions, longest):
                    if not len(keys):
                        continue
                    keys, counts = np.unique(keys, return_counts=True)
                    part = (keys >> np.uint64(32)).astype(np.int64)
                    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    starts = np.flatnonzero(np.diff(part, prepend=-1))
                    steps = np.diff(low, prepend=0)
                    steps[starts] = low[starts]
                    ends = [*starts[1:].tolist(), len(keys)]
                    small = np.minimum(counts, 255).astype(np.uint8)
                    rows: list[list] = [[], [], [], [], []]
                    for a, b in zip(starts.tolist(), ends):
                        for held, value in zip(rows, (int(part[a]), int(counts[a:b].sum()), planes(steps[a:b]), small[a:b].tobytes(),
                                                      counts[a:b][counts[a:b] >= 255].astype("<i8").tobytes())):
                            held.append(value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[0], pa.int64()), pa.array([block] * len(rows[0]), pa.int64()), pa.array(rows[1], pa.int64()),
                         *(pa.array(r, pa.binary()) for r in rows[2:])],
                        names=["partition", "block", "mass", "steps", "small", "large"])

    return run


def _unpack_summary(steps: bytes, small: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<i8")
    return np.cumsum(from_planes(steps), dtype=np.uint64), counts


class MisraGries:
    """A mergeable summary: at most ``capacity`` counters, each at most ``lost`` below its key's true count."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Adds the counters of another summary, which lacks ``lost`` at most."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        self.lost += lost
        if len(self.keys) > self.capacity:
            at = len(self.counts) - 1 - self.capacity
            less = int(np.partition(self.counts, at)[at])
            left = self.counts > less
            self.keys, self.counts, self.lost = self.keys[left], self.counts[left] - less, self.lost + less

    def at_least(self, threshold: int) -> np.ndarray:
        """Sorted keys, among them all whose true count reaches ``threshold``."""
        return self.keys[self.counts + self.lost >= threshold]


def _survivors(threshold: int):
    """For one hash partition: the keys that may be frequent, for each block in which they occur."""
    def run(group: pa.Table) -> pa.Table:
        mass = pc.sum(group["mass"]).as_py()
        summary = MisraGries(mass // threshold + 1)
        rows = list(zip(*(group[c].to_pylist() for c in ("steps", "small", "large"))))
        held, size = [], 0
        for row in rows:
            held.append(_unpack_summary(*row))
            size += len(held[-1][0])
            if size >= max(summary.capacity, 1 << 18):
                summary.merge(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if held:
            summary.merge(*(np.concatenate(x) for x in zip(*held)))
        keys = summary.at_least(threshold)
        base = np.uint64(group["partition"][0].as_py() << 32)
        blocks: list[int] = []
        found: list[bytes] = []
        if len(keys):
            for block, row in zip(group["block"].to_pylist(), rows):
                there, _ = _unpack_summary(*row)
                at = np.minimum(np.searchsorted(there, keys), len(there) - 1)
                hits = keys[there[at] == keys]
                if len(hits):
                    blocks.append(block)
                    found.append((hits | base).astype("<u8").tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "keys": pa.array(found, pa.binary())})

    return run


def equal_phrases(numbers: np.ndarray, places: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of each different phrase of n words at ``places``, by key; told apart by words, not by keys alone."""
    _, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if all((numbers[places + j] == numbers[places[first][which] + j]).all() for j in range(n)):
        return places[first], counts
    _, first, counts = np.unique(np.stack([keys.astype(np.int64), *(numbers[places + j] for j in range(n))], 1), axis=0,
                                 return_index=True, return_counts=True)
    return places[first], counts


def wanted_places(places: np.ndarray, keys: np.ndarray, wanted: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose keys are in the sorted ``wanted``, and where they are there; ``maybe``: an empty skip table."""
    low = np.uint64(len(maybe) - 1)
    maybe[(wanted & low).astype(np.int64)] = True
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int32))]
    for k in range(0, len(keys), SLICE):
        part = keys[k:k + SLICE]
        hit = np.flatnonzero(maybe[(part & low).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, part[hit]), len(wanted) - 1)
        there = wanted[at] == part[hit]
        found.append((places[k + hit[there]], at[there].astype(np.int32)))
    maybe[(wanted & low).astype(np.int64)] = False
    return tuple(np.concatenate(x) for x in zip(*found))


def _count_survivors(partitions: int, longest: int):
    """The phrases of a block that may be frequent, with their counts, packed by share of the phrases: their hash partition.

    Rows come by block, its surviving keys before the block itself.
    """
    def run(batches):
        maybe = np.zeros(1 << SKIP_BITS, bool)
        held: list[bytes] = []
        for batch in batches:
            for k in range(batch.num_rows):
                keys = batch.column("keys")[k]
                if keys.is_valid:
                    held.append(keys.as_py())
                elif held:
                    wanted = np.sort(np.frombuffer(b"".join(held), "<u8"))
                    held = []
                    yield from count(*_unpack_block(batch, k), wanted, maybe)

    def count(lang, words, numbers, wanted, maybe):
        for n, places, keys in ngram_keys(lang, words, numbers, partitions, longest):
            ends = np.array([(n - 1) * partitions << 32, n * partitions << 32], np.uint64)
            mine = wanted[slice(*np.searchsorted(wanted, ends))]
            if not len(mine):
                continue
            places, at = wanted_places(places, keys, mine, maybe)
            if not len(places):
                continue
            first, counts = equal_phrases(numbers, places, at, n)
            share = (mine[at[np.searchsorted(places, first)]] >> np.uint64(32)).astype(np.int64)
            for a in range(0, len(first), BATCH_PHRASES):
                b = min(a + BATCH_PHRASES, len(first))
                texts = pc.binary_join_element_wise(*(words.take(pa.array(numbers[first[a:b] + j])) for j in range(n)), " ")
                ends = np.append(np.flatnonzero(np.diff(share[a:b])) + 1, b - a)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(ends)), pa.array([n] * len(ends), pa.int32()), pa.array(share[a:b][ends - 1]),
                     pa.ListArray.from_arrays(offsets, texts.cast(pa.string())),
                     pa.ListArray.from_arrays(offsets, pa.array(counts[a:b], pa.int64()))],
                    names=["lang", "words", "share", "phrases", "counts"])

    return run


def _sum_shares(threshold: int):
    """Exact counts of the phrases of each language, length and share, whose rows follow each other; those under the threshold go."""
    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("phrase").aggregate([("a", "sum")]).select(["phrase", "a_sum"]).rename_columns(["phrase", "a"])

    def run(batches):
        held: list[pa.Table] = []
        size, least, last = 0, SUM_PHRASES, None

        def often():
            all_of_it = summed(held)
            kept = all_of_it.filter(pc.greater_equal(all_of_it["a"], threshold)).combine_chunks()
            for part in kept.to_batches():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([last[0]] * len(part), pa.string()), part.column("phrase"), pa.array([last[1]] * len(part), pa.int32()),
                     part.column("a")], names=["lang", "phrase", "words", "a"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "share"))))
            a = 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if keys[a] != last:
                    if held:
                        yield from often()
                    held, size, least, last = [], 0, SUM_PHRASES, keys[a]
                rows = batch.slice(a, b - a)
                held.append(pa.table({"phrase": rows.column("phrases").flatten(), "a": rows.column("counts").flatten()}))
                size += len(held[-1])
                if size >= least:
                    held = [summed(held)]
                    size = len(held[0])
                    least = max(SUM_PHRASES, 2 * size)
                a = b
        if held:
            yield from often()

    return run


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(block, lang, n, words, numbers): blocks of one language with their words, written."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(col(text_col), F.lit("")).alias("text"))
    blocks = texts.mapInArrow(_write_blocks(BLOCK_BYTES), "lang string, n long, words array<string>, numbers binary")
    return materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "*"),
                       **{"parquet.block.row.count.limit": str(GROUP_BLOCKS)})


def frequent_phrases(blocks: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, a) of every phrase of 1 to ``longest`` words that occurs ``threshold`` times, written."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    partitions = max(1, -(-total // PARTITION_WORDS))
    summaries = blocks.mapInArrow(_summaries(partitions, longest), "partition long, block long, mass long, steps binary, "
                                                                   "small binary, large binary")
    wanted = summaries.groupBy("partition").applyInArrow(_survivors(threshold), "block long, keys binary")
    # a block's keys are streamed in front of it: gathered by an aggregate or a join they would be in the heap at once
    rows = wanted.unionByName(blocks.select("block", "lang", "words", "numbers"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("keys").isNull())
    counts = rows.mapInArrow(
        _count_survivors(partitions, longest), "lang string, words int, share long, phrases array<string>, counts array<long>")
    # phrases travel packed by share; the rows of a share are added up as they come
    by = ["lang", "words", "share"]
    return materialize(counts.repartition(*by).sortWithinPartitions(*by).mapInArrow(
        _sum_shares(threshold), "lang string, phrase string, words int, a long"))


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) of positive long columns, exact: products of 38 digits."""
    wide = [f"cast({c} as decimal(19,0))" for c in (a, n, left, right)]
    return F.expr(f"(cast(1000 as decimal(4,0)) * {wide[0]} * {wide[1]}) div ({wide[2]} * {wide[3]})")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score."""
    spark = docs.sparkSession
    blocks = word_blocks(docs, text_col, lang_col)
    frequent = frequent_phrases(blocks, threshold, longest)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = frequent.filter("words > 1")
    words = F.split("phrase", " ")
    # a phrase inside a longer candidate that is as frequent
    longer = candidates.filter("words > 2").select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "),
                                       F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(longer.hint("merge"), ["lang", "phrase"], "left").filter("most is null or most < a").drop("most")
    # counts of both parts of every cut
    cuts = kept.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.lit(longest)), " ").alias("rest"))
    parts = frequent.select("lang", "phrase", "a")
    for name, out in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(out)).hint("merge"), ["lang", name])
    cuts = cuts.join(totals.hint("merge"), "lang")
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("s"))
    scored = least.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    # the first ones of each share of a language, of fewer shares, then of the language: no task sorts a whole language
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = scored
    for shares in (int(spark.conf.get("spark.sql.shuffle.partitions")), LAST_SHARES):
        near = near.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*by)))
        near = near.filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
ngrams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM worded) WHERE len(w) >= k)),
frequent AS (SELECT lang, phrase, k, count(*)::BIGINT AS a FROM ngrams GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT f.lang, array_to_string(f.w[i:i + m - 1], ' ') AS phrase, max(f.a) AS most
  FROM (SELECT lang, string_split(phrase, ' ') AS w, k, a, unnest([2, 3, 4]) AS m FROM frequent) f, generate_series(1, 4) AS g(i)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT c.* FROM frequent c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE c.k > 1 AND (i.most IS NULL OR 100 * i.most < 100 * c.a)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:k], ' ') AS q
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS j FROM kept) c),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a), j) AS least
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.p JOIN frequent y ON y.lang = c.lang AND y.phrase = c.q
  JOIN totals t ON t.lang = c.lang),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE least = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
