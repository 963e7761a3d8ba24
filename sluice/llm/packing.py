"""Packs tokenised documents into as few sequences of a fixed length as it can.

**Tokens.**  Texts are cut into blocks and split at ASCII white space, which
the tokenizer drops and never joins across.  Each distinct chunk of a block is
encoded once and the ids are put together again by array gathers.  Chunks of
plain letters and punctuation go to the tokenizer's model directly, all others
through its whole pipeline; a tokenizer file with other rules encodes whole
texts.  Each document ends with an end id and only those longer than a
sequence are cut, into pieces of the full length and a shorter last one.

**Packing.**  Only (row, length) travels.  Pieces are dealt by hash into
shards of about ``SHARD`` pieces, each a bin packing problem of its own that a
grouping genetic algorithm solves: a chromosome is a list of bins; crossover
injects whole well-filled bins of one parent into the other, removes the bins
that hold a duplicate, and puts the displaced pieces back by best fit.  Each
shard evolves on ``ISLANDS`` islands in tasks of their own; between the epochs
an island's elite migrates to the next one by a join.  Bins that are full to
within ``TOLERANCE`` (and at least the better half) are final; the pieces of
the others are dealt anew into fewer shards, until one shard is left.  So at
most a few sequences of the whole corpus stay partly empty, and no task holds
more than a shard.

Defined cases: null and empty texts are one token, the end id; repeated rows
and rows with equal or null ids are documents of their own; very long texts
are cut as above; no rows give no rows.  Columns of ``docs`` other than the
two named are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, col, table

CAPACITY = 4096
END_ID = 1
BLOCK_BYTES = 24 << 20
#: Pieces of a bin packing problem, islands that work on it, epochs between migrations, children of an epoch.
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
CHILDREN = 40
POPULATION = 6
#: A bin with no more free places than this part of its capacity is full.
TOLERANCE = 1 / 1024
#: Pieces of an output batch.
BATCH_PIECES = 512

#: Rules of a tokenizer file for which chunks may be split here (fixed values, from the file's own text).
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall


#: Marks that form one part behind ASCII letters.
MARKS = ".,;:!?)"


def splits_at_space(tokenizer_json: str) -> bool:
    """True if the file's rules are those for which texts may be cut at white space."""
    rules = json.loads(tokenizer_json)
    normal, pre = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or []
    return ([n.get("type") for n in normal.get("normalizers") or []] == KNOWN_NORMALIZERS and len(steps) == 2
            and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": KNOWN_SPLIT}
            and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in rules["added_tokens"]))


def parts_of(chunk: str) -> list[str] | None:
    """Pre-tokens of a chunk without white space, None if it needs the whole pipeline."""
    if chunk.isascii():
        return [chunk.lower()] if chunk.isalpha() else None if "<|" in chunk else _ASCII_PARTS(chunk.lower())
    core, last = (chunk, []) if chunk.isalpha() else (chunk[:-1], [chunk[-1:]])
    small = core.lower()
    # Latin, Greek and Cyrillic letters whose lower case is letters too (that of İ ends in a combining dot)
    if not core or max(core) > "\u052f" or not small.isalpha() or "Σ" in core or (last and last[0] not in ".,;:!?)"):
        return None
    return [small, *last] if unicodedata.is_normalized("NFC", core) else None


def gather(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated slices ``which`` of ``flat`` (slice k is ends[k]:ends[k+1]) and their lengths."""
    sizes = np.diff(ends)[which]
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.arange(total) + np.repeat(ends[which] - (upto - sizes), sizes)], sizes


def _ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    ends = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(list(map(len, lists)), out=ends[1:])
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(ends[-1])), ends


class Encoder:
    """Ids of texts by the tokenizer of ``tokenizer_json``, as its library gives them without special tokens added."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.by_chunk = splits_at_space(tokenizer_json)
        if self.by_chunk:
            rules = json.loads(tokenizer_json)
            rules |= {"normalizer": None, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None,
                      "pre_tokenizer": rules["pre_tokenizer"]["pretokenizers"][1]}
            self.model = Tokenizer.from_str(json.dumps(rules))

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096)
                for e in tokenizer.encode_batch_fast(texts[at:at + 4096], add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each)."""
        if not self.by_chunk:
            flat, ends = _ragged(self._ids(self.whole, texts.to_pylist()))
            return flat, np.diff(ends)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        chunks = words.dictionary
        # ASCII letters are one part, the marks behind them another; all other chunks are cut one by one
        heads = pc.ascii_rtrim(chunks, characters=MARKS)
        easy = pc.ascii_is_alpha(heads)
        plain = pc.ascii_lower(heads.filter(easy)).dictionary_encode()
        tails = pc.ascii_ltrim(chunks.filter(easy), characters=string.ascii_letters)
        marked = pc.greater(pc.binary_length(tails), 0)
        tails = tails.filter(marked).dictionary_encode()
        number = {p: k for k, p in enumerate(plain.dictionary.to_pylist())}
        of_tail = np.array([number.setdefault(p, len(number)) for p in tails.dictionary.to_pylist()], np.int64)
        odd, parts, n_parts = [], [], []
        for chunk in chunks.filter(pc.invert(easy)).to_pylist():
            found = parts_of(chunk)
            if found is None:
                n_parts.append(1)
                parts.append(-1 - len(odd))  # its place follows those of the parts
                odd.append(chunk)
            else:
                n_parts.append(len(found))
                for p in found:
                    parts.append(number.setdefault(p, len(number)))
        flat, ends = _ragged(self._ids(self.model, list(number)) + self._ids(self.whole, odd))
        parts = np.array(parts, np.int64)
        parts = np.where(parts < 0, len(number) - 1 - parts, parts)
        easy, marked = easy.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        n_of = np.ones(len(chunks), np.int64)
        n_of[easy] += marked
        n_of[~easy] = n_parts
        part_ends = np.concatenate([[0], np.cumsum(n_of)])
        of_part = np.empty(part_ends[-1], np.int64)
        of_part[~np.repeat(easy, n_of)] = parts
        first = part_ends[:-1][easy]
        of_part[first] = plain.indices.to_numpy()
        of_part[first[marked] + 1] = of_tail[tails.indices.to_numpy()]
        of_chunk, sizes = gather(flat, ends, of_part)
        chunk_ends = np.concatenate([[0], np.cumsum(sizes)])[part_ends]
        ids, sizes = gather(of_chunk, chunk_ends, words.indices.to_numpy())
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


@lru_cache(1)
def _encoder(tokenizer_json: str) -> Encoder:
    """Kept by a Python worker for its next tasks."""
    return Encoder(tokenizer_json)


def cut_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, piece's number, length) of every piece of documents of ``sizes`` ids."""
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, piece, np.minimum(capacity, sizes[doc] - piece * capacity)


def _encode_blocks(tokenizer_json: str, end_id: int, capacity: int, block_bytes: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        encoder = _encoder(tokenizer_json)

        def out(ids: pa.Array, texts: pa.Array):
            flat, sizes = encoder.encode(texts)
            flat = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4")
            doc, piece, length = cut_pieces(sizes + 1, capacity)
            ends = np.concatenate([[0], np.cumsum(length)])
            for at in range(0, len(doc), BATCH_PIECES):
                to = min(at + BATCH_PIECES, len(doc))
                places = ((ends[at:to + 1] - ends[at]) * 4).astype(np.int32)
                data = pa.py_buffer(flat[ends[at]:ends[to]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc[at:to])), pa.array(piece[at:to], pa.int32()),
                     pa.array(piece[at:to] * capacity, pa.int64()), pa.array(length[at:to], pa.int64()),
                     pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(places.tobytes()), data])],
                    names=["doc_id", "piece", "start", "length", "ids"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= block_bytes:
                yield from out(*_columns(held))
                held, size = [], 0
        if held:
            yield from out(*_columns(held))

    return run


def _columns(batches: list) -> tuple[pa.Array, pa.Array]:
    ids = pa.concat_arrays([b.column(0) for b in batches])
    texts = pa.concat_arrays([b.column(1) for b in batches])
    return ids, pc.fill_null(texts, "")


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids) of every piece; ``ids`` are little-endian unsigned 32-bit integers."""
    with open(path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    bound_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_encode_blocks(tokenizer_json, end_id, capacity, BLOCK_BYTES),
                            f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(order, lens: list[int], free: list[int], capacity: int, bins: list[int]) -> None:
    """Puts the pieces of ``order`` into the fullest bin that takes them, else into a new one.

    ``free`` holds the free places of each bin and grows; ``bins`` gets the
    bin of each piece.  Bins are known by their free places: a bit set of
    those that occur finds the least that is enough in a few steps.
    """
    by_free: dict[int, list[int]] = {}
    occurs = 0
    for b, f in enumerate(free):
        if f > 0:
            by_free.setdefault(f, []).append(b)
            occurs |= 1 << f
    for k in order:
        need = lens[k]
        enough = occurs >> need
        if enough:
            f = need + (enough & -enough).bit_length() - 1
            same = by_free[f]
            b = same.pop()
            if not same:
                occurs ^= 1 << f
        else:
            f, b = capacity, len(free)
            free.append(f)
        bins[k] = b
        f -= need
        free[b] = f
        if f:
            same = by_free.setdefault(f, [])
            if not same:
                occurs |= 1 << f
            same.append(b)


class Problem:
    """One shard's bin packing problem and the genetic operators on it.  A packing is an array of each piece's bin."""

    def __init__(self, lens: np.ndarray, capacity: int, rng: np.random.Generator):
        self.lens, self.capacity, self.rng = lens, capacity, rng
        self.list = lens.tolist()
        self.slack = int(capacity * TOLERANCE)
        self.bound = -(-int(lens.sum()) // capacity)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lens)

    def worth(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then the fuller ones: the mean square of the filled parts."""
        fills = self.fills(bins) / self.capacity
        return -len(fills), float((fills * fills).mean())

    def is_best(self, bins: np.ndarray) -> bool:
        """As few bins as the sum of lengths allows, and all but one full."""
        fills = self.fills(bins)
        return len(fills) == self.bound and int((fills < self.capacity - self.slack).sum()) <= 1

    def fit(self, bins: np.ndarray, out: np.ndarray, noise: float = 0.0) -> np.ndarray:
        """``bins`` with the pieces marked ``out`` put back by best fit, the longest first."""
        left = np.flatnonzero(~out)
        kept = np.full(len(bins), -1)
        if len(left):
            kept[left] = np.unique(bins[left], return_inverse=True)[1]
            free = (self.capacity - np.bincount(kept[left], self.lens[left]).astype(np.int64)).tolist()
        else:
            free = []
        places = np.flatnonzero(out)
        key = self.lens[places] * (1 + noise * self.rng.random(len(places)))
        result = kept.tolist()
        best_fit(places[np.argsort(-key, kind="stable")].tolist(), self.list, free, self.capacity, result)
        return np.array(result)

    def fresh(self, noise: float) -> np.ndarray:
        n = len(self.lens)
        return self.fit(np.zeros(n, np.int64), np.ones(n, bool), noise)

    def cross(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of ``two`` in ``one``; bins of ``one`` with a duplicate, and a few others, are dissolved."""
        fills = self.fills(two)
        good = fills >= min(self.capacity - self.slack, np.quantile(fills, 0.75))
        inject = (good & (self.rng.random(len(fills)) < 0.5))[two]
        mine = self.fills(one)
        gone = np.zeros(len(mine), bool)
        gone[one[inject]] = True
        poor = mine < self.capacity - self.slack
        gone |= poor & (self.rng.random(len(mine)) < 0.7)
        gone |= self.rng.random(len(mine)) < 0.02
        child = np.where(inject, two + len(mine), one)
        return self.fit(child, gone[one] & ~inject, 0.3)

    def evolve(self, population: list[np.ndarray], children: int) -> list[np.ndarray]:
        """The population after ``children`` crossovers, each child in the place of the worst; best first."""
        population = sorted(population, key=self.worth, reverse=True)
        for _ in range(children):
            if self.is_best(population[0]):
                break
            one, two = self.rng.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
            child = self.cross(population[min(one, two)], population[max(one, two)])
            if self.worth(child) > self.worth(population[-1]):
                population[-1] = child
                population.sort(key=self.worth, reverse=True)
        return population


_STATE = "shard long, island int, rows array<long>, lens array<int>, packings array<array<int>>, migrant array<int>"


def _evolve_rows(capacity: int, seed: int):
    def run(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                problem = Problem(np.array(r["lens"]), capacity, np.random.default_rng([seed, r["shard"], r["island"]]))
                known = [np.array(p) for p in (r["packings"] or []) + ([r["migrant"]] if r["migrant"] else [])]
                if not known:
                    known = [problem.fresh(0.0)]
                    if not problem.is_best(known[0]):
                        known += [problem.fresh(0.2 * k) for k in range(1, POPULATION)]
                # small problems get more children for the same work
                children = CHILDREN * min(20, max(1, SHARD // len(problem.list)))
                best = problem.evolve(known, children)[:POPULATION]
                found.append([p.tolist() for p in best])
            at = batch.schema.get_field_index("packings")
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return run


_PLACED = "rows array<long>, lens array<int>, sequences array<long>, offsets array<int>, final array<boolean>"


def _place_rows(capacity: int, last: bool):
    """Places of a shard's pieces, and which of them stand in bins that are final."""
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for r in batch.to_pylist():
                lens, rows, bins = np.array(r["lens"]), np.array(r["rows"]), np.array(r["packing"])
                fills = np.bincount(bins, lens)
                good = fills >= min(capacity - int(capacity * TOLERANCE), np.median(fills))
                least = np.full(len(fills), np.iinfo(np.int64).max)
                np.minimum.at(least, bins, rows)  # a sequence is known by its smallest row
                order = np.lexsort((rows, bins))
                upto = np.cumsum(lens[order]) - lens[order]
                first = np.concatenate([[0], np.cumsum(fills)[:-1]]).astype(np.int64)
                offsets = np.empty(len(bins), np.int64)
                offsets[order] = upto - first[bins[order]]
                for held, values in zip(out, (least[bins], offsets, (good | last)[bins])):
                    held.append(values.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rows"), batch.column("lens"), pa.array(out[0], pa.list_(pa.int64())),
                 pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.bool_()))],
                names=["rows", "lens", "sequences", "offsets", "final"])

    return run


def pack(lengths: DataFrame, capacity: int = CAPACITY, islands: int | None = None, epochs: int | None = None) -> DataFrame:
    """(row, sequence_id, offset) for every (row, length): rows are distinct, lengths 1 to ``capacity``.

    ``lengths`` is read several times and must give the same rows each time (a
    written table).  The sequence ids are the smallest row of each sequence.
    """
    islands, epochs = islands or ISLANDS, epochs or EPOCHS
    spark = lengths.sparkSession
    bound_batches(spark)
    full = lengths.filter(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).alias("offset"))
    left = lengths.filter(F.col("length") < capacity).select("row", F.col("length").cast("int").alias("len"))
    parts = [full]
    n = left.count()
    turn = 0
    while n:
        shards = -(-n // SHARD)
        shard = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)).alias("shard")
        problems = left.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct("row", "len"))).alias("p"))
        state = problems.select(
            "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("p.row").alias("rows"),
            F.col("p.len").alias("lens"), F.lit(None).cast("array<array<int>>").alias("packings"),
            F.lit(None).cast("array<int>").alias("migrant")).repartition("shard", "island")
        for epoch in range(epochs):
            state = materialize(state.mapInArrow(_evolve_rows(capacity, turn * 97 + epoch), _STATE))
            if epoch < epochs - 1:
                elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"),
                                     F.col("packings")[0].alias("migrant"))
                state = state.drop("migrant").join(elite.hint("merge"), ["shard", "island"]).select(
                    "shard", "island", "rows", "lens", "packings", "migrant")
        best = F.col("packings")[0]
        worth = F.struct(F.array_max(best).alias("bins"), "island")
        chosen = state.groupBy("shard").agg(F.min_by(F.struct("rows", "lens", best.alias("packing")), worth).alias("s"))
        placed = materialize(chosen.select("s.*").mapInArrow(_place_rows(capacity, shards == 1), _PLACED))
        each = placed.select(F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("lens").alias("len"),
                                                   F.col("sequences").alias("sequence_id"), F.col("offsets").alias("offset"),
                                                   F.col("final").alias("final"))))
        parts.append(each.filter("final").select("row", "sequence_id", "offset"))
        left = each.filter("not final").select("row", "len")
        n = 0 if shards == 1 else left.count()
        turn += 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("row", "sequence_id", F.col("offset").cast("long").alias("offset"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column ``length``) with the columns ``sequence_id`` and ``offset``."""
    kept = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()))
    placed = pack(kept.select(F.col("_row").alias("row"), "length"), capacity).withColumnRenamed("row", "_row")
    return kept.join(placed.hint("merge"), "_row").drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, lengths, ids): the ids of each packed sequence in order, at most a sequence's length for each."""
    each = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return each.select("sequence_id", F.col("p.length").alias("lengths"), F.concat(
        F.lit(b""), F.aggregate("p", F.lit(b""), lambda got, x: F.concat(got, x["ids"]))).alias("ids"))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack_pieces(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
