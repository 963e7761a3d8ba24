"""Byte-level BPE encoding and decoding with public ranks.

Texts are cut into blocks of about ``BLOCK_BYTES``.  A block's texts are
split by the tokenizer's pattern, and each distinct word of the block that is
no token itself is encoded once by Spark higher-order functions: the word's
bytes are an array of pieces, each known by its rank and held with its place
and the rank of the pair that it forms with the next one, and a fold merges
the leftmost pair of the lowest rank until no pair has a rank.  The ranks are
a literal map from a pair of pieces to the rank of their concatenation: an
array of packed numbers in which a second array says where the pairs of each
left piece stand, so that one lookup reads two numbers.  Where a pair stands in
its word is the number of bits up to its place in a number of 64 bits; words of
more than ``MASKED`` bytes count the places.  The ids of the words are then put
back in the order of each text, by the words' numbers.  Decoding looks up each id in a
literal array of pieces and concatenates them.  Python splits the texts; all
that follows are Spark expressions.  The literal arrays come with each block as
columns of its row: in the plan they would be megabytes of text, which the
driver keeps for each execution.

Words that come up in many blocks are not folded again in each: words seen
twice in a sample of about ``MEMO_DOCS`` documents, at most ``MEMO_WORDS`` of
them, are folded first, and blocks take their ids from there.  Both bounds are
fixed, and the ids are the same with any sample or none.

No texts are shuffled: a block's dictionary stays in the task that made it, so
memory is bounded by the block and one text, and a lost task repeats its own
blocks alone.  Words of more than ``LONG`` bytes would make the fold
quadratic; they are merged by the same ranks with a heap, to the same ids.

Defined cases: null and empty texts have no ids and decode to no bytes;
repeated rows are all returned; an empty table gives no rows; only the two
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, col, table

BLOCK_BYTES = 8 << 20
LONG = 192
#: Documents of the sample for words that are folded once for all blocks, and such words.
MEMO_DOCS = 1 << 15
MEMO_WORDS = 1 << 19
#: Bits of a piece's rank in the packed pairs of :func:`pair_table`.
PLACE_SHIFT = 20
PIECE = (1 << PLACE_SHIFT) - 1
NO_RANK = (1 << 20) - 1
#: In the fold a piece is one number: what its pair with the next piece looked up, its place, own rank.  A pair's
#: entry holds the left piece and the rank of both; a lookup flips the left piece, so that it is below ``NONE`` if it fits.
OWN_BITS, FOLD_RANK, FOLD_LEFT = 19, 27, 45
OWN, PLACE, NONE = (1 << OWN_BITS) - 1, 0xFF << OWN_BITS, 1 << FOLD_LEFT
#: Words of up to so many pieces have their places in the bits of one number.
MASKED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


#: Factors that deal a pair of pieces (left, right) to its place; the place of a group of pairs is moved as a whole.
LEFT, RIGHT = 40503, 30011
#: Bits of a packed entry below the pair.
ENTRY_SHIFT = 20


def _pairs(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Pairs of pieces that have a rank together: left, right, and that rank."""
    return [(left, right, rank) for piece, rank in ranks.items() for cut in range(1, len(piece))
            if (left := ranks.get(piece[:cut])) is not None and (right := ranks.get(piece[cut:])) is not None]


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, moves): the rank of a pair of pieces is found with one look at each.

    Pairs are grouped by a hash; each group, the largest first, is moved to
    the first place where all its pairs meet free entries.  An entry is the
    pair and the rank of both together, -1 if free.
    """
    pairs = [(left << PLACE_SHIFT | right, rank) for left, right, rank in _pairs(ranks)]
    size = 1 << max(4, (3 * len(pairs) // 2).bit_length())
    groups: dict[int, list[tuple[int, int]]] = {}
    for pair, rank in pairs:
        left, right = pair >> PLACE_SHIFT, pair & PIECE
        groups.setdefault(((left << 7) ^ right) & (size // 4 - 1), []).append((pair, rank))
    entries, moves = np.full(size, -1, np.int64), np.zeros(size // 4, np.int64)
    taken = bytearray(size)
    for group, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        homes = [((pair >> PLACE_SHIFT) * LEFT + (pair & PIECE) * RIGHT) & (size - 1) for pair, _ in members]
        if len(set(homes)) < len(homes):
            raise ValueError("two pairs of a group share a home: other factors are needed")
        move = next(m for m in range(size) if not any(taken[(h + m) & (size - 1)] for h in homes))
        moves[group] = move
        for home, (pair, rank) in zip(homes, members):
            at = (home + move) & (size - 1)
            taken[at] = 1
            entries[at] = pair << ENTRY_SHIFT | rank
    return entries, moves


def pair_rows(ranks: dict[bytes, int], least_size: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(entries, moves) for the fold: the pair of a left and a right piece stands at ``moves[left] ^ right``.

    All pairs of a left piece, those with most pairs first, are moved to where
    they meet free entries, in a table twice as large if there is no such place.
    The number after the last rank is no piece: it
    forms no pair, and stands at both ends of a word.
    """
    pairs, edge = _pairs(ranks), max(ranks.values()) + 1
    if edge + 1 >= 1 << (OWN_BITS - 1):
        raise ValueError(f"ranks of {1 << (OWN_BITS - 1)} and more do not fit a piece")
    size = max(least_size, 1 << edge.bit_length(), 1 << (3 * len(pairs) // 2).bit_length())
    entries, moves = np.full(size, (edge + 1) << FOLD_LEFT, np.int64), np.zeros(edge + 1, np.int64)
    taken = bytearray(size)
    marks = np.frombuffer(taken, np.uint8)
    rows: dict[int, list[tuple[int, int]]] = {}
    for left, right, rank in pairs:
        rows.setdefault(left, []).append((right, rank))
    order = np.random.default_rng(1).permutation(size)
    order = np.concatenate([order, order])
    listed, start = order.tolist(), 0
    for left, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        start = (start + 37) % size  # each piece begins elsewhere, as places tried before are taken
        if len(row) < 8:
            move = next((listed[k] for k in range(start, start + size) if not any(taken[listed[k] ^ right] for right, _ in row)), None)
        else:
            for k in range(start, start + size, 1 << 12):
                fit = order[k:k + (1 << 12)]
                for right, _ in row:
                    fit = fit[marks[fit ^ right] == 0]
                if len(fit):
                    break
            move = int(fit[0]) if len(fit) else None
        if move is None:
            return pair_rows(ranks, 2 * size)
        moves[left] = move
        for right, both in row:
            taken[move ^ right] = 1
            entries[move ^ right] = left << FOLD_LEFT | both << FOLD_RANK
    return entries, moves


class Ranks:
    """The rank map of :func:`pair_rows` as columns for use in expressions."""

    def __init__(self, entries: Column, moves: Column):
        self.entries, self.moves = entries, moves

    def of_pair(self, left: Column, left_own: Column, right_own: Column) -> Column:
        """Rank of two adjacent pieces together, shifted to its place in a piece; ``NONE`` or more if they have none."""
        return self.entries[self.moves[left_own].bitwiseXOR(right_own)].bitwiseXOR(F.shiftleft(left, FOLD_LEFT))


class Literals:
    """The literal arrays of a tokenizer: rank map, pieces, and ids as little-endian bytes in hex."""

    DDL = "entries array<bigint>, moves array<bigint>, pieces array<string>, little array<string>"

    def __init__(self, ranks: dict[bytes, int]):
        entries, moves = pair_rows(ranks)
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")  # one character a byte
        self.arrays = [pa.array(entries), pa.array(moves), pa.array(pieces, pa.string()),
                       pa.array([k.to_bytes(4, "little").hex() for k in range(len(pieces))], pa.string())]

    def columns(self) -> list[pa.Array]:
        """One row of each array."""
        return [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in self.arrays]

    def ranked(self, body) -> Column:
        """``body`` of the rank map, which is read once for all words of a row."""
        return _let(F.col("entries"), lambda e: _let(F.col("moves"), lambda m: body(Ranks(e, m))))


NAMES = ["entries", "moves", "pieces", "little"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, not at each use inside a lambda: the end of a fold of no steps, which copies nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, body)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def encode_word(word: Column, ranks: Ranks) -> Column:
    """Ids of one word as a fold of ranked merges.

    A word to be folded has a number that is no piece at both ends; others
    are ids already.
    """
    folded = F.when(F.size(word) <= MASKED + 2, _fold(word, ranks, _rank_in_mask)).otherwise(_fold(word, ranks, _rank_by_places))
    return F.when(F.get(word, F.lit(0)) < _long(NONE), F.transform(word, lambda x: x.cast("int"))).otherwise(folded)


def _rank_in_mask(state: Column, least: Column, shift: Column) -> Column:
    """Number of pieces up to ``least``: of the bits up to its place."""
    return F.bit_count(F.call_function("shiftleft", state["places"], shift))


def _rank_by_places(state: Column, least: Column, shift: Column) -> Column:
    """Number of pieces up to ``least``, for words that have more pieces than a number has bits: places ascend."""
    return _let(least.bitwiseAND(_long(PLACE)), lambda here: F.size(F.filter(
        state["pieces"], lambda x: x.bitwiseAND(_long(PLACE)) <= here)))


def _fold(word: Column, ranks: Ranks, rank_of) -> Column:
    """The smallest number is the leftmost pair of the lowest rank.

    A merge takes the pair's rank as the new piece and the place of the pair's
    second piece, and looks up the pairs with its two neighbours only.  Few
    and plain expressions count here: Spark interprets each one in each step.
    """
    own = lambda piece: piece.bitwiseAND(_long(OWN))

    def merge(state: Column, least: Column) -> Column:
        pieces = state["pieces"]

        def at(shift: Column, k: Column, before: Column, low: Column) -> Column:
            new_before = ranks.of_pair(before, own(before), low).bitwiseOR(before.bitwiseAND(_long((1 << FOLD_RANK) - 1)))
            new = ranks.of_pair(low, low, own(pieces[k + F.lit(2)])).bitwiseOR(
                pieces[k + F.lit(1)].bitwiseAND(_long(PLACE))).bitwiseOR(low)
            merged = F.flatten(F.array(F.slice(pieces, F.lit(1), k - F.lit(1)), F.array(new_before, new),
                                       F.slice(pieces, k + F.lit(3), F.lit(LONG + 2))))
            gone = F.call_function("shiftrightunsigned", _long(-1 << 63), shift)
            return F.struct(merged.alias("pieces"), state["places"].bitwiseXOR(gone).alias("places"))

        # the place from the top of a number of 64 bits
        shift = F.bitwise_not(F.shiftright(least, OWN_BITS)).bitwiseAND(_long(63)).cast("int")
        return _let(shift, lambda sh: _let(rank_of(state, least, sh), lambda k: _let(
            pieces[k - F.lit(1)], lambda before: _let(F.shiftright(least, FOLD_RANK), lambda low: at(sh, k, before, low)))))

    def step(state: Column, _) -> Column:
        return _let(F.array_min(state["pieces"]), lambda least: F.when(least >= _long(NONE), state).otherwise(merge(state, least)))

    return F.aggregate(F.sequence(F.lit(4), F.size(word)), F.struct(word.alias("pieces"), _long(-1).alias("places")), step,
                       lambda state: F.transform(F.slice(state["pieces"], F.lit(2), F.size(state["pieces"]) - F.lit(2)),
                                                 lambda x: own(x).cast("int")))


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, with a heap of pairs and a linked list of pieces."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and end[j] == stop):
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = after[i]
    return ids


class Memo:
    """Words with known ids, tokens among them, as bytes that travel with a task."""

    def __init__(self, ranks: dict[bytes, int], found: pa.Table | None = None):
        tokens = pa.table({"word": pa.array(list(ranks), pa.binary()), "ids": pa.array([[r] for r in ranks.values()], pa.list_(pa.int32()))})
        parts = [tokens] if found is None else [tokens, found.cast(tokens.schema)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, tokens.schema) as out:
            out.write_table(pa.concat_tables(parts).combine_chunks())
        self.data = sink.getvalue().to_pybytes()
        self.words: pa.Array | None = None

    def __getstate__(self):
        return {"data": self.data, "words": None}

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word in the memo or -1, ids of all known words one after the other, and their ends)."""
        if self.words is None:
            table_ = pa.ipc.open_stream(self.data).read_all().combine_chunks()
            self.words, lists = table_["word"].chunk(0), table_["ids"].chunk(0)
            self.ids, self.ends = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        return at, self.ids, self.ends


def _word_column(words: list[bytes], ranks: dict[bytes, int], one: np.ndarray, two: np.ndarray, memo: Memo | None = None) -> pa.Array:
    """Pieces of words as numbers, from the ranks of single bytes and of pairs of bytes.

    Words to be folded have a number at both ends that is no piece.  Words that
    need no fold come as their ids: those of the memo, and those of more than
    ``LONG`` bytes.
    """
    column = pa.array(words, pa.binary())
    n_bytes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ids, id_ends = (np.full(len(words), -1), None, None) if memo is None else memo.find(column)
    long = np.flatnonzero((at < 0) & (n_bytes > LONG))
    merged = [merge_long(words[k], ranks) for k in long.tolist()]
    kind = np.where(at >= 0, 1, 0)  # 0: to be folded, 1: known, 2: merged here
    kind[long] = 2
    sizes = n_bytes + 2
    if memo is not None:
        sizes[kind == 1] = np.diff(id_ends)[at[kind == 1]]
    sizes[long] = [len(x) for x in merged]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(kind, sizes)
    pieces = np.zeros(ends[-1], np.int64)
    # bytes of the words to be folded
    folded = column.filter(pa.array(kind == 0))
    starts = folded.buffers()[1]
    starts = np.frombuffer(starts, np.int32)[folded.offset:folded.offset + len(folded) + 1].astype(np.int64) if len(folded) else np.zeros(1, np.int64)
    flat = np.frombuffer(folded.buffers()[2], np.uint8)[starts[0]:starts[-1]] if len(folded) else np.empty(0, np.uint8)
    starts = starts - starts[0]
    place = np.arange(len(flat)) - np.repeat(starts[:-1], np.diff(starts))
    pair = np.full(len(flat), NO_RANK, np.int64)
    if len(flat) > 1:
        pair[:-1] = two[flat[:-1].astype(np.int32) * 256 + flat[1:]]
    pair[starts[1:][np.diff(starts) > 0] - 1] = NO_RANK  # the last piece of a word has no next one
    inner = of == 0
    inner[ends[:-1][kind == 0]] = inner[ends[1:][kind == 0] - 1] = False
    pieces[of == 0] = NONE | PLACE | max(ranks.values()) + 1
    pieces[inner] = np.where(pair == NO_RANK, NONE, pair << FOLD_RANK) | place << OWN_BITS | one[flat]
    if memo is not None:
        which = at[kind == 1]
        n = np.diff(id_ends)[which]
        upto = np.cumsum(n)
        pieces[of == 1] = ids[np.arange(int(n.sum())) + np.repeat(id_ends[which] - (upto - n), n)]
    pieces[of == 2] = np.array([x for ids_ in merged for x in ids_], np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pieces))


def _finder(pattern: str):
    # tiktoken's \s is the Unicode property White_Space
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def _byte_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of single bytes and of pairs of bytes."""
    return (np.array([ranks[bytes([c])] for c in range(256)], np.int32),
            np.array([ranks.get(bytes([a, c]), NO_RANK) for a in range(256) for c in range(256)], np.int32))


def _count_words(pattern: str, ranks: dict[bytes, int]):
    """Words of blocks that need a fold, with their frequencies."""
    find = _finder(pattern)

    def run(batches):
        for _, texts in blocks(batches, 0, BLOCK_BYTES):
            times = Counter(w for text in texts for w in find(text))
            words = [(b, n) for w, n in times.items() if 1 < len(b := w.encode()) <= LONG and b not in ranks]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.binary()), pa.array([n for _, n in words], pa.int64())],
                                             names=["word", "times"])

    return run


def _fold_input(ranks: dict[bytes, int], literals: Literals):
    def run(batches):
        one, two = _byte_ranks(ranks)
        for batch in batches:
            if batch.num_rows:
                pieces = _word_column(batch.column(0).to_pylist(), ranks, one, two)
                rows = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), x) for x in (batch.column(0), pieces)]
                yield pa.RecordBatch.from_arrays([*rows, *literals.columns()], names=["known", "words", *NAMES])

    return run


def _codes(literals: Literals) -> Column:
    """Ids of all words of a row."""
    return literals.ranked(lambda ranks: F.transform("words", lambda w: encode_word(w, ranks)))


def common_words(texts: DataFrame, pattern: str, ranks: dict[bytes, int], literals: Literals) -> Memo:
    """Ids of words that a bounded sample holds twice or more; at most ``MEMO_WORDS`` words reach the driver."""
    n = texts.count()
    sample = texts.select("text").sample(min(1.0, MEMO_DOCS / max(1, n)), seed=1)
    words = sample.mapInArrow(_count_words(pattern, ranks), "word binary, times long").groupBy("word").agg(F.sum("times").alias("n"))
    words = words.filter("n > 1").select("word").limit(MEMO_WORDS).repartition(texts.sparkSession.sparkContext.defaultParallelism, "word")
    rows = words.mapInArrow(_fold_input(ranks, literals), f"known array<binary>, words array<array<bigint>>, {Literals.DDL}")
    folded = rows.select(F.inline(F.arrays_zip(F.col("known").alias("word"), _codes(literals).alias("ids"))))
    return Memo(ranks, folded.toArrow())


class _Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _split_blocks(pattern: str, ranks: dict[bytes, int], memo: Memo, literals: Literals):
    """One row for each block: its texts as lists of word numbers, and its distinct words."""
    find = _finder(pattern)

    def run(batches):
        one, two = _byte_ranks(ranks)
        kind = None

        def seen(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for ids, texts in blocks(seen(batches), 1, BLOCK_BYTES):
            number = _Numbers()
            numbers, ends = [], [0]
            for text in texts:
                words = find(text)
                ends.append(ends[-1] + len(words))
                numbers.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            words = _word_column([w.encode() for w in number], ranks, one, two, memo)
            del number, texts
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(numbers)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(kind)), pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), *literals.columns()],
                names=["ids", "numbers", "words", *NAMES])

    return run


def _blocks(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> tuple[DataFrame, Literals]:
    ranks = read_ranks(path)
    literals = Literals(ranks)
    bound_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    memo = common_words(texts, pattern, ranks, literals)
    return texts.mapInArrow(_split_blocks(pattern, ranks, memo, literals), f"ids array<{id_type}>, numbers array<array<int>>, "
                            f"words array<array<bigint>>, {Literals.DDL}"), literals


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row of ``docs``."""
    split, literals = _blocks(docs, path, pattern, id_col, text_col)
    tokens = _let(_codes(literals), lambda codes: F.transform(
        "numbers", lambda text: F.flatten(F.transform(text, lambda n: F.get(codes, n)))))
    rows = split.select(F.col("ids").alias("doc_id"), tokens.alias("ids"))
    return rows.select(F.inline(F.arrays_zip("doc_id", "ids")))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")  # one character a byte
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    joined = F.array_join(F.transform(col(ids_col), lambda i: F.get(literal, i)), "")
    return encoded.withColumn(out_col, F.encode(joined, "ISO-8859-1"))


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    Both are put together for each distinct word of a block once, and then for
    the texts by the words' numbers.
    """
    split, literals = _blocks(docs, path, pattern, id_col, text_col)

    def joined(codes: Column, table_: Column) -> Column:
        return F.transform(codes, lambda ids: F.array_join(F.transform(ids, lambda i: F.get(table_, i)), ""))

    def of_texts(words: Column) -> Column:
        return F.transform("numbers", lambda text: F.array_join(F.transform(text, lambda n: F.get(words, n)), ""))

    both = _let(_codes(literals), lambda codes: _let(F.col("little"), lambda little: _let(F.col("pieces"), lambda pieces: _let(
        joined(codes, little), lambda hexes: _let(joined(codes, pieces), lambda bytes_: F.struct(
            F.transform(of_texts(hexes), F.unhex).alias("ids"),
            F.transform(of_texts(bytes_), lambda t: F.encode(t, "ISO-8859-1")).alias("decoded")))))))
    rows = split.select(F.col("ids").alias("doc_id"), both.alias("b"))
    return rows.select(F.inline(F.arrays_zip("doc_id", F.col("b.ids").alias("ids"), F.col("b.decoded").alias("decoded"))))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encodes the texts and decodes the ids."""
    found = encode_and_decode(docs, path, pattern, id_col, text_col)
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                   public_tokenizers.PATTERN)
