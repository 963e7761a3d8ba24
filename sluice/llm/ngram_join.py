"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. Each document becomes a class id (a hash of its whole shingle set, so
   copies are one class from here on) and ``BANDS`` band hashes of its
   MinHash values.
2. Classes that share a band are candidates.  A band's classes are each
   linked to its smallest one, and the connected components of these links
   are candidate clusters; nothing is paired yet.
3. A cluster is dealt out as blocks of ``BLOCK`` classes, and each pair of
   blocks is one unit of work for a task.  Within a unit, pairs that share a
   band are compared by MinHash values, ``STEP`` at a time: a pair is dropped
   as soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``TOLERANCE``.  The rest are verified
   exactly on their shingle sets.
4. A unit returns, for each class, its number of links, and a spanning forest
   of its links.  Pairs themselves are counted where they are found and never
   become rows, so a very large group of near copies costs work but no
   rows in the square of its size.
5. The components of the forests are the groups.

No candidate or partner is capped.  A pair at the threshold shares no band
with a probability of 3e-6 and is lost to pruning with less than
``TOLERANCE`` at each step; more similar pairs far less often.

Defined cases: null texts and texts without words are in no class and have no
links.  Repeated rows (equal id and text) are copies.  The smallest document
id names a group; a null id counts as larger than any.  Class ids have 64
bits: two different sets meet by chance with a probability of n * n / 2**65.
Very long texts are compared by all their shingles; an empty table gives no
rows; columns with the names used inside keep their values.
"""

from __future__ import annotations

import itertools
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, col, fresh, row_key, table
from .components import connected_components
from .shingles import MinHash, Shingler

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
BLOCK = 512


@lru_cache(None)
def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n MinHash values with P(similarity >= threshold | matches) >= tolerance.

    The posterior of the similarity is Beta(m + 1, n - m + 1).
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        density = np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(x) + (n - m) * np.log1p(-x))
        if density[x >= threshold].sum() / density.sum() >= tolerance:
            return m
    return n


def set_id(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _describe(batches):
    """Class id and band hashes of each row's text (its last column)."""
    shingler, minhash = Shingler(), MinHash(HASHES)
    band_mult = np.random.default_rng(7).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    number = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    from .shingles import _mixed

    for batch in batches:
        ids, bands = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            shingles = shingler(text)
            if not len(shingles):
                ids.append(None)
                bands.append(None)
                continue
            ids.append(set_id(shingles))
            values = minhash(shingles).reshape(BANDS, ROWS).astype(np.uint64)
            bands.append(_signed(_mixed((values * band_mult).sum(axis=1, dtype=np.uint64) + number)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=[*batch.schema.names[:-1], "c", "bands"])


def _sets(batches):
    """MinHash values and shingles of each row's text (its last column), as bytes."""
    shingler, minhash = Shingler(), MinHash(HASHES)
    for batch in batches:
        sig, sets = [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            shingles = shingler(text)
            sig.append(minhash(shingles).tobytes())
            sets.append(shingles.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sig, pa.binary()), pa.array(sets, pa.binary())],
                                         names=[*batch.schema.names[:-1], "sig", "shingles"])


def similar_pairs(sig_a, sets_a, sig_b, sets_b, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of the pairs with a similarity of at least the threshold.

    ``same``: a and b are one block, of which pairs i < j are taken.
    """
    shared = np.zeros((len(sig_a), len(sig_b)), bool)
    for band in range(0, HASHES, ROWS):
        equal = sig_a[:, None, band] == sig_b[None, :, band]
        for k in range(band + 1, band + ROWS):
            if not equal.any():
                break
            equal &= sig_a[:, None, k] == sig_b[None, :, k]
        shared |= equal
    i, j = np.nonzero(np.triu(shared, 1) if same else shared)
    matches = np.zeros(len(i), np.int32)
    for at in range(0, HASHES, STEP):  # incrementally: fewer pairs each time
        if not len(i):
            break
        for part in range(0, len(i), 1 << 16):
            cut = slice(part, part + (1 << 16))
            matches[cut] += (sig_a[i[cut], at:at + STEP] == sig_b[j[cut], at:at + STEP]).sum(axis=1, dtype=np.int32)
        likely = matches >= least_matches(min(at + STEP, HASHES))
        i, j, matches = i[likely], j[likely], matches[likely]
    return _verified(sets_a, sets_b, i, j)


def _verified(sets_a, sets_b, i, j):
    """The pairs whose exact similarity reaches the threshold."""
    if not len(i):
        return i, j
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if len(i) <= 64:
        common = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j)])
    else:
        rows_a, rows_b = np.unique(i), np.unique(j)
        values = np.concatenate([*(sets_a[x] for x in rows_a), *(sets_b[y] for y in rows_b)])
        owner = np.repeat(np.arange(len(rows_a) + len(rows_b)),
                          np.concatenate([size_a[rows_a], size_b[rows_b]]))
        _, number, times = np.unique(values, return_inverse=True, return_counts=True)
        often = times > 1  # a shingle of one text alone adds nothing
        place = np.cumsum(often) - 1
        keep = often[number]
        owner, number, width = owner[keep], place[number[keep]], int(often.sum())
        common_all = np.zeros((len(rows_a), len(rows_b)), np.float32)
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        for at in range(0, width, 4096):
            lo, hi = np.searchsorted(number, [at, at + 4096])
            dense = np.zeros((len(rows_a) + len(rows_b), min(4096, width - at)), np.float32)
            dense[owner[lo:hi], number[lo:hi] - at] = 1
            common_all += dense[:len(rows_a)] @ dense[len(rows_a):].T
        common = common_all[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)].astype(np.int64)
    # in whole numbers: common / union >= 4 / 5
    good = 5 * common >= 4 * (size_a[i] + size_b[j] - common)
    return i[good], j[good]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            tree.append((x, y))
    return tree


def _unit(rows: list[tuple]) -> tuple[list, list]:
    """Links of one unit: (class, other, None) for its forest, (class, None, number of linked documents)."""
    left, right = rows[0][1], rows[0][2]
    c = np.array([r[4] for r in rows], np.int64)
    weight = np.array([r[5] for r in rows], np.int64)
    sig = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(len(rows), HASHES)
    sets = [np.frombuffer(r[7], np.uint64) for r in rows]
    in_a = np.array([r[3] == left for r in rows])
    a = np.flatnonzero(in_a)
    b = a if left == right else np.flatnonzero(~in_a)
    i, j = similar_pairs(sig[a], [sets[x] for x in a], sig[b], [sets[x] for x in b], left == right)
    if not len(i):
        return [], []
    i, j = a[i], b[j]
    links = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
    some = np.flatnonzero(links)
    return _forest(c[i], c[j]), list(zip(c[some].tolist(), links[some].astype(int).tolist()))


def _units(batches):
    """Runs of rows with equal (cluster, left, right), which come sorted and may span batches."""
    def rows():
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    schema = pa.schema([("c", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
    out: list[tuple] = []
    for _, unit in itertools.groupby(rows(), key=lambda r: r[:3]):
        distinct = [next(same) for _, same in itertools.groupby(unit, key=lambda r: r[4])]  # sorted by class
        forest, links = _unit(distinct) if len(distinct) > 1 else ([], [])
        out += [(x, y, None) for x, y in forest] + [(x, None, n) for x, n in links]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def _candidates(described: DataFrame) -> DataFrame:
    """(c, cluster) of the classes that share a band with another."""
    bands = described.filter("c IS NOT NULL").select("c", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least != most")
    shared = materialize(shared.select("band", "least"))
    star = bands.join(shared, "band").filter("c != least").select(F.col("c").alias("a"), F.col("least").alias("b"))
    return connected_components(star.distinct()).withColumnsRenamed({"node": "c", "component": "cluster"})


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, classes): (doc_id, k1, k2, c) of every row, and (c, docs, group_id, keep1, keep2, n_links)
    of every class that has copies or links.

    ``n_links`` counts the other documents within the threshold, copies
    included; ``keep1``/``keep2`` are the row key of the group's smallest document.
    """
    bound_batches(docs.sparkSession)
    k1, k2 = row_key([col(id_col), col(text_col)])
    keyed = docs.select(col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2"), col(text_col).alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    described = materialize(keyed.mapInArrow(
        _describe, f"doc_id {id_type}, k1 long, k2 long, c long, bands array<long>"))

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    classes = materialize(described.filter("c IS NOT NULL").groupBy("c").agg(
        F.count(F.lit(1)).alias("docs"), F.min(place).alias("first")))

    members = _candidates(described)
    # written, as the smallest documents of the groups below, so that Spark can split a hot cluster in the join
    sizes = materialize(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))
    dealt = members.join(sizes, "cluster").withColumn("n_blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("c"), F.col("n_blocks")).cast("int"))
    chosen = dealt.join(classes, "c").select("c", "cluster", "n_blocks", "block", "docs",
                                             F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    # a sort-merge join at every size: what is chosen grows with the input, so it is never broadcast
    texts = keyed.select("k1", "k2", "text").join(materialize(chosen).hint("merge"), ["k1", "k2"])
    texts = texts.select("cluster", "n_blocks", "block", "c", "docs", "text")
    sets = texts.mapInArrow(_sets, "cluster long, n_blocks int, block int, c long, docs long, sig binary, shingles binary")
    units = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "cluster", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"),
        "block", "c", "docs", "sig", "shingles")
    found = units.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "c").mapInArrow(
        _units, "c long, other long, links long")
    found = materialize(found)

    links = found.filter("links IS NOT NULL").groupBy("c").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("other IS NOT NULL").select(F.col("c").alias("a"), F.col("other").alias("b")))
    some = classes.join(groups.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left").filter(
        "docs > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "c"))
    some = materialize(some)
    named = materialize(some.groupBy("component").agg(F.min("first").alias("group")))
    info = some.join(named, "component").select(
        "c", "docs", F.col("group.doc_id").alias("group_id"), F.col("group.k1").alias("keep1"),
        F.col("group.k2").alias("keep2"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return described.select("doc_id", "k1", "k2", "c"), materialize(info)


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the smallest document id of its group, its number of links."""
    rows, info = link(docs, id_col, text_col)
    joined = rows.join(info, "c", "left")
    return joined.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(
        F.col("group_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less all but the smallest document of each group; of repeated rows one stays."""
    rows, info = link(docs, id_col, text_col)
    verdicts = rows.join(info, "c").select(
        "k1", "k2", ((F.col("k1") == F.col("keep1")) & (F.col("k2") == F.col("keep2"))).alias("stays")).distinct()
    a, b, s = fresh(docs, "k1"), fresh(docs, "k2"), fresh(docs, "stays")
    k1, k2 = row_key([col(id_col), col(text_col)])
    verdicts = verdicts.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("stays").alias(s))
    keyed = docs.withColumns({a: k1, b: k2})
    gone = keyed.join(verdicts.filter(~col(s)).hint("merge"), [a, b], "left_anti")
    return gone.dropDuplicates([a, b]).drop(a, b)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
