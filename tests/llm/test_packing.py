import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from texts import prose
from tokenizers import Tokenizer

from sluice.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check_places(rows, capacity):
    """Every sequence is gapless from 0, within the capacity."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def decreasing(lens, capacity):
    """Sequences that best fit of all pieces at once needs, the longest first."""
    free = []
    p.best_fit(range(len(lens) - 1, -1, -1), lens, free, capacity, [0] * len(lens))
    return len(free)


def test_ids_match_the_library(make_docs, odd_rows, rnd, library):
    mixed = ["".join(chr(rnd.choice([rnd.randint(9, 0x7F), rnd.randint(0x80, 0x2FFF), rnd.randint(0x1F300, 0x1F9FF)]))
                     for _ in range(80)) for _ in range(60)]
    extra = ["a<|endoftext|>b <|startoftext|> <|endoftext|", "ΟΔΟΣ ΣΑΣ, İstanbul café, café e ́x", "don't we'LL x\x1cy z\x85w q\xa0r",
             "Ünïcode, «été» naïve! straße.", "Ⅷ ½ ²x 12345", "𝔘𝔫𝔦 ǅ ﬁn K", "a​b   c d"]
    docs = make_docs(odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(mixed + extra)])
    got = p.tokenise(docs, PATH).collect()
    expected = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4").tobytes()
            expected.append((r["doc_id"], k // 4096, k, len(part) // 4, zlib.crc32(part)))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_other_rules_encode_whole_texts(rnd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = p.Encoder(open(path, encoding="utf-8").read())
    texts = ["Two  words\n", "", "don't  é"]
    flat, sizes = encoder.encode(pa.array(texts))
    ids = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.by_chunk and flat.tolist() == sum(ids, []) and sizes.tolist() == [len(i) for i in ids]


def test_query_packs_all_pieces(spark, make_docs, odd_rows, rnd, tmp_path):
    rows = odd_rows + [(100 + i, prose(rnd, rnd.randint(1, 900)), "en", "a") for i in range(200)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in p.op11_best_fit_packing(spark, str(tmp_path)).collect()]
    pieces = p.tokenise(make_docs(rows), PATH).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) c").collect()
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got) == sorted(
        str(tuple(r)) for r in pieces)
    assert check_places(got, 4096) <= decreasing(sorted([r["length"] for r in got]), 4096)


def test_many_shards_and_migration(spark, rnd, monkeypatch):
    monkeypatch.setattr(p, "SHARD", 60)
    lens = [rnd.choice([1, 7, 30, 100, rnd.randint(1, 100), rnd.randint(1, 60)]) for _ in range(700)] + [41] * 300
    frame = spark.createDataFrame(list(enumerate(lens)), "row long, length long")
    got = [r.asDict() | {"length": lens[r["row"]]} for r in p.pack(frame, 100, islands=3, epochs=3).collect()]
    assert sorted(r["row"] for r in got) == list(range(1000))
    assert check_places(got, 100) <= 1.03 * decreasing(sorted(lens), 100)


def test_equal_lengths_that_never_fill_a_bin(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD", 8)
    frame = spark.createDataFrame([(k, 60) for k in range(50)], "row long, length long")
    got = [r.asDict() | {"length": 60} for r in p.pack(frame, 100).collect()]
    assert check_places(got, 100) == 50 and len(got) == 50


def test_crossover_keeps_every_piece_and_finds_hidden_perfect_packings():
    rng = np.random.default_rng(5)
    lens = []
    for _ in range(40):  # bins that can be full to the last place
        cuts = np.sort(rng.choice(np.arange(20, 980), 3, replace=False))
        lens += np.diff([0, *cuts, 1000]).tolist()
    problem = p.Problem(np.array(lens), 1000, rng)
    population = [problem.fresh(0.2 * k) for k in range(6)]
    for _ in range(10):
        child = problem.cross(population[0], population[1])
        assert len(child) == len(lens) and child.min() == 0 and problem.fills(child).max() <= 1000
        assert len(np.unique(child)) == child.max() + 1
    before = problem.worth(sorted(population, key=problem.worth)[-1])
    after = problem.evolve(population, 400)
    assert problem.worth(after[0]) >= before and problem.fills(after[0]).max() <= 1000
    assert len(problem.fills(after[0])) <= 42


def test_best_fit_takes_the_fullest_bin_that_has_room():
    bins, free = [-1] * 4, [50, 30, 10]
    p.best_fit([0, 1, 2, 3], [30, 45, 11, 10], free, 60, bins)
    assert bins == [1, 0, 3, 2] and free == [5, 0, 0, 49]


def test_sequences_hold_the_ids_in_order(spark, make_docs, rnd, library):
    docs = make_docs([(i, prose(rnd, 300), "en", "a") for i in range(30)])
    packed = p.pack_pieces(p.tokenise(docs, PATH, capacity=1024), 1024)
    rows = packed.collect()
    whole = {r["sequence_id"]: r["ids"] for r in p.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == r["ids"]
    assert sum(map(len, whole.values())) == sum(4 * r["length"] for r in rows)


def test_no_rows(spark, make_docs, odd_rows, tmp_path):
    make_docs(odd_rows).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.op11_best_fit_packing(spark, str(tmp_path)).count() == 0


def test_plain_and_marked_words_are_cut_together(monkeypatch, library):
    texts = ["Ab cd, ef.) gh é Don't 12 ?! x|", "", "ab! AB cd", "K. İa."]
    one_by_one, cut = [], p.parts_of
    monkeypatch.setattr(p, "parts_of", lambda chunk: one_by_one.append(chunk) or cut(chunk))
    with open(PATH, encoding="utf-8") as file:
        flat, sizes = p.Encoder(file.read()).encode(pa.array(texts))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in wanted] and flat.tolist() == [i for x in wanted for i in x]
    assert sorted(filter(None, one_by_one)) == sorted(["é", "Don't", "12", "?!", "x|", "İa."])
