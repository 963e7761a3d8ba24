import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sluice.llm import collocations as c


def expected(rows, threshold, longest, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= threshold}
        found = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in often.items())
            if len(p) > 1 and not inside:
                s, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def made(rnd, n):
    words = ["Alpha", "beta", "ga\x85mma", "délta", "É", "x\xa0y", "the", "of", "🙂", "a\x00b"]
    phrases = ["New York City", "of the", "machine learning is fun indeed", "Alpha\tbeta", "the the the"]
    rows = []
    for _ in range(n):
        parts = [rnd.choice(words + phrases * 2) for _ in range(rnd.randint(0, 30))]
        text = "".join(p + rnd.choice([" "] * 8 + [".", ", ", "\n", "!  ", "\t", "\r\n"]) for p in parts)
        rows.append((text, rnd.choice(["en"] * 6 + ["de", None, ""])))
    return rows + [(None, "en"), ("", "fr"), (" .,\n", "fr"), ("one two " * 3000, "zz")]


@pytest.mark.parametrize("blocks", [1 << 20, 300])
def test_results_of_plain_counting(spark, rnd, monkeypatch, blocks):
    monkeypatch.setattr(c, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(c, "PARTITION_WORDS", 700)
    rows = made(rnd, 250)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n int, words string").repartition(3)
    got = sorted(map(tuple, c.collocations(docs, 5, 5, 12).collect()))
    assert got == expected(rows, 5, 5, 12)


def test_shared_summaries_lose_less_than_the_threshold():
    rnd = np.random.default_rng(3)
    keys = np.concatenate([rnd.integers(0, 1 << 32, 20_000), np.repeat(rnd.integers(0, 1 << 32, 9), 120)]).astype(np.uint64)
    rnd.shuffle(keys)
    capacity = len(keys) // 100 + 1
    parts = [np.unique(p, return_counts=True) for p in np.array_split(keys, 40)]
    summary = c.MisraGries(capacity)
    for p in parts:
        summary.merge(*p)
    true = dict(zip(*np.unique(keys, return_counts=True)))
    assert summary.lost < 100 and len(summary.keys) <= capacity and summary.lost > 0
    assert {k for k, n in true.items() if n >= 100} <= set(summary.at_least(100))
    for k, n in zip(summary.keys, summary.counts):
        assert n <= true[k] <= n + summary.lost
    # two halves, summarised apart and then merged, keep the same bounds
    halves = [c.MisraGries(capacity) for _ in range(2)]
    for i, p in enumerate(parts):
        halves[i % 2].merge(*p)
    halves[0].merge(halves[1].keys, halves[1].counts, halves[1].lost)
    assert halves[0].lost < 100 and {k for k, n in true.items() if n >= 100} <= set(halves[0].at_least(100))


def test_keys_that_collide_are_told_apart_by_words():
    numbers = np.array([0, 1, 2, 0, 1, 3], np.int32)
    first, counts = c.equal_phrases(numbers, np.array([0, 1, 3]), np.array([7, 7, 7], np.uint64), 2)
    assert sorted(zip(first.tolist(), counts.tolist())) == [(0, 2), (1, 1)]


def test_planes_round_trip(rnd):
    values = np.array([0, 1, 255, 256, 2**32 - 1, *(rnd.randrange(2**32) for _ in range(50))])
    assert (c.from_planes(c.planes(values)) == values).all()


def test_what_a_task_holds_is_bounded_when_all_n_grams_survive(rnd, monkeypatch):
    for name, value in (("SLICE", 64), ("SKIP_BITS", 6), ("BATCH_PHRASES", 7), ("SUM_PHRASES", 5)):
        monkeypatch.setattr(c, name, value)
    rows = [(text or "", lang or "und") for text, lang in made(rnd, 60) * 2]
    docs = [pa.record_batch({"lang": [r[1] for r in rows[k:k + 20]], "text": [r[0] for r in rows[k:k + 20]]}) for k in range(0, len(rows), 20)]
    blocks = list(c._write_blocks(2000)(docs))
    assert all(b["n"][0].as_py() <= 2000 or b["lang"][0].as_py() == "zz" for b in blocks)
    schema = pa.schema({"block": pa.int64(), "keys": pa.binary(), "lang": pa.string(), "words": pa.list_(pa.string()), "numbers": pa.binary()})
    sorted_rows, plain = [], Counter()
    for k, b in enumerate(blocks):
        lang, words, numbers = c._unpack_block(b.append_column("block", pa.array([k])), 0)
        keys = np.unique(np.concatenate([x for _, _, x in c.ngram_keys(lang, words, numbers, 3, 5)]))
        assert (keys >> np.uint64(32)).max() < 15
        sorted_rows += [{"block": k, "keys": x.tobytes()} for x in np.array_split(keys, 3)]
        sorted_rows.append({"block": k, "lang": lang, "words": words.to_pylist(), "numbers": c.planes(numbers + 1)})
        names = words.to_pylist()
        for n in range(1, 6):
            for i in range(len(numbers) - n + 1):
                if (numbers[i:i + n] >= 0).all():
                    plain[lang, n, " ".join(names[w] for w in numbers[i:i + n])] += 1
    out = list(c._count_survivors(3, 5)(pa.Table.from_pylist(sorted_rows, schema).to_batches(max_chunksize=4)))
    assert max(len(b["phrases"].flatten()) for b in out) <= 7
    counted = Counter()
    for row in (r for b in out for r in b.to_pylist()):
        for phrase, a in zip(row["phrases"], row["counts"]):
            counted[row["lang"], row["words"], phrase] += a
    assert counted == plain
    together = pa.Table.from_batches(out).sort_by([(x, "ascending") for x in ("lang", "words", "share")])
    found = [r for b in c._sum_shares(4)(together.to_batches(max_chunksize=9)) for r in b.to_pylist()]
    assert sorted((r["lang"], r["words"], r["phrase"], r["a"]) for r in found) == sorted((*k, a) for k, a in plain.items() if a >= 4)


def test_a_row_group_holds_few_blocks_and_keys_are_not_gathered_in_the_heap(spark, rnd, monkeypatch):
    monkeypatch.setattr(c, "BLOCK_BYTES", 300)
    written, write = [], c.materialize
    monkeypatch.setattr(c, "materialize", lambda df, **options: written.append(df) or write(df, **options))
    blocks = c.word_blocks(spark.createDataFrame(made(rnd, 250), "text string, lang string").coalesce(1))
    c.frequent_phrases(blocks, 5)
    groups = [f.metadata.row_group(k).num_rows for f in (pq.ParquetFile(p.removeprefix("file://")) for p in blocks.inputFiles())
              for k in range(f.metadata.num_row_groups)]
    assert sum(groups) > 20 and max(groups) <= 8
    assert not any("collect_list" in df._jdf.queryExecution().optimizedPlan().toString() for df in written)


def test_scores_are_exact_beyond_64_bits(spark):
    rnd = random.Random(4)
    rows = [(a, n, rnd.randint(a, 10**12), rnd.randint(a, 10**12))
            for a, n in ((rnd.randint(100, 10**10), rnd.randint(10**12, 10**16)) for _ in range(300))]
    rows += [(10**10, 10**16, 10**10, 10**10), (333, 10**15 + 1, 1000, 999)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", c.score("a", "n", "l", "r").alias("s")).collect()
    for a, n, left, right, s in got:
        assert s == 1000 * a * n // (left * right)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert c.collocations(docs).collect() == []
