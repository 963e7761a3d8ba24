"""Quality classifier and language identification."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import language_id as li
from sluice.llm import quality_model as qm
from sluice.llm.subword import ngram_features, summed

from texts import prose

TONGUES = {"aa": "bo ba bi bu ran tan", "bb": "ke ki kof lut mik ne", "cc": "xo xar zzu qe wy vur"}


def tongue(rnd, lang, n):
    parts = TONGUES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_features_of_a_word_do_not_depend_on_its_company():
    words = ["a", "naïve", "x" * 50, "漢字", "", "a\x02b"]
    features, owners = ngram_features(words, (2, 3), 1 << 20)
    for i, w in enumerate(words):
        alone, _ = ngram_features([w], (2, 3), 1 << 20)
        assert sorted(alone) == sorted(features[owners == i]) and len(alone)
    weights = np.random.default_rng(0).normal(size=(1 << 20, 2))
    assert np.allclose(summed(weights, features, owners, len(words))[1], weights[features[owners == 1]].sum(axis=0))


def test_forward_backward_matches_all_paths():
    draw = np.random.default_rng(4)
    scores, move, start = draw.normal(size=(2, 4, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    lengths = np.array([4, 2])
    got, pairs, log_z = li.forward_backward(scores, lengths, move, start)
    all_pairs = np.zeros((3, 3))
    for s, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = np.exp([start[p[0]] + sum(scores[s, t, k] for t, k in enumerate(p))
                         + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(log_z[s], np.log(weight.sum()))
        weight /= weight.sum()
        for t in range(n):
            for k in range(3):
                assert np.isclose(got[s, t, k], weight[[p[t] == k for p in paths]].sum())
        for p, x in zip(paths, weight):
            for a, b in zip(p, p[1:]):
                all_pairs[a, b] += x
    assert np.allclose(pairs, all_pairs) and not got[1, 2:].any()


def test_languages_are_told_apart_and_switches_seen(make_docs, rnd):
    rows = [(i, tongue(rnd, lang, rnd.randint(20, 80)), lang, "s") for i in range(240) for lang in [sorted(TONGUES)[i % 3]]]
    docs = make_docs(rows)
    out = li.held_out(F.col("doc_id"), 4, 2)
    model = li.train(docs, ~out)
    got = {r["doc_id"]: r for r in li.identify(docs, model).collect()}
    unseen = [r["doc_id"] for r in docs.filter(out).collect()]
    assert unseen and all(got[i]["lang_pred"] == sorted(TONGUES)[i % 3] and got[i]["score"] > 0.8 for i in unseen)
    mixed = make_docs([(1, tongue(rnd, "aa", 60) + " " + tongue(rnd, "bb", 20), None, None)])
    r = li.identify(mixed, model).first()
    assert r["lang_pred"] == "aa" and 0.6 < r["score"] < 0.9


def test_language_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for model in (li.train(docs, F.lit(True)), li.train(docs.limit(0), F.lit(True))):
        got = li.identify(docs, model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
        assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
        assert li.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in got} == {"und"}  # nothing was learned


def test_quality_is_learned_and_held_out_rows_agree(make_docs, rnd, spark):
    def junk(i):
        text = prose(rnd, 60)
        return [text.upper(), " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 60)][i % 3]

    rows = [(i, junk(i) if i % 4 == 0 else prose(rnd, 60), "en", "s") for i in range(400)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(9999, 1, 0), (None, 0, 0), (7, None, 1)],
                                   "doc_id long, quality int, toxic int")
    out = li.held_out(F.col("doc_id"), 5, 0)
    model = qm.train(docs, labels, ~out & F.col("doc_id").isNotNull())
    got = {r["doc_id"]: r["score"] for r in qm.score(docs, model).collect()}
    unseen = [r["doc_id"] for r in docs.filter(out).collect()]
    right = [(got[i] >= qm.THRESHOLD) == (i % 4 != 0) for i in unseen]
    assert len(unseen) > 50 and sum(right) >= 0.95 * len(right)


def test_quality_odd_rows(make_docs, odd_rows, spark):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 1, 0), (7, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for model in (qm.train(docs, labels, F.lit(True)), qm.train(docs, labels.limit(0), F.lit(True))):
        got = qm.score(docs, model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
        assert qm.score(docs.limit(0), model).count() == 0


def test_every_language_is_learned(make_docs, rnd):
    def text(k):
        a, b = divmod(k, 7)
        parts = ["bcdfgh"[a] + v + "klmnprs"[b] for v in "aeiou"]
        return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(30))

    rows = [(i, text(i % 40), f"l{i % 40:02}", "s") for i in range(40 * 12)]
    docs = make_docs(rows)
    model = li.train(docs, F.lit(True))
    assert model.labels == [f"l{k:02}" for k in range(40)]
    got = {r["doc_id"]: r["lang_pred"] for r in li.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows) >= 0.95 * len(rows)
