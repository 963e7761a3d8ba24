"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hashed character
n-grams and of the word itself; a document's vector is the mean of its words'
vectors, and a softmax over two classes scores it.  A word that repeats the
one before it adds one more token, ``REPEAT``, so runs of one word are seen
by the mean too.  Training is numpy stochastic gradient descent on a bounded
sample of labelled rows: at most ``ROWS`` documents, from each at most
``WINDOW`` words in a row.  As the output is linear in the mean, a task needs
one number for each distinct word, and it scores whole texts.

Defined cases: null and empty texts get the score of an average with no
words, the bias alone, as do all texts if there are no labels.  Labels that
are null, without a document or contradict each other for one document are
not learned from.  Repeated rows are all returned.  Of labels whose hashes tie
in the sample, the smaller id is taken first.  Very long texts are scored whole;
an empty table gives no rows; only the named columns are read, so others cannot
clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bound_batches, col, table
from .language_id import held_out
from .subword import ngram_features, summed

ROWS = 6000
WINDOW = 400
SIZES = (3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 8
THRESHOLD = 0.3
REPEAT = "\x04"
BLOCK_BYTES = 8 << 20


def tokens(text: str | None) -> list[str]:
    words = text.split() if text else []
    return words + [REPEAT] * sum(a == b for a, b in zip(words, words[1:]))


class Model:
    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias
        #: what each feature adds to the difference of the two classes' outputs
        self.gain = (vectors @ (out[:, 1] - out[:, 0]))[:, None].astype(np.float32)

    def word_gains(self, words: list[str]) -> np.ndarray:
        features, owners = ngram_features(words, SIZES, BUCKETS)
        return summed(self.gain, features, owners, len(words))[:, 0] / np.bincount(owners, minlength=len(words))


def fit(samples: list[tuple[int, list[str]]], epochs: int = 6, batch: int = 32, rate: float = 4.0, seed: int = 3) -> Model:
    """A model from (label, tokens) samples."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS))
    out, bias = draw.uniform(-0.5, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    data = [(label, words) for label, words in samples if words]
    if not data:
        return Model(vectors, np.zeros((DIMENSIONS, 2)), bias)
    vocabulary: dict[str, int] = {}
    documents = []
    for label, words in data:
        ids, times = np.unique([vocabulary.setdefault(w, len(vocabulary)) for w in words], return_counts=True)
        documents.append((label, ids, times / times.sum()))
    features, owners = ngram_features(list(vocabulary), SIZES, BUCKETS)
    ends = np.searchsorted(owners, np.arange(len(vocabulary) + 1))
    total = epochs * len(documents)
    done = 0
    for _ in range(epochs):
        order = draw.permutation(len(documents))
        for at in range(0, len(order), batch):
            part = [documents[i] for i in order[at:at + batch]]
            step = rate * (1 - done / total)
            done += len(part)
            words = np.concatenate([ids for _, ids, _ in part])
            share = np.concatenate([times for _, _, times in part])
            text = np.repeat(np.arange(len(part)), [len(ids) for _, ids, _ in part])
            size = ends[words + 1] - ends[words]
            upto = np.cumsum(size)
            f = features[np.arange(upto[-1]) + np.repeat(ends[words] - (upto - size), size)]
            weight = np.repeat(share / size, size)
            owner = np.repeat(text, size)
            mean = np.stack([np.bincount(owner, weight * vectors[f, d], len(part)) for d in range(DIMENSIONS)], 1)
            scores = mean @ out + bias
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [label for label, _, _ in part]] -= 1
            error = p / len(part)
            to_mean = error @ out.T
            out -= step * (mean.T @ error)
            bias -= step * 0.1 * error.sum(axis=0)
            for d in range(DIMENSIONS):
                vectors[:, d] -= step * 8 * np.bincount(f, weight * to_mean[owner, d], BUCKETS)
    return Model(vectors, out, bias)


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str) -> list[tuple[int, list[str]]]:
    """At most ``ROWS`` labelled documents, those of the smallest hashes, with a window of each text."""
    one = labels.filter(learn & F.col("quality").isin(0, 1)).groupBy(col(id_col).alias("id")).agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    chosen = one.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(ROWS).select("id", "quality")
    texts = docs.join(F.broadcast(chosen), col(id_col) == F.col("id"))  # at most ROWS rows
    words = F.split(F.trim(col(text_col)), r"\s+")
    first = F.pmod(F.xxhash64("id", F.lit("window")), F.greatest(F.size(words) - WINDOW, F.lit(1)).cast("long")).cast("int")
    rows = texts.filter(F.length(F.trim(col(text_col))) > 0).select(
        "id", "quality", F.array_join(F.slice(words, first + 1, WINDOW), " ").alias("text"))
    # copies of one id are averaged to one text, so that the sample stays bounded
    rows = rows.groupBy("id", "quality").agg(F.min("text").alias("text")).orderBy("id").collect()
    return [(r["quality"], tokens(r["text"])) for r in rows]


def _score(model: Model):
    def run(batches):
        first = None

        def seen(batches):
            nonlocal first
            for batch in batches:
                first = batch.schema.field(0).type
                yield batch

        base = float(model.bias[1] - model.bias[0])
        for ids, texts in blocks(seen(batches), 1, BLOCK_BYTES):
            number: dict[str, int] = {}
            found = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                     for words in map(tokens, texts)]
            words = list(number)
            gains = np.concatenate([np.empty(0), *(model.word_gains(words[at:at + 20_000])
                                                   for at in range(0, len(words), 20_000))])
            margin = np.array([base + (gains[w].mean() if len(w) else 0.0) for w in found])
            scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, first), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``; higher is likelier of good quality."""
    bound_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_score(model), f"doc_id {id_type}, score double")


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``learn``: which rows of ``labels`` (id, quality) may be learned from."""
    return fit(training_sample(docs, labels, learn, id_col, text_col))


def op6_quality_model(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    scores = score(docs, train(docs, labels, ~out & F.col("doc_id").isNotNull()))
    return scores.select("doc_id", out.alias("held_out"), "score",
                         F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
