"""Language ID by a linear-chain conditional random field over words.

A word (a run of letters, in lower case) is scored for each language by the
weights of its hashed character n-grams, of its affixes (n-grams with a word
end) and of the languages whose learned lexicon holds it.  Transitions
between the languages of neighbouring words are learned as well.  Forward-
backward gives each word's probability of each language, so switches inside a
text are seen; a document's language is the one with the largest mean.

Training takes a bounded sample: windows of ``WINDOW`` words from at most
``PER_LANGUAGE`` documents of each language.  A document's language labels its words; a share of the training
sequences joins parts of documents of two languages, which is where
transitions are learned.  The fit is numpy gradient descent on the driver;
its weights (``BUCKETS`` by languages) go to the tasks, which score whole
texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0,
as is every text if there is nothing to learn from.  Rows without an id or
language are not learned from.  Repeated rows are all returned.  Very long texts
are labelled whole; an empty table gives no rows; only the named columns are
read, so others cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bound_batches, col, table
from .subword import ngram_features, summed

PER_LANGUAGE = 400
WINDOW = 60
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
LEXICON = 300
BLOCK_BYTES = 8 << 20
#: Blocks and padded texts shrink in proportion with more labels than this.
FEW_LABELS = 32

_words = regex.compile(r"\p{L}+").findall


def held_out(id_col: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == which, F.lit(False))


class Model:
    """Weights of a fitted field: emissions by feature, lexicon, transitions, start."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.in_lexicon = np.zeros((n, n), np.float32)
        self.lexicon: dict[str, np.ndarray] = {}
        self.move = np.zeros((n, n))
        self.start = np.zeros(n)

    def membership(self, words: list[str]) -> np.ndarray:
        none = np.zeros(len(self.labels), np.float32)
        return np.array([self.lexicon.get(w, none) for w in words], np.float32).reshape(len(words), len(self.labels))

    def emissions(self, words: list[str]) -> np.ndarray:
        features, owners = ngram_features(words, SIZES, BUCKETS)
        return summed(self.weights, features, owners, len(words)) + self.membership(words) @ self.in_lexicon


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray):
    """(marginals, pair sums, log partition) of sequences padded to scores (sequence, word, label).

    Messages are kept as probabilities that are rescaled at each word.
    """
    n, steps, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - top)
    shift = move.max()
    step_move = np.exp(move - shift)
    alpha = np.empty((n, steps, k))
    log_z = np.zeros(n)
    a = np.exp(start - start.max()) * emit[:, 0]
    for t in range(steps):
        if t:
            a = (a @ step_move) * emit[:, t]
        total = a.sum(axis=1, keepdims=True)
        a = a / total
        alpha[:, t] = a
        log_z += np.where(t < lengths, np.log(total[:, 0]) + top[:, t, 0] + (shift if t else start.max()), 0)
    out = np.zeros((n, steps, k))
    pairs = np.zeros((k, k))
    beta = np.ones((n, k))
    for t in range(steps - 1, -1, -1):
        last = lengths - 1
        beta = np.where((t >= last)[:, None], 1.0, beta)
        p = alpha[:, t] * beta
        out[:, t] = p / p.sum(axis=1, keepdims=True) * (t < lengths)[:, None]
        if t:
            back = emit[:, t] * beta
            live = t < lengths
            joint = alpha[live, t - 1][:, :, None] * step_move * back[live][:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if live.any() else 0
            beta = back @ step_move.T
            beta /= beta.sum(axis=1, keepdims=True)
    return out, pairs, log_z


def _sequences(samples: list[tuple[int, list[str]]], draw) -> list[tuple[list[str], np.ndarray]]:
    """Training sequences (words, labels): each sample, a third of them with the start of another sample behind."""
    out = []
    for k, (label, words) in enumerate(samples):
        labels = np.full(len(words), label)
        if draw.random() < 1 / 3 and len(words) > 3:
            other, more = samples[draw.integers(len(samples))]
            cut = int(draw.integers(2, len(words)))
            more = more[:len(words) - cut]
            words, labels = words[:cut] + more, np.concatenate([labels[:cut], np.full(len(more), other)])
        out.append((words, labels))
    return out


def fit(samples: list[tuple[str, list[str]]], epochs: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 1) -> Model:
    """A model from (language, words) samples."""
    labels = sorted({lang for lang, _ in samples})
    model = Model(labels)
    n = len(labels)
    number = {lang: k for k, lang in enumerate(labels)}
    vocabulary: dict[str, int] = {}
    counts = [Counter() for _ in labels]
    for lang, words in samples:
        counts[number[lang]].update(words)
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    for k, count in enumerate(counts):
        for w in sorted(count, key=lambda w: (-count[w], w))[:LEXICON]:
            if count[w] > 1:
                model.lexicon.setdefault(w, np.zeros(n, np.float32))[k] = 1
    spelt = list(vocabulary)
    features, owners = ngram_features(spelt, SIZES, BUCKETS)
    ends = np.searchsorted(owners, np.arange(len(vocabulary) + 1))
    draw = np.random.default_rng(seed)
    data = [(number[lang], words) for lang, words in samples if words]
    g_weights, g_lexicon, g_move = np.full(model.weights.shape, 1e-6), np.full((n, n), 1e-6), np.full((n, n), 1e-6)
    for _ in range(epochs):
        sequences = _sequences([data[i] for i in draw.permutation(len(data))], draw)
        for at in range(0, len(sequences), batch):
            part = sequences[at:at + batch]
            lengths = np.array([len(w) for w, _ in part])
            ids = np.zeros((len(part), lengths.max()), np.int64)
            gold = np.zeros(ids.shape, np.int64)
            for r, (words, truth) in enumerate(part):
                ids[r, :len(words)] = [vocabulary[w] for w in words]
                gold[r, :len(words)] = truth
            live = np.arange(ids.shape[1]) < lengths[:, None]
            used, place = np.unique(ids[live], return_inverse=True)
            rows = np.concatenate([np.arange(ends[u], ends[u + 1]) for u in used])
            size = ends[used + 1] - ends[used]
            member = model.membership([spelt[u] for u in used.tolist()])
            f = features[rows]
            per_word = np.add.reduceat(model.weights[f], np.cumsum(size) - size, axis=0) + member @ model.in_lexicon
            scores = np.zeros((*ids.shape, n))
            scores[live] = per_word[place]
            marginal, pairs, _ = forward_backward(scores, lengths, model.move, model.start)
            error = -marginal[live]
            error[np.arange(len(error)), gold[live]] += 1
            words_error = np.stack([np.bincount(place, error[:, k], len(used)) for k in range(n)], 1)
            spread = np.repeat(words_error, size, axis=0) / len(part)
            gradient = np.stack([np.bincount(f, spread[:, k], BUCKETS) for k in range(n)], 1)
            g_weights += gradient ** 2
            model.weights += (rate * gradient / np.sqrt(g_weights)).astype(np.float32)
            gradient = member.T @ words_error / len(part)
            g_lexicon += gradient ** 2
            model.in_lexicon += (rate * gradient / np.sqrt(g_lexicon)).astype(np.float32)
            seen = np.zeros((n, n))
            both = live[:, 1:]
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            gradient = (seen - pairs) / len(part)
            g_move += gradient ** 2
            model.move += rate * gradient / np.sqrt(g_move)
    return model


def training_sample(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, list[str]]]:
    """At most ``PER_LANGUAGE`` windows of words for each language."""
    known = docs.filter(learn & col(lang_col).isNotNull() & col(id_col).isNotNull() & col(text_col).rlike(r"\p{L}"))
    known = known.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"),
                         F.xxhash64(col(id_col), F.lit("sample")).alias("draw"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not sizes:
        return []
    # a share of each language by hash, somewhat more than needed; then its smallest hashes
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * PER_LANGUAGE / r["n"])))))
    drawn = known.filter(F.pmod("draw", F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))
    words = F.split("text", r"\s+")
    first = F.pmod(F.shiftright("draw", 20), F.greatest(F.size(words) - WINDOW, F.lit(1)).cast("long")).cast("int")
    drawn = drawn.select("lang", "draw", F.array_join(F.slice(words, first + 1, WINDOW), " ").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    rows = drawn.withColumn("nth", order).filter(F.col("nth") <= PER_LANGUAGE).orderBy("lang", "nth").collect()
    return [(r["lang"], _words(r["text"].lower())) for r in rows]


def _predict(model: Model):
    def run(batches):
        first = None
        k = max(FEW_LABELS, len(model.labels))

        def seen(batches):
            nonlocal first
            for batch in batches:
                first = batch.schema.field(0).type
                yield batch

        for ids, texts in blocks(seen(batches), 1, BLOCK_BYTES * FEW_LABELS // k):
            number: dict[str, int] = {}
            sequences = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                         for words in (_words(t.lower()) for t in texts)]
            langs: list[str] = ["und"] * len(texts)
            scores = [0.0] * len(texts)
            if model.labels and number:
                words = list(number)
                emissions = np.concatenate([model.emissions(words[at:at + 20_000])
                                            for at in range(0, len(words), 20_000)]).astype(np.float64)
                order = [i for i in sorted(range(len(texts)), key=lambda i: len(sequences[i])) if len(sequences[i])]
                while order:
                    steps = len(sequences[order[-1]])  # texts of like length together, at most a million words of few labels
                    part = order[-max(1, min(512, 1_000_000 * FEW_LABELS // (steps * k), 1_000_000 * FEW_LABELS // k ** 2)):]
                    del order[-len(part):]
                    lengths = np.array([len(sequences[i]) for i in part])
                    padded = np.zeros((len(part), steps, len(model.labels)))
                    for r, i in enumerate(part):
                        padded[r, :lengths[r]] = emissions[sequences[i]]
                    marginal = marginals(padded, lengths, model.move, model.start)
                    mean = marginal / lengths[:, None]
                    for r, i in enumerate(part):
                        best = int(mean[r].argmax())
                        langs[i], scores[i] = model.labels[best], float(min(1.0, mean[r, best]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, first), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return run


def marginals(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum over each sequence's words of the probabilities of the labels."""
    return forward_backward(scores, lengths, move, start)[0].sum(axis=1)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_predict(model), f"doc_id {id_type}, lang_pred string, score double")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    return fit(training_sample(docs, learn, id_col, text_col, lang_col))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(F.col("doc_id"), 4, 2))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
