"""Quality classifier with supervised subword embeddings (in the manner of Joulin et al., "Bag of
Tricks for Efficient Text Classification", 2016).

A word is the mean of the learned vectors of its hashed whole form and its hashed character n-grams.
Two neighbouring words are a word bigram: the mean of two learned vectors, of the hashed pair of whole
forms and of the hashed pair of word ends (the last `ENDING` bytes), which speaks of pairs never
seen as a whole. A document is the mean of its words and bigrams; a softmax layer gives the
probability. Vectors and layer are trained by stochastic gradient descent in numpy on a bounded
number of labelled texts (`per_class` of each class, a fixed bound whatever the data), in one task;
every document is scored over its whole text.

Defined cases: a null or empty text has no words and scores the layer's bias alone; without
labelled rows of both classes the score is the share of label 1 among them (0.5 if there are none);
repeated rows give repeated scores; an empty table an empty result; further columns are ignored
(or, by keep_quality, kept unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, fit_in_task, held_out, read_table, small, texts, training_rows
from .subword import Vocabulary, bucket, mix, scattered, sum_by

#: Vectors of whole words and n-grams come first, those of bigrams after them.
BUCKETS, PAIRS, DIM, GRAMS, ENDING = 1 << 16, 1 << 16, 12, (2, 3, 4), 1
PER_CLASS, MAX_CHARS, EPOCHS, RATE = 600, 16_000, 6, 1.0
#: Words whose vectors a worker remembers.
REMEMBERED = 150_000


def ending(word: str) -> bytes:
    return word[-ENDING:].encode("utf8", "surrogatepass")[-ENDING:]


class Words(Vocabulary):
    """A vocabulary that knows the hashes of word ends too."""

    def __init__(self):
        super().__init__(BUCKETS, GRAMS)
        self.ends = np.empty(0, np.uint64)

    def _make(self) -> None:
        super()._make()
        if len(self.ends) < len(self):
            fresh = np.array([int.from_bytes(ending(w), "little") for w in islice(self.known, len(self.ends), None)], np.uint64)
            self.ends = np.concatenate([self.ends, mix(mix(fresh + np.uint64(1)) + np.uint64(2))])

    def bigrams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs of whole forms and of the pairs of ends of neighbouring words."""
        self._make()
        pair = lambda h, of: BUCKETS + bucket(mix(mix(h[ids[:-1]] + np.uint64(of)) + h[ids[1:]]), PAIRS)
        return pair(self.hashes, 3), pair(self.ends, 4)


@dataclass
class Model:
    vectors: np.ndarray  # (buckets + pairs) x dim
    weights: np.ndarray  # dim x 2
    bias: np.ndarray
    constant: float | None = None  # the score if nothing could be fitted

    def probability(self, mean: np.ndarray) -> np.ndarray:
        z = (mean @ self.weights + self.bias).astype(np.float64)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))


def _bag(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a text's vectors and their weights, which add up to 1."""
    used, count = np.unique(ids, return_counts=True)
    whole, grams, owner = words.features(used)
    share = count / (1 + np.bincount(owner, minlength=len(used)))
    pairs = np.concatenate(words.bigrams(ids))
    rows = np.concatenate([whole, grams, pairs])
    weight = np.concatenate([share, share[owner], np.full(len(pairs), 0.5)]) / (2 * len(ids) - 1)
    rows, back = np.unique(rows, return_inverse=True)
    return rows, np.bincount(back, weight).astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE, batch: int = 16) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS + PAIRS, DIM)).astype(np.float32) * np.float32(0.5 / DIM)
    model = Model(vectors, np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32))
    words = Words()
    split = [(words.add(t.split()), y) for t, y in rows]
    split = [(ids, y) for ids, y in split if len(ids)]
    labels = np.array([y for _, y in split], np.int64)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.5
        return model
    model.weights[:] = rng.normal(0, 0.5, (DIM, 2))
    bags = [_bag(words, ids) for ids, _ in split]
    share = np.bincount(labels, minlength=2) / len(labels)
    gain = (0.5 / share)[labels].astype(np.float32)  # classes weigh the same
    steps, done = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            pick = order[at : at + batch]
            f = np.concatenate([bags[i][0] for i in pick])
            w = np.concatenate([bags[i][1] for i in pick])
            own = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            mean = sum_by(own, model.vectors[f] * w[:, None], len(pick))
            p = model.probability(mean).astype(np.float32)
            off = ((p - labels[pick]) * gain[pick])[:, None]
            grad = np.concatenate([-off, off], axis=1)  # by the two logits
            lr = np.float32(rate * (1 - done / steps))
            back = grad @ model.weights.T
            model.weights -= lr * (mean.T @ grad) / len(pick)
            model.bias -= lr * grad.mean(axis=0)
            used, total = scattered(f, w[:, None] * back[own], len(model.vectors))
            model.vectors[used] -= lr * 40 / len(pick) * total
            done += 1
    return model


class Scorer:
    """Scores texts; word vectors are remembered, boundedly, across batches."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words, self.learned, self.table = Words(), 0, np.empty((1 << 14, DIM), np.float32)

    def scores(self, group: list[str]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(group), self.model.constant)
        split = [t.split() for t in group]
        if len(self.words) + sum(map(len, split)) > REMEMBERED and len(self.words) + len(self.words.unknown(split)) > REMEMBERED:
            self._forget()
        ids = [self.words.add(w) for w in split]
        self._learn()
        means = np.zeros((len(group), DIM), np.float32)
        vectors = self.model.vectors
        for i, own in enumerate(ids):
            if len(own):
                total = self.table[own].sum(axis=0, dtype=np.float64)
                for k in range(0, len(own) - 1, 1 << 16):
                    for rows in self.words.bigrams(own[k : k + (1 << 16) + 1]):
                        total += 0.5 * vectors[rows].sum(axis=0, dtype=np.float64)
                means[i] = total / (2 * len(own) - 1)
        return self.model.probability(means)

    def _learn(self) -> None:
        if len(self.words) > len(self.table):  # room is doubled as words come in
            room = np.empty((max(2 * len(self.table), len(self.words)), DIM), np.float32)
            room[: self.learned] = self.table[: self.learned]
            self.table = room
        for part in self.words.parts(self.learned):
            whole, grams, owner = self.words.features(part)
            size = 1 + np.bincount(owner, minlength=len(part)).astype(np.float32)[:, None]
            self.table[part] = (self.model.vectors[whole] + sum_by(owner, self.model.vectors[grams], len(part))) / size
        self.learned = len(self.words)


def fit_quality(docs: DataFrame, labels: DataFrame, keep=None, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    return fit_in_task(training_rows(docs, labels, "quality", keep, (per_class, per_class), max_chars), fit)


def _score(model: Model, group: list[str], kept: dict) -> np.ndarray:
    if "scorer" not in kept:
        kept["scorer"] = Scorer(model)
    return np.concatenate([np.empty(0), *[kept["scorer"].scores(part) for part in by_size(group)]])


def score_quality(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: the probability that the quality label is 1."""

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, about 6 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in small(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(_score(shared.value, texts(b.column(1)), kept), pa.float64())],
                ["doc_id", "score"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, columns unchanged, whose score reaches `least`."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in small(batches):
            yield b.filter(pa.array(_score(shared.value, texts(b.column(at)), kept) >= least))

    return docs.mapInArrow(run, docs.schema)


#: The query's fold: rows whose crc32(doc_id as text) modulo 3 is 1 are held out.
FOLD = ("doc_id", 3, 1)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"), ~held_out(*FOLD))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(*FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
