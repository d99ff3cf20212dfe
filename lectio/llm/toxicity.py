"""Toxicity with a bidirectional gated recurrent network and attention pooling, in numpy.

A word's input is its learned hashed word vector beside the scaled sum of its learned hashed character
n-gram vectors. Two gated recurrent layers (Cho et al., 2014) read a text from both ends; attention
pools their states over every window of `WINDOW` words, one from each word on (a text shorter than a
window is one window), and a logistic layer scores each. A text's score is that of its highest window,
rescaled (below).

The layers read stretches of `STRETCH` words that overlap by 2 * `CONTEXT`: a state belongs to the middle
words of its stretch, so it has read at least `CONTEXT` words on either side where the text has them,
and the windows share the states of their words instead of reading them 32 times. Pooling is a ratio
of sums over a window, which running sums give for all windows of a text at once.

Only texts are labelled, so training is multiple-instance: a text's logit is the soft maximum
log(mean(exp(beta * z))) / beta of its windows' logits, with a beta that grows by epoch. All weights and
vectors start at random and are trained by gradients alone (Adam; Adagrad for the vectors). Of a long text an epoch takes
`TAKEN` random stretches; afterwards two numbers, scale and shift of the highest window's logit, are
fitted on whole texts. The labelled sample is bounded by `per_class` (clean, toxic), whatever the
data; it is fitted in one task. Every document is scored over its whole text.

Defined cases: a null or empty text has no window and scores as a text that no window speaks
against, below any toxic one; without labelled rows of both classes every score is the share of
label 1 (0 if there are none); repeated rows give repeated scores; an empty table an empty result;
further columns are ignored (or, by drop_toxic, kept unchanged).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, fit_in_task, held_out, read_table, small, texts, training_rows
from .subword import Vocabulary, scattered, sum_by

WINDOW, STRETCH, CONTEXT = 32, 96, 16
STEP = STRETCH - 2 * CONTEXT
HIDDEN, DIM, POOL = 16, 16, 8
BUCKETS, GRAMS = 1 << 16, (3, 4, 5, 6)
PER_CLASS, MAX_CHARS = (1400, 700), 16_000
EPOCHS, BATCH, TAKEN, RATE, VECTOR_RATE = 6, 24, 6, 0.01, 0.1
#: Hardness of the soft maximum in the first and the last epoch.
BETA = (1.0, 8.0)
#: Words whose gate inputs a worker remembers, and stretches that are read at a time.
REMEMBERED, BLOCK = 60_000, 256
#: Update gate's input for places outside a text: the state stays as it is.
_STAY = 1e4
_SPLIT = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _SPLIT.findall(text.lower())


def stretches(n: int) -> np.ndarray:
    """Places of the stretches of a text of n words; those below 0 or from n on are outside it."""
    return np.arange(0, max(n, 1), STEP)[:, None] - CONTEXT + np.arange(STRETCH)


@dataclass
class Model:
    word: np.ndarray  # BUCKETS x DIM
    char: np.ndarray  # BUCKETS x DIM
    par: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    floor: float = 0.0  # stands for the highest window's logit of a text without words
    constant: float | None = None


def new_model(rng: np.random.Generator) -> Model:
    d, h = 2 * DIM, HIDDEN
    make = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[-2])).astype(np.float32)
    par = {
        # update, reset and candidate x the two directions
        "W": make(3, 2, d, h),
        "U": make(3, 2, h, h),
        "b": np.zeros((3, 2, 1, h), np.float32),
        "A": make(2 * h, POOL),
        "v": make(POOL, 1)[:, 0],
        "o": make(2 * h, 1)[:, 0],
        "c": np.zeros(1, np.float32),
    }
    small = lambda: rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    return Model(small(), small(), par)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


# ------------------------------------------------------------------ the network


def word_inputs(model: Model, words: Vocabulary, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Input vectors of words of the vocabulary, and what their gradients need."""
    whole, grams, owner = words.features(ids)
    size = np.sqrt(np.maximum(np.bincount(owner, minlength=len(ids)), 1)).astype(np.float32)[:, None]
    return np.concatenate([model.word[whole], sum_by(owner, model.char[grams], len(ids)) / size], axis=1), (whole, grams, owner, size)


def project(par: dict, x: np.ndarray) -> np.ndarray:
    """Words' parts of the gates, 3 x 2 x (words + 1) x h; the last row stands for no word."""
    out = np.zeros((3, 2, len(x) + 1, HIDDEN), x.dtype)
    np.matmul(x, par["W"], out=out[:, :, :-1])
    out[:, :, :-1] += par["b"]
    out[0, :, -1] = _STAY
    return out


def read(par: dict, gates: np.ndarray, at: np.ndarray, keep: bool = False):
    """States of both directions, steps x rows x 2h, of rows of word numbers (rows x steps)."""
    rows, steps = at.shape
    h, U = HIDDEN, par["U"]
    state = np.zeros((2, rows, h), gates.dtype)
    out = np.empty((steps, rows, 2 * h), gates.dtype)
    r, x = np.empty((3, 2, rows, h), gates.dtype), np.empty((3, 2, rows, h), gates.dtype)
    order = np.ascontiguousarray(at.T)
    tape = []
    for t in range(steps):
        for d, ids in enumerate((order[t], order[steps - 1 - t])):
            for g in range(3):
                np.take(gates[g, d], ids, axis=0, out=x[g, d], mode="clip")
        np.matmul(state, U, out=r)
        zg = x[:2]
        zg += r[:2]
        zg *= 0.5
        np.tanh(zg, out=zg)
        zg *= 0.5
        zg += 0.5
        n = x[2]
        before = r[2].copy() if keep else None
        r[2] *= zg[1]
        n += r[2]
        np.tanh(n, out=n)
        if keep:
            tape.append((state.copy(), zg[0].copy(), zg[1].copy(), n.copy(), before))
        state -= n
        state *= zg[0]
        state += n
        out[t, :, :h] = state[0]
        out[steps - 1 - t, :, h:] = state[1]
    return (out, tape) if keep else out


def pool_terms(par: dict, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each state: attention weight, contribution to the logit, hidden layer of the attention."""
    hidden = np.tanh(states @ par["A"])
    return np.exp(hidden @ par["v"]), states @ par["o"], hidden


def window_logits(
    weight: np.ndarray, value: np.ndarray, size: np.ndarray, c: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all windows of consecutive texts of size[i] words, their texts, begins and ends.

    Pooling and the logistic layer are one weighted mean: sum(weight * value) / sum(weight) + c.
    """
    count = np.maximum(size - WINDOW, 0) + 1
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(size) - size
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    end = begin + np.minimum(size, WINDOW)[owner]
    total = np.r_[0.0, np.cumsum(weight, dtype=np.float64)]
    product = np.r_[0.0, np.cumsum(weight.astype(np.float64) * value)]
    return (product[end] - product[begin]) / (total[end] - total[begin]) + c, owner, begin, end


def backward(par: dict, gates: np.ndarray, at: np.ndarray, saved, d_out: np.ndarray, used: int) -> tuple[dict, np.ndarray]:
    """Gradients of U and of the words' parts of the gates (3 x 2 x used x h); d_out: by the states."""
    _, tape = saved
    rows, steps = at.shape
    h, U = HIDDEN, par["U"]
    back = U.transpose(0, 1, 3, 2)
    d_gates = np.empty((3, 2, steps, rows, h), gates.dtype)
    d_u, d_state = np.zeros_like(U), np.zeros((2, rows, h), gates.dtype)
    for t in range(steps - 1, -1, -1):
        before, z, g, n, rn = tape[t]
        d_state[0] += d_out[t, :, :h]
        d_state[1] += d_out[steps - 1 - t, :, h:]
        d = d_gates[:, :, t]
        d_n = d_state * (1 - z)
        d_n *= 1 - n * n
        d[0] = d_state * (before - n) * z * (1 - z)
        d[1] = d_n * rn * g * (1 - g)
        d[2] = d_n
        d_r = np.stack([d[0], d[1], d_n * g])
        d_u += before.transpose(0, 2, 1) @ d_r
        d_state = d_state * z + (d_r @ back).sum(axis=0)
    flat = np.ascontiguousarray(at.T)
    d_gates = d_gates.reshape(3, 2, -1, h)
    by_word = np.empty((3, 2, used, h), gates.dtype)
    for k, ids in enumerate((flat.ravel(), flat[::-1].ravel())):
        real = ids < used
        joined = sum_by(ids[real], d_gates[:, k][:, real].transpose(1, 0, 2).reshape(-1, 3 * h), used)
        by_word[:, k] = joined.reshape(used, 3, h).transpose(1, 0, 2)
    return {"U": d_u}, by_word


def gradients(par: dict, x: np.ndarray, at: np.ndarray, size: np.ndarray, target: np.ndarray, gain: np.ndarray, beta: float):
    """Loss and gradients of one batch: by the parameters and by the input vectors x.

    at: word numbers of stretches (len(x) outside a text); size: words of each text among the
    stretches' middles, text after text.
    """
    gates = project(par, x)
    saved = read(par, gates, at, keep=True)
    inner = slice(CONTEXT, STRETCH - CONTEXT)
    places = np.flatnonzero((at[:, inner] < len(x)).ravel())  # row by row, as texts run on
    states = saved[0][inner].transpose(1, 0, 2).reshape(-1, 2 * HIDDEN)[places]
    weight, value, hidden = pool_terms(par, states)
    z, owner, begin, end = window_logits(weight, value, size, float(par["c"][0]))
    # soft maximum over the windows of a text
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    top = np.maximum.reduceat(z, first)
    e = np.exp(beta * (z - top[owner]))
    total = np.add.reduceat(e, first)
    count = np.bincount(owner)
    logit = top + np.log(total / count) / beta
    loss = float((gain * (np.logaddexp(0, logit) - target * logit)).sum() / len(target))
    d_z = (gain * (1 / (1 + np.exp(-logit)) - target) / len(target))[owner] * e / total[owner]
    # a window's weighted mean: d value = weight / sum, d weight = (value - mean) / sum
    sums = np.r_[0.0, np.cumsum(weight, dtype=np.float64)]
    share = d_z / (sums[end] - sums[begin])
    spread = lambda y: np.cumsum(np.bincount(begin, y, len(weight) + 1) - np.bincount(end, y, len(weight) + 1))[:-1]
    a, b = spread(share), spread(share * (z - float(par["c"][0])))
    d_value, d_weight = (weight * a), (value * a - b)
    d_e = (d_weight * weight).astype(x.dtype)
    d_value = d_value.astype(x.dtype)
    grad = {"c": np.array([d_z.sum()], x.dtype), "o": states.T @ d_value, "v": hidden.T @ d_e}
    d_hidden = d_e[:, None] * par["v"] * (1 - hidden * hidden)
    grad["A"] = states.T @ d_hidden
    d_states = d_value[:, None] * par["o"] + d_hidden @ par["A"].T
    d_out = np.zeros((STRETCH, len(at), 2 * HIDDEN), x.dtype)
    inside = np.zeros((len(at) * STEP, 2 * HIDDEN), x.dtype)
    inside[places] = d_states
    d_out[inner] = inside.reshape(len(at), STEP, -1).transpose(1, 0, 2)
    more, d_gates = backward(par, gates, at, saved, d_out, len(x))
    grad |= more
    grad["b"] = d_gates.sum(axis=2, keepdims=True)
    grad["W"] = x.T @ d_gates
    return loss, grad, (d_gates @ par["W"].transpose(0, 1, 3, 2)).sum(axis=(0, 1))


# ------------------------------------------------------------------ training


def fit(rows: list[tuple[str, int]], seed: int = 11, epochs: int = EPOCHS) -> Model:
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    words = Vocabulary(BUCKETS, GRAMS)
    split = [(words.add(words_of(t)), y) for t, y in rows]
    split = [(ids, y) for ids, y in split if len(ids)]
    labels = np.array([y for _, y in split], np.int64)
    if len(set(labels.tolist())) < 2:
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model
    gain = (0.5 / (np.bincount(labels, minlength=2) / len(labels)))[labels]  # classes weigh the same
    adam: dict = {}
    squares = (np.full(BUCKETS, 1e-6, np.float32), np.full(BUCKETS, 1e-6, np.float32))
    steps, done = epochs * -(-len(split) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(split))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            part = done / max(1, steps - 1)
            done += 1
            _train(
                model,
                words,
                [split[i][0] for i in pick],
                labels[pick],
                gain[pick],
                BETA[0] * (BETA[1] / BETA[0]) ** part,
                adam,
                squares,
                done,
                1 - 0.9 * part,
                rng,
            )
    _calibrate(model, [t for t, _ in rows], np.array([y for _, y in rows], np.float64))
    return model


def _train(
    model: Model,
    words: Vocabulary,
    texts_: list[np.ndarray],
    target: np.ndarray,
    gain: np.ndarray,
    beta: float,
    adam: dict,
    squares,
    step: int,
    pace: float,
    rng: np.random.Generator,
) -> None:
    """One step of Adam (Kingma and Ba, 2015) on the parameters, of Adagrad on the vectors."""
    rows, size = [], []
    for ids in texts_:
        places = stretches(len(ids))
        if len(places) > TAKEN:
            places = places[np.sort(rng.choice(len(places), TAKEN, replace=False))]
        out = (places < 0) | (places >= len(ids))
        rows.append(np.where(out, -1, ids[np.where(out, 0, places)]))
        size.append(int((~out[:, CONTEXT : STRETCH - CONTEXT]).sum()))
    at = np.concatenate(rows)
    used, back = np.unique(at, return_inverse=True)
    back = back.reshape(at.shape)
    if used[0] < 0:
        used, back = used[1:], np.where(back == 0, len(used) - 1, back - 1)
    x, (whole, grams, owner, norm) = word_inputs(model, words, used)
    _, grad, d_x = gradients(model.par, x, back, np.array(size), target, gain, beta)
    for k, g in grad.items():
        p = model.par[k]
        m, v = adam.setdefault(k, (np.zeros_like(p), np.zeros_like(p)))
        g = g.reshape(p.shape).astype(p.dtype)
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= (pace * RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    _adagrad(model.word, squares[0], whole, d_x[:, :DIM], pace)
    _adagrad(model.char, squares[1], grams, (d_x[:, DIM:] / norm)[owner], pace)


def _adagrad(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, grad: np.ndarray, pace: float) -> None:
    """One step on the rows used; a row has one accumulated square (Duchi et al., 2011)."""
    used, total = scattered(rows, grad, len(table))
    squares[used] += (total * total).mean(axis=1)
    table[used] -= np.float32(pace * VECTOR_RATE) * total / np.sqrt(squares[used])[:, None]


def _calibrate(model: Model, group: list[str], labels: np.ndarray, rounds: int = 40) -> None:
    """Scale and shift of the highest logits, by Newton's method on the (regularised) logistic loss."""
    scorer = Scorer(model)
    z = np.concatenate([scorer.logits(part) for part in by_size(group, 1_000_000)])
    good = np.isfinite(z)
    z, y = z[good], labels[good]
    middle, width = z.mean(), max(float(z.std()), 1e-6)
    X = np.stack([(z - middle) / width, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        curve = (X * (p * (1 - p))[:, None]).T @ X + np.diag([1.0, 1e-3])
        move = np.linalg.solve(curve, X.T @ (p - y) + np.array([1.0, 1e-3]) * w)
        w -= move * min(1.0, 4 / max(1e-9, float(np.abs(move).max())))
    model.scale, model.shift = max(float(w[0]) / width, 1e-6), float(w[1] - w[0] * middle / width)
    model.floor = float(z.min())


# ------------------------------------------------------------------ scoring


class Scorer:
    """Scores whole texts; the words' parts of the gates are remembered, boundedly, across batches."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.words, self.learned = Vocabulary(BUCKETS, GRAMS), 0
        # number 0 stands for no word, word i has number i + 1; room is doubled as words come in
        self.gates = np.zeros((3, 2, 1 << 14, HIDDEN), np.float32)
        self.gates[0, :, 0] = _STAY

    def _learn(self) -> None:
        if len(self.words) >= self.gates.shape[2]:
            room = np.zeros((3, 2, max(2 * self.gates.shape[2], len(self.words) + 1), HIDDEN), np.float32)
            room[:, :, : self.learned + 1] = self.gates[:, :, : self.learned + 1]
            self.gates = room
        for part in self.words.parts(self.learned):
            self.gates[:, :, part[0] + 1 : part[-1] + 2] = project(self.model.par, word_inputs(self.model, self.words, part)[0])[:, :, :-1]
        self.learned = len(self.words)

    def logits(self, group: list[str]) -> np.ndarray:
        """The highest window's logit of each text, minus infinity for texts without words."""
        split = [words_of(t) for t in group]
        if len(self.words) + sum(map(len, split)) > REMEMBERED and len(self.words) + len(self.words.unknown(split)) > REMEMBERED:
            self._forget()
        ids = [self.words.add(w) for w in split]
        self._learn()
        size = np.array([len(i) for i in ids])
        best = np.full(len(group), -np.inf)
        have = np.flatnonzero(size)
        if not len(have):
            return best
        line = np.concatenate([ids[i] for i in have]).astype(np.int64)
        first = np.repeat(np.cumsum(size[have]) - size[have], -(-size[have] // STEP))
        until = np.repeat(np.cumsum(size[have]), -(-size[have] // STEP))
        begin = np.concatenate([np.arange(0, n, STEP) for n in size[have]]) + first - CONTEXT
        weight, value = np.empty(len(line), np.float32), np.empty(len(line), np.float32)
        done = 0
        for k in range(0, len(begin), BLOCK):
            places = begin[k : k + BLOCK, None] + np.arange(STRETCH)
            out = (places < first[k : k + BLOCK, None]) | (places >= until[k : k + BLOCK, None])
            at = np.where(out, 0, line[np.where(out, 0, places)] + 1)
            states = read(self.model.par, self.gates, at)[CONTEXT : STRETCH - CONTEXT].transpose(1, 0, 2)
            states = states[~out[:, CONTEXT : STRETCH - CONTEXT]]
            weight[done : done + len(states)], value[done : done + len(states)] = pool_terms(self.model.par, states)[:2]
            done += len(states)
        z, owner, _, _ = window_logits(weight, value, size[have], float(self.model.par["c"][0]))
        best[have] = np.maximum.reduceat(z, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
        return best

    def scores(self, group: list[str]) -> np.ndarray:
        m = self.model
        if m.constant is not None:
            return np.full(len(group), m.constant)
        z = self.logits(group)
        z = np.where(np.isfinite(z), z, m.floor)
        # rounded, as sums differ in their last digits by the rows that are read together
        return 1 / (1 + np.exp(-np.clip(np.round(m.scale * z + m.shift, 3), -60, 60)))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, keep=None, *, per_class: tuple[int, int] = PER_CLASS, max_chars: int = MAX_CHARS
) -> Model:
    return fit_in_task(training_rows(docs, labels, "toxic", keep, per_class, max_chars), fit)


def _score(model: Model, group: list[str], kept: dict) -> np.ndarray:
    if "scorer" not in kept:
        kept["scorer"] = Scorer(model)
    return np.concatenate([np.empty(0), *[kept["scorer"].scores(part) for part in by_size(group, 1_000_000)]])


def score_toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: the probability that the text's worst window is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, about 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in small(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(_score(shared.value, texts(b.column(1)), kept), pa.float64())],
                ["doc_id", "score"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs, columns unchanged, whose score stays below `limit`."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for b in small(batches):
            yield b.filter(pa.array(_score(shared.value, texts(b.column(at)), kept) < limit))

    return docs.mapInArrow(run, docs.schema)


#: The query's fold: rows whose crc32(doc_id as text) modulo 5 is 0 are held out.
FOLD = ("doc_id", 5, 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), ~held_out(*FOLD))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(*FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
