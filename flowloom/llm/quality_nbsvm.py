"""Operator 8: quality classifier, a Naive Bayes support vector machine.

Features are indicators of hashed n-grams: words as written, and runs of one to three token shapes
(lower, title or upper case, digits, a punctuation run, a repeat of the words before). Each
indicator is scaled by its log-count ratio between the classes; a linear hinge-loss model is fitted
on the scaled indicators by dual coordinate descent, and its margin mapped to 0..1 by a logistic
curve: a fifth of the labelled rows is not fitted on, and the margins that the model gives it are
what the curve is fitted to.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS``, chosen by a hash of the id
among rows whose crc32 modulo 5 is not 0); every row is scored. Labels, language, source and ids
are no inputs of a score.

Defined results: null and empty texts have no features and get the score of the bias alone; without
labels of both classes every score is the share of label 1 (0.5 without any label); repeated rows
are kept, a null id is not held out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, labelled_sample, map_text, pieces
from .hashing import DIGIT, MARK, SPACE, Hasher, hash_of, joined, kinds, mix

#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 6_000
DIM = 1 << 18
#: The cost of a margin error, sweeps of coordinate descent, smoothing of the counts.
COST, SWEEPS, ALPHA = 0.1, 8, 1.0
THRESHOLD = 0.3

_SHAPES = DIM // 4  # the first quarter of the buckets is for shapes
#: Characters read at once; a longer text is tokenised in parts that end between words.
PART = 1 << 18

_MUL, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x51ED270B)
_LOWER, _TITLE, _UPPER, _NUMBER, _LINE = (np.uint64(k) for k in range(1, 6))
_NEWLINE = 4
#: Tokens that may repeat without meaning anything.
_PLAIN = np.array([hash_of(t) for t in ("\n", ",", ".", "|")], np.uint64)


def _case(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an upper-case or lower-case letter, ASCII or Latin-1, begins at each byte."""
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    behind = data[lead + 1]
    upper[lead[(behind < 0x9F) & (behind != 0x97)]] = True
    lower[lead[(behind >= 0x9F) & (behind != 0xB7)]] = True
    return upper, lower


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, hash and shape of each token: runs of letters, digits or marks, and every line end."""
    kind = kinds(data)
    kind[data == 10] = _NEWLINE
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _NEWLINE)) + 1
    edge = np.concatenate([[0], edge, [len(kind)]])
    own = kind[edge[:-1]] != SPACE
    start, stop = edge[:-1][own], edge[1:][own]
    kind, of = kind[start], Hasher(data)
    n_upper, n_lower = (np.concatenate([[0], np.cumsum(c)]) for c in _case(data))
    ups = n_upper[stop] - n_upper[start]
    shape = np.where(n_upper[start + 1] > n_upper[start], _TITLE, _LOWER)
    shape[(n_lower[stop] == n_lower[start]) & (ups > 0) & (stop - start > 1)] = _UPPER
    shape[kind == DIGIT], shape[kind == _NEWLINE] = _NUMBER, _LINE
    marks = kind == MARK
    shape[marks] = mix(of(start[marks], np.minimum(stop, start + 4)[marks]))
    return start, of(start, stop), shape


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text end to end, and where each text's begin (and the last's end)."""
    own = [list(pieces(t, PART)) for t in texts]
    parts, of, got = [p for x in own for p in x], np.repeat(np.arange(len(texts)), list(map(len, own))), []
    for a, b in blocks(np.array(list(map(len, parts)), np.int64), PART):
        data, begin = joined(parts[a:b])
        start, *rest = _tokens(data)
        got.append([of[a:b][np.searchsorted(begin, start, "right") - 1], *rest])
    if not got:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    doc, code, shape = (np.concatenate(x) for x in zip(*got, strict=True))
    word = ~np.isin(code, _PLAIN)
    for lag in range(1, 7):  # a word said again, or a short phrase or line: two tokens equal the two that stand ``lag`` before
        same = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag]) & word[lag:]
        shape[lag:][same if lag == 1 else same & np.concatenate([[False], same[:-1]])[: len(same)]] = _REPEAT
    one = shape * _MUL
    two = (one[:-1] ^ np.uint64(7)) * _MUL + shape[1:]
    three = (two[:-1] ^ np.uint64(11)) * _MUL + shape[2:]
    in2, in3 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    grams = mix(np.concatenate([one, two[in2] * _MUL, three[in3] * _MUL])) % np.uint64(_SHAPES)
    of_gram = np.concatenate([doc, doc[1:][in2], doc[2:][in3]])
    words = np.uint64(_SHAPES) + mix(code) % np.uint64(DIM - _SHAPES)
    found = np.unique(np.concatenate([of_gram, doc]) << 18 | np.concatenate([grams, words]).astype(np.int64))
    return found & (DIM - 1), np.searchsorted(found >> 18, np.arange(len(texts) + 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, found: np.ndarray, start: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[found], dtype=np.float64)])
        return (total[start[1:]] - total[start[:-1]]) / np.sqrt(np.maximum(1, np.diff(start))) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in blocks(np.array(list(map(len, texts)), np.int64), PART):
            out.append(1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts[a:b])) + self.shift, -30, 30))))
        return np.concatenate(out)


def coordinate_descent(x: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float, sweeps: int) -> tuple[np.ndarray, float]:
    """The L1-loss linear SVM's dual, one coordinate at a time; indicators scaled by ``r`` and row length."""
    w, bias = np.zeros(len(r)), 0.0
    alpha = np.zeros(len(x))
    values = [r[i] / math.sqrt(max(1, len(i))) for i in x]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    share = np.array([1 / max(1, (y == s).sum()) for s in y]) * len(y) / 2  # both classes weigh the same
    top = cost * share
    random = np.random.default_rng(8)
    for _ in range(sweeps):
        for k in random.permutation(len(x)):
            gradient = y[k] * (float(w[x[k]] @ values[k]) + bias) - 1
            new = min(max(alpha[k] - gradient / norm[k], 0.0), top[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                alpha[k] = new
                w[x[k]] += step * values[k]
                bias += step
    return w * r, bias


def fit(rows: list[tuple[str, str, int]]) -> Model:
    y = np.array([1 if r[2] == 1 else -1 for r in rows])
    if len(set(y.tolist())) < 2:
        p = 0.5 if not len(y) else 0.999 if y[0] > 0 else 0.001
        return Model(np.zeros(DIM), 0.0, 1.0, math.log(p / (1 - p)))
    x: list[np.ndarray] = []
    for a, b in blocks(np.array([len(r[1]) for r in rows]), PART):
        found, start = features([r[1] for r in rows[a:b]])
        x += np.split(found.astype(np.int32), start[1:-1])
    test = np.arange(len(x)) % 5 == 0
    if min((y[~test] == s).sum() for s in (-1, 1)) < 1 or len(x) < 50:
        test[:] = False

    def train(which):
        counts = {s: np.full(DIM, ALPHA) for s in (-1, 1)}
        for k in np.flatnonzero(which):
            counts[y[k]][x[k]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
        own = np.flatnonzero(which)
        return Model(*coordinate_descent([x[k] for k in own], ratio, y[own], COST, SWEEPS), 1.0, 0.0)

    model = train(~test)
    own = test if test.any() else ~test
    z = np.array([model.margins(i, np.array([0, len(i)]))[0] for i in x])[own]
    return Model(model.weights.astype(np.float32), model.bias, *calibrate(z, y[own]))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve on margins, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, held_out, score, predicted`` of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(labelled_sample(base, labels, "quality", max_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: {"score": shared.value.scores(texts)}

    scored = map_text(docs, make, "score double", id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
