"""Operator 10: toxicity, a convolutional text classifier trained in numpy.

A word's vector is the mean of hashed embeddings: of the word, of its beginnings of three to five
bytes and of its end of three. Filters one, two and three words wide run over the whole text, each
takes its maximum, and a logistic layer joins them. A maximum has one place, so a step of training
touches only the windows that won. Words are runs of letters or of digits of the lower-cased text;
they are found, hashed and looked up for many texts at once.

Only buckets of several training texts have an embedding, so a word that a single text has cannot
decide, and its first number begins with how far the texts that have it lean to a class. A fifth of
the labelled rows is not trained on: it chooses the pass over the others that stays.

Thresholds are calibrated by language, for the model that scores, on that fifth: each language (told
from the text by its function words) gets the margin that separates its classes best, and that
margin is what a score of 0.5 stands for. Languages with too few rows use the margin of all.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS``, chosen by a hash of the id
among rows whose crc32 modulo 5 is not 0); every row is scored over its whole text. Labels, the
columns lang and source, and ids are no inputs of a score.

Defined results: null, empty and blank texts, and texts without a letter or digit, have score 0;
without labels of both classes every other text has score 0 (1 if all labels are 1); repeated rows
are kept, a null id is not held out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, held_out, keep_rows, labelled_sample, map_text, pieces
from .hashing import DIGIT, LETTER, Hasher, hash_of, joined, kinds, mix, runs_of

#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 4_000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 12, 6, (1, 2, 3)
BATCH, RATE = 64, 0.02
#: Rows shown in training, repeats counted; few rows are shown more often.
SHOWN, LEAST_EPOCHS, MOST_EPOCHS = 24_000, 5, 200
#: Labelled rows of a language, at least, for a threshold of its own.
LEAST = 60
#: Texts of the training rows, at least, that a bucket's words are in.
LEAST_TEXTS = 3
#: Bound of the standard score that an embedding begins with.
LEAN = 8.0
THRESHOLD = 0.5
#: Characters whose words are looked up at once; a longer text is read in parts that end between words.
PART = 1 << 18

_FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split(),
    "fr": "le la les de des du et un une que qui est dans pour pas sur au avec ce il elle par plus ne se en ou".split(),
    "de": "der die das und in zu den von mit ist des sich auf nicht ein eine dem im für als auch es an werden aus er".split(),
    "es": "el la los las de que y en un una es por con no para su al lo como más del se".split(),
}
LANGUAGES = (*_FUNCTION_WORDS, "other")
#: Parts of a word that have an embedding; a word of three bytes or fewer has the first only.
PARTS = 5


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all function words, sorted, and a row for each that tells the languages that have it."""
    rows: dict[int, list[bool]] = {}
    for k, own in enumerate(_FUNCTION_WORDS.values()):
        for w in own:
            rows.setdefault(hash_of(w), [False] * len(_FUNCTION_WORDS))[k] = True
    keys = sorted(rows)
    return np.array(keys, np.uint64), np.array([rows[k] for k in keys])


_FW_HASH, _FW_HAS = _function_words()


@dataclass
class Words:
    """Words of several texts: distinct ones with their buckets, and the texts as their numbers."""

    ids: np.ndarray
    start: np.ndarray  # where each text's words begin in ids, and the end
    buckets: np.ndarray  # (distinct words, PARTS); BUCKETS where a word has no such part
    count: np.ndarray  # parts that each distinct word has
    languages: np.ndarray  # (texts, languages): function words


    def some(self, rows: np.ndarray) -> Words:
        """The same for some of the texts."""
        size = (self.start[1:] - self.start[:-1])[rows]
        ids = np.concatenate([self.ids[:0], *(self.ids[self.start[k] : self.start[k + 1]] for k in rows.tolist())])
        used, ids = np.unique(ids, return_inverse=True)
        return Words(ids, np.concatenate([[0], np.cumsum(size)]), self.buckets[used], self.count[used], self.languages[rows])


def _hashes(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each word of some bytes begins, its hash, those of its parts and its length."""
    kind = kinds(text)
    kind[(kind != LETTER) & (kind != DIGIT)] = 0
    start, stop = runs_of(kind)
    of, size = Hasher(text), stop - start
    first = [of(start, start + np.minimum(size, k)) for k in (3, 4, 5)]
    return start, of(start, stop), *first, of(stop - np.minimum(size, 3), stop), size


def read(texts: list[str]) -> Words:
    own = [list(pieces(t.lower(), PART)) for t in texts]
    parts, of = [p for x in own for p in x], np.repeat(np.arange(len(texts), dtype=np.int32), list(map(len, own)))
    got, n = [], 0
    for a, b in blocks(np.array(list(map(len, parts))), PART):
        data, begin = joined(parts[a:b])
        start, own, p3, p4, p5, s3, size = _hashes(data)
        word, first, ids = np.unique(own, return_index=True, return_inverse=True)
        table = np.full((len(word), PARTS), BUCKETS, np.int32)
        for k, (h, least) in enumerate(((own, 1), (p3, 4), (s3, 4), (p4, 5), (p5, 6))):
            has = size[first] >= least
            table[has, k] = mix(h[first][has] ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(BUCKETS)
        got.append((of[a:b][np.searchsorted(begin, start, "right") - 1], (ids + n).astype(np.int32), word, table))
        n += len(word)
    doc, ids, word, table = (np.concatenate(x) for x in zip(*got, strict=True))
    if len(got) > 1:  # the same word in several blocks is one
        word, first, same = np.unique(word, return_index=True, return_inverse=True)
        ids, table = same[ids], table[first]
    at = np.minimum(np.searchsorted(_FW_HASH, word), len(_FW_HASH) - 1)
    known = np.where((_FW_HASH[at] == word)[:, None], _FW_HAS[at], False)
    spoken = np.zeros((len(texts), len(_FUNCTION_WORDS)), np.int64)
    heard = np.flatnonzero(known.any(1)[ids])
    np.add.at(spoken, doc[heard], known[ids[heard]])
    start = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(ids, start, table, (table < BUCKETS).sum(1), spoken)


def languages(spoken: np.ndarray) -> np.ndarray:
    """Which language's function words each text has most of; "other" without any."""
    return np.where(spoken.max(1, initial=0) > 0, spoken.argmax(1), len(LANGUAGES) - 1)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS rows and one of zeros
    filters: list[np.ndarray]  # of each width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    constant: float | None = None


def vectors(embedding: np.ndarray, buckets: np.ndarray, count: np.ndarray) -> np.ndarray:
    return embedding[buckets].sum(1) / np.maximum(count, 1)[:, None].astype(np.float32)


def maxima(projected: list[list[np.ndarray]], ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's maximum over each text, and where it is; every text has a word.

    ``projected``: for each width and place in a window what each word adds. A window may hang over
    the end of its text; what is missing there adds nothing.
    """
    last = np.repeat(start[1:], np.diff(start)) - np.arange(len(ids))  # words left in the text
    top, places = [], []
    for parts in projected:
        total = parts[0][ids]
        for k in range(1, len(parts)):
            more = parts[k][ids[k:]]
            more[last[:-k] <= k] = 0
            total[: len(total) - k] += more
        where = np.array([total[a:b].argmax(0) + a for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)])
        top.append(total[where, np.arange(total.shape[1])])
        places.append(where)
    return np.concatenate(top, axis=1), places


class Scorer:
    def __init__(self, model: Model):
        self.m = model

    def margins(self, words: Words) -> np.ndarray:
        """The margin of each text; NaN without words."""
        m, out = self.m, np.full(len(words.start) - 1, np.nan)
        has = np.diff(words.start) > 0
        if has.any():
            vec = vectors(m.embedding, words.buckets, words.count)
            start = np.concatenate([words.start[:-1][has], words.start[-1:]])
            top, _ = maxima([[vec @ f[k] for k in range(len(f))] for f in m.filters], words.ids, start)
            out[has] = np.maximum(top + m.bias, 0) @ m.out + m.out_bias
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in blocks(np.array(list(map(len, texts)), np.int64), PART):
            words = read(texts[a:b])
            if self.m.constant is not None:
                out[a:b] = np.where(np.diff(words.start) > 0, self.m.constant, 0.0)
                continue
            z = self.margins(words) - self.m.thresholds[languages(words.languages)]
            out[a:b] = np.where(np.isnan(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return out


def leaning(words: Words, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets have a part of a word of at least ``LEAST_TEXTS`` of the texts, and how far each leans to class 1.

    The lean is the standard score of the texts of class 1 among those that have the bucket.
    """
    texts = np.zeros((2, BUCKETS + 1))
    for k, t in zip(rows.tolist(), y.tolist(), strict=True):
        texts[t, np.unique(words.buckets[np.unique(words.ids[words.start[k] : words.start[k + 1]])])] += 1
    n, share = texts.sum(0), y.mean()
    known = n >= LEAST_TEXTS
    known[BUCKETS] = False
    lean = (texts[1] - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share) + 1e-9)
    return known, np.where(known, np.clip(lean, -LEAN, LEAN), 0)


def train(words: Words, rows: np.ndarray, y: np.ndarray, unseen: np.ndarray, truth: np.ndarray, seed: int = 10) -> Model:
    """Adam on the logistic loss over some of the texts; the rarer class weighs as much as four times its rows at most.

    After each pass the ``unseen`` texts are scored; the model of the pass with the least loss over
    them stays, and training ends when a quarter of all passes has not found a better one.
    """
    random = np.random.default_rng(seed)
    epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, SHOWN // max(1, len(rows))))
    known, lean = leaning(words, rows, y)
    words = Words(words.ids, words.start, np.where(known[words.buckets], words.buckets, BUCKETS), words.count, words.languages)
    best: tuple[float, Model, int] | None = None
    params = {"e": random.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "o": random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.array([-1.0], np.float32)}
    params["e"][BUCKETS] = 0
    for w in WIDTHS:
        params[f"f{w}"] = random.normal(0, 0.5 / math.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32)
    params["e"][:, 0] = lean / 4  # the first place of a vector begins with what the counts tell, and a filter with it
    params["f1"][0, :, 0] = np.eye(SIZE)[0] * 2
    params["o"][0], params["b"][0] = 1.0, -1.0
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    boost = min(4.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())))
    step = 0
    size = np.diff(words.start)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = random.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            some = some[size[rows[some]] > 0]
            if not len(some):
                continue
            own = rows[some]
            start = np.cumsum([0, *size[own]])
            used, ids = np.unique(np.concatenate([words.ids[words.start[k] : words.start[k + 1]] for k in own]), return_inverse=True)
            parts, count = words.buckets[used], words.count[used]
            vec = vectors(params["e"], parts, count)
            hidden, wins = maxima([[vec @ params[f"f{w}"][k] for k in range(w)] for w in WIDTHS], ids, start)
            pre = hidden + params["b"]
            act = np.maximum(pre, 0)
            keep = random.random(act.shape) > 0.2
            act = act * keep / 0.8
            z = act @ params["o"] + params["c"][0]
            t = y[some]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * np.where(t == 1, boost, 1) / len(own)
            grads = {"o": act.T @ g, "c": np.array([g.sum()])}
            gp = g[:, None] * params["o"][None, :] * keep / 0.8 * (pre > 0)
            grads["b"] = gp.sum(0)
            gv = np.zeros_like(vec)
            for j, w in enumerate(WIDTHS):
                f, gw = params[f"f{w}"], gp[:, j * FILTERS : (j + 1) * FILTERS]
                gf = np.zeros_like(f)
                for k in range(w):
                    place = wins[j] + k
                    inside = place < start[1:][:, None]
                    word = ids[np.minimum(place, len(ids) - 1)]
                    x = vec[word] * inside[:, :, None]
                    gf[k] = np.einsum("dfs,df->sf", x, gw)
                    np.add.at(gv, word.ravel(), (gw[:, :, None] * f[k].T[None] * inside[:, :, None]).reshape(-1, SIZE))
                grads[f"f{w}"] = gf
            hot = np.flatnonzero(np.abs(gv).sum(1))
            step += 1
            for name, gr in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * gr
                second[name] = 0.99 * second[name] + 0.01 * gr * gr
                params[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if len(hot):
                unique, inverse = np.unique(parts[hot].ravel(), return_inverse=True)
                total = np.zeros((len(unique), SIZE), np.float32)
                np.add.at(total, inverse, np.repeat(gv[hot] / count[hot][:, None], PARTS, axis=0))
                total[unique == BUCKETS] = 0
                second["e"][unique] += total * total  # Adagrad: rows are touched at very different rates
                params["e"][unique] -= 4 * rate * total / (np.sqrt(second["e"][unique]) + 1e-6)
        if len(unseen) or epoch == epochs - 1:
            now = Model(params["e"] * known[:, None], [params[f"f{w}"].copy() for w in WIDTHS], params["b"].copy(), params["o"].copy(), float(params["c"][0]))
            loss = log_loss(Scorer(now).margins(words.some(unseen)), truth, boost) if len(unseen) else 0.0
            if best is None or loss < best[0]:
                best = loss, now, epoch
            elif epoch - best[2] > max(2, epochs // 4):
                break
    return best[1]


def log_loss(z: np.ndarray, y: np.ndarray, boost: float) -> float:
    """Mean logistic loss, a text without words being sure of class 0."""
    z = np.clip(np.nan_to_num(z, nan=-30.0), -30, 30)
    return float((np.log1p(np.exp(np.where(y == 1, -z, z))) * np.where(y == 1, boost, 1)).mean())


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The margin with the fewest errors, in the middle of its gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    low, high = z[k - 1] if k else z[0] - 1, z[k] if k < len(z) else z[-1] + 1
    return float((low + high) / 2)


def fit(rows: list[tuple[str, str, int]]) -> Model:
    y = np.array([int(r[2] == 1) for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        empty = Model(np.zeros((1, SIZE)), [], np.zeros(1), np.zeros(1), 0.0)
        empty.constant = float(len(y) > 0 and y[0] == 1)
        return empty
    words = read([r[1] for r in rows])
    every = np.arange(len(y))
    test = every % 5 == 0
    if len(y) < 40 or (y[~test] == 1).sum() < 1:
        test[:] = False
    model = train(words, every[~test], y[~test], every[test], y[test])
    z, of = Scorer(model).margins(words), languages(words.languages)
    own = ~np.isnan(z) & (test | ~test.any())
    z, of, t = z[own], of[own], y[own]
    common = threshold(z, t) if len(z) else 0.0
    for k in range(len(LANGUAGES)):
        mine = of == k
        enough = mine.sum() >= LEAST and 3 <= t[mine].sum() <= mine.sum() - 3
        model.thresholds[k] = threshold(z[mine], t[mine]) if enough else common
    return model


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int):
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(base, labels, "toxic", max_rows)))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    shared = _model(docs, labels, id_col, text_col, max_rows)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: (scorer.scores(texts) < THRESHOLD).tolist()

    return keep_rows(docs, make, text_col)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, held_out, score, predicted`` of every row."""
    shared = _model(docs, labels, id_col, text_col, max_rows)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts: {"score": scorer.scores(texts)}

    scored = map_text(docs, make, "score double", id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
