"""Operator 2: quality rules on repetition.

Words are runs of anything but ASCII white space. Every word gets a 64-bit code; rolling hashes of
5 to 10 codes are compared inside each text in numpy, which gives the words, and from them the
characters, that lie in an n-gram found at least twice. Lines are compared as strings.

Defined results: a null or empty text has no words, so all counts are 0, base_failed is true and
kept is false. Repeated rows give repeated results; ids may be null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text
from .hashing import mix

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Largest share of a text's word characters inside duplicated n-grams, by n.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest shares of lines that repeat an earlier line, and of their word characters.
MAX_LINE_SHARE = 0.30
MAX_LINE_CHAR_SHARE = 0.20
#: Largest share of symbols to words.
MAX_SYMBOL_SHARE = 0.10

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD1342543DE82EF95)


def repeated(codes: np.ndarray, n: int) -> np.ndarray:
    """True at the words inside an n-gram of ``codes`` that occurs at least twice."""
    m = len(codes) - n + 1
    covered = np.zeros(max(len(codes), 0), bool)
    if m < 2:
        return covered
    roll = codes[:m].copy()
    for k in range(1, n):
        roll = roll * _ROLL + codes[k : k + m]
    order = np.sort(mix(roll))
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        at = np.flatnonzero(np.isin(mix(roll), np.unique(twice)))
        depth = np.zeros(len(codes) + 1, np.int32)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + n, -1)
        covered = np.cumsum(depth[:-1]) > 0
    return covered


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def measure(text: str) -> dict:
    """All figures and verdicts of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    n_lines = n_dup = dup_chars = 0
    for line in lines:
        if line and (line in seen or not line.isspace()):
            n_lines += 1
            if line in seen:
                n_dup += 1
                dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
            else:
                seen.add(line)
    share, n_repeat = {}, 0
    if n > 5:
        ids = _Ids()
        codes = mix((np.fromiter(map(ids.__getitem__, words), np.uint64, n) + np.uint64(1)) * _MUL)
        for k in MAX_NGRAM_SHARE:
            covered = repeated(codes, k)
            if not covered.any():
                break  # a longer duplicated n-gram would hold a shorter one
            if k == 5:
                n_repeat = int(covered.sum())
                lengths = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
            share[k] = int(lengths[covered].sum()) / word_chars
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
    bad = (
        any(share.get(k, 0) > limit for k, limit in MAX_NGRAM_SHARE.items())
        or n_dup > MAX_LINE_SHARE * n_lines
        or dup_chars > MAX_LINE_CHAR_SHARE * word_chars
        or n_symbols > MAX_SYMBOL_SHARE * n
    )
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": not failed and not bad,
        "dup_line_chars": dup_chars, "dup_5gram_share": share.get(5, 0.0), "dup_10gram_share": share.get(10, 0.0),
    }


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_chars long, dup_5gram_share double, dup_10gram_share double"
)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of figures and verdicts for each row of ``docs``."""

    def make():
        def kernel(texts):
            rows = [measure(t) for t in texts]
            return {k: [r[k] for r in rows] for k in (f.split()[0] for f in FIELDS.split(", "))}

        return kernel

    return map_text(docs, make, FIELDS, id_col, text_col)
