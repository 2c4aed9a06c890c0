"""Operator 5: benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised to lower-case words. Every window (10 consecutive words of an item,
or the whole of a shorter item) is a pattern of one automaton over the benchmark's words, each a few
characters; it reads each text's runs of such words once. Hits are word positions, mapped back to spans of the original.

The benchmark is measured before it is sent to the executors. The automaton of ``MAX_CHARS`` of its
text fits a worker; a larger benchmark is dealt into ranges of that size with an automaton each. Every
automaton reads the texts where they are stored, texts are neither rewritten nor shuffled, and what
the automata found in a text is united by id and digest.

Defined results: null or empty texts have no words and no hits; items without words (null, empty)
are never found; repeated items count once for each distinct id, null ids as no item; repeated rows
are kept. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_text

WINDOW = 10
#: Characters of benchmark text in one automaton.
MAX_CHARS = 4 << 20

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(items: list[tuple[str, str]]) -> dict[tuple[bytes, ...], list[int]]:
    """Window -> the items that have it."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for k, (_, text) in enumerate(items):
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            have = out.setdefault(tuple(w[i : i + WINDOW]), [])
            if not have or have[-1] != k:
                have.append(k)
    return out


#: Characters at each place of a word's symbol; few, so that a node of the automaton has few edges.
BASE = 60


def symbol(k: int, width: int) -> str:
    """A number as ``width`` characters, with an alphabet of its own at each place; no character is 0."""
    return "".join(chr(1 + BASE * place + k // BASE**place % BASE) for place in range(width))


class Matcher:
    def __init__(self, items: list[tuple[str, str]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.machine = ahocorasick.Automaton()
        found = windows(items)
        known = dict.fromkeys(w for window in found for w in window)
        self.width = next(n for n in range(1, 9) if len(known) <= BASE**n)
        self.symbols = {w: symbol(k, self.width) for k, w in enumerate(known)}
        self.other = "\0" * self.width
        for window, have in found.items():
            self.machine.add_word("".join([self.symbols[w] for w in window]), (len(window), have))
        self.empty = not found
        if not self.empty:
            self.machine.make_automaton()
            # runs of known words that are long enough for the shortest window
            self.runs = re.compile(f"[^\0]{{{min(map(len, found)) * self.width},}}").finditer

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, (first word, words) of each hit, sorted ids of the items found."""
        w = words(text)
        if not w or self.empty:
            return len(w), [], []
        hits, items = [], set()
        for run in self.runs("".join(map(self.symbols.get, w, repeat(self.other)))):
            for end, (size, have) in self.machine.iter(run[0]):
                hits.append(((run.start() + end + 1) // self.width - size, size))
                items.update(have)
        return len(w), hits, sorted({self.ids[k] for k in items})


_MATCHERS: dict[str, Matcher] = {}


def _ranges(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> list:
    """For each range of items, of about ``limit`` characters, a function that gives a worker its matcher."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("k"), F.coalesce(item_text, F.lit("")).alias("t")).where("t <> ''")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-total // limit))

    def matcher_of(k: int):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == k)
        shared, name = spark.sparkContext.broadcast(sorted({(r.k, r.t) for r in part.toLocalIterator()})), uuid.uuid4().hex

        def get() -> Matcher:
            if name not in _MATCHERS:
                _MATCHERS.clear()  # a worker holds one at a time
                _MATCHERS[name] = Matcher(shared.value)
            return _MATCHERS[name]

        return get

    return [matcher_of(k) for k in range(n)]


def runs_of(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [first, behind the last) of hit words; runs that touch are one."""
    out: list[list[int]] = []
    for start, size in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out]


def spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with their character offsets [start, stop) in the original text."""
    if not runs:
        return []
    data = text.encode("utf-8", "surrogatepass")
    where = [m.span() for m in _WORD.finditer(data)]
    first = np.array([where[a][0] for a, _ in runs]), np.array([where[b - 1][1] for _, b in runs])
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    begins = np.concatenate([[0], begins])
    return [{"first": a, "last": b, "start": int(begins[s]), "stop": int(begins[e])} for (a, b), s, e in zip(runs, *first, strict=True)]


RUNS = "array<struct<first:long,last:long,start:long,stop:long>>"
FIELDS = f"n_words long, items array<string>, runs {RUNS}"


def _found(get):
    def make():
        matcher = get()

        def kernel(texts):
            got = [matcher.scan(t) for t in texts]
            return {"n_words": [n for n, _, _ in got], "items": [i for _, _, i in got], "runs": [spans(t, runs_of(h)) for t, (_, h, _) in zip(texts, got, strict=True)]}

        return kernel

    return make


def _unite(batches):
    """Items and runs that several automata found in a text become one list each."""
    import pandas as pd

    for pdf in batches:
        items, runs = [], []
        for own, more in zip(pdf["found"], pdf["more"], strict=True):
            parts = [own, *(more if more is not None else ())]
            items.append(sorted({i for p in parts for i in p["items"]}))
            merged: list[dict] = []
            for r in sorted((r for p in parts for r in p["runs"]), key=lambda r: (r["first"], r["last"])):
                if merged and r["first"] <= merged[-1]["last"]:
                    merged[-1] = merged[-1] | ({"last": r["last"], "stop": r["stop"]} if r["last"] > merged[-1]["last"] else {})
                else:
                    merged.append(dict(r))
            runs.append(merged)
        yield pd.DataFrame({"key": pdf["key"], "n_words": pdf["n_words"], "items": items, "runs": runs})


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS,
) -> DataFrame:
    """``id, n_words, n_hit, item_ids`` (sorted as strings) ``, spans`` (of the original text) of every row."""
    first, *rest = _ranges(benchmark, item_id, item_text, max_chars)
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).alias("id"), *([F.sha2(text, 256).alias("text")] if rest else []))
    keyed = docs.select(key.alias("key"), text.alias("text"))
    found = map_text(keyed, _found(first), FIELDS, "key")
    if rest:
        others = [map_text(keyed, _found(get), FIELDS, "key").where("size(runs) > 0") for get in rest]
        while len(others) > 1:
            others = [a if b is None else a.union(b) for a, b in zip(others[::2], [*others[1::2], None], strict=False)]
        more = others[0].groupBy(F.col("key").alias("of")).agg(F.collect_set(F.struct("items", "runs")).alias("more"))  # repeated rows are combined
        both = found.join(more, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "n_words", F.struct("items", "runs").alias("found"), "more")
        found = both.mapInPandas(_unite, found.schema)
    return found.select(
        F.col("key.id").alias(id_col), "n_words", F.expr("aggregate(runs, 0L, (n, r) -> n + r.last - r.first)").alias("n_hit"), F.col("items").alias("item_ids"),
        F.expr("transform(runs, r -> struct(r.start as start, r.stop as stop))").alias("spans"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS
) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of the benchmark hits."""
    first, *rest = _ranges(benchmark, item_id, item_text, max_chars)

    def clean(get):
        def make():
            matcher = get()
            return lambda texts: [not matcher.scan(t)[1] for t in texts]

        return make

    kept = keep_rows(docs, clean(first), text_col)
    if not rest:
        return kept
    # whether a text is hit depends on nothing else, so digests of hit texts tell the rows of the other ranges
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.sha2(text, 256).alias("key"), text.alias("text"))
    hit = [map_text(keyed, _found(get), FIELDS, "key").where("size(runs) > 0").select("key") for get in rest]
    while len(hit) > 1:
        hit = [a if b is None else a.union(b) for a, b in zip(hit[::2], [*hit[1::2], None], strict=False)]
    gone = hit[0].distinct()
    return kept.join(gone, F.sha2(kept[text_col].cast("string"), 256) == gone["key"], "left_anti")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from what ``decontaminate`` returns."""
    return found.select(
        id_col, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )
