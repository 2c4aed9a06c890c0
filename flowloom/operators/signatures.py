"""Payload signatures: many patterns in one pass, across segment boundaries.

One automaton holds all contents with ASCII letters folded; a rule that is not ``nocase`` is
confirmed on the original bytes. A stream's state is its last bytes, one fewer than the longest
content, so a match may begin in earlier segments but is reported where it ends, once.

Payloads that need no state are matched a batch at a time: a table of the pairs of bytes that can
begin a content leaves few places, of which those with the first bytes of a content are compared.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..decode.columnar import binary_parts
from .folds import greedy_rows


class Matcher:
    """``rules``: dicts with ``rule_id, content, nocase``."""

    def __init__(self, rules: list[dict]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        grouped: dict[str, list[tuple[int, bytes, bool]]] = {}
        for r in rules:
            content = bytes(r["content"])
            grouped.setdefault(content.lower().decode("latin-1"), []).append((r["rule_id"], content, bool(r["nocase"])))
        for key, own in grouped.items():
            self.machine.add_word(key, own)
        self.empty = not grouped
        self.carry = max((len(k) for k in grouped), default=1) - 1
        if not self.empty:
            self.machine.make_automaton()

    def scan(self, payload: bytes, tail: bytes = b"") -> list[tuple[int, int]]:
        """(rule, offset in ``payload`` behind the match), in order of the ends, overlaps included."""
        if self.empty or not payload:
            return []
        data, skip, out = tail + payload, len(tail), []
        for last, own in self.machine.iter(data.lower().decode("latin-1")):
            if last >= skip:
                for rule, content, nocase in own:
                    if nocase or data[last + 1 - len(content) : last + 1] == content:
                        out.append((rule, last + 1 - skip))
        return out

    def tail(self, payload: bytes, tail: bytes = b"") -> bytes:
        """The state behind ``payload``."""
        return (tail + payload)[-self.carry :] if self.carry else b""


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class BlockMatcher:
    """Matches all payloads of a batch; contents have at least two bytes."""

    #: Bytes whose places are looked at together.
    BLOCK = 1 << 18

    def __init__(self, rules: list[dict]):
        self.prefix = min(len(r["content"]) for r in rules)
        self.longest = max(len(r["content"]) for r in rules)
        self.pairs = np.zeros(1 << 16, bool)
        self.own: dict[bytes, list[tuple[int, bytes, bytes, bool]]] = {}
        for r in rules:
            content = bytes(r["content"])
            folded = content.translate(_FOLD)
            self.pairs[folded[0] | folded[1] << 8] = True
            self.own.setdefault(folded[: self.prefix], []).append((r["rule_id"], content, folded, bool(r["nocase"])))
        self.known = np.array(sorted(self.own), f"S{self.prefix}").view(f"V{self.prefix}")

    def _places(self, folded: bytes) -> np.ndarray:
        """Where the first bytes of a content stand."""
        b = np.frombuffer(folded, np.uint8)
        even, odd = b[: len(b) // 2 * 2].view("<u2"), b[1 : 1 + (len(b) - 1) // 2 * 2].view("<u2")
        at = np.concatenate([2 * np.flatnonzero(self.pairs[even]), 2 * np.flatnonzero(self.pairs[odd]) + 1])
        at = at[at + self.prefix <= len(b)]
        head = np.ascontiguousarray(b[at[:, None] + np.arange(self.prefix)]).view(f"V{self.prefix}").ravel()
        return np.sort(at[np.isin(head, self.known)])

    def scan(self, data: bytes | memoryview, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(payload, rule, offset behind the match) in order; payload k is ``data[offsets[k]:offsets[k + 1]]``."""
        out = []
        for s in range(int(offsets[0]), int(offsets[-1]), self.BLOCK):
            whole = bytes(data[s : s + self.BLOCK + self.longest - 1])
            folded = whole.translate(_FOLD)
            for at in self._places(folded).tolist():
                if at >= self.BLOCK:
                    break
                row = int(np.searchsorted(offsets, s + at, "right")) - 1
                for rule, content, low, nocase in self.own[folded[at : at + self.prefix]]:
                    stop = at + len(low)
                    if s + stop <= offsets[row + 1] and folded[at:stop] == low and (nocase or whole[at:stop] == content):
                        out.append((row, rule, s + stop - int(offsets[row])))
        return sorted(out, key=lambda m: (m[0], m[2], m[1]))


@lru_cache(4)
def _block_matcher(blob: bytes) -> BlockMatcher | None:
    rules = pickle.loads(blob)
    return BlockMatcher(rules) if rules and min(len(r["content"]) for r in rules) > 1 else None


@lru_cache(4)
def _matcher(blob: bytes) -> Matcher:
    return Matcher(pickle.loads(blob))


def matcher_blob(rules: list[dict]) -> bytes:
    return pickle.dumps([{k: r[k] for k in ("rule_id", "content", "nocase")} for r in rules])


def match_payloads(df: DataFrame, rules: list[dict], keys: list[str], payload: str) -> DataFrame:
    """``keys, rule_id, end`` of every match within single payloads (text is read as UTF-8 bytes)."""
    blob = matcher_blob(rules)
    own = T.StructType([df.schema[k] for k in keys])
    schema = T.StructType([*own.fields, T.StructField("rule_id", T.IntegerType()), T.StructField("end", T.LongType())])

    def run(batches):
        block = _block_matcher(blob)
        m = _matcher(blob) if block is None else None
        for b in batches:
            rows, rule, end = [], [], []
            column = b.column(b.num_columns - 1)
            if block is not None:
                _, offsets, buffer = binary_parts(column.fill_null(b"") if column.null_count else column)
                found = block.scan(memoryview(buffer) if buffer is not None else b"", offsets)
                rows, rule, end = zip(*found, strict=True) if found else ((), (), ())
            for k, data in enumerate(column.to_pylist() if block is None else ()):
                for r, e in m.scan(data or b""):
                    rows.append(k), rule.append(r), end.append(e)
            got = b.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(rule, pa.int32()), pa.array(end, pa.int64())], [*keys, "rule_id", "end"])

    return df.select(*keys, F.col(payload).cast("binary").alias("__payload")).mapInArrow(run, schema)


def match_streams(df: DataFrame, rules: list[dict], stream: list[str], order: list[str], payload: str) -> DataFrame:
    """``stream, order, rule_id, end`` of every match in streams whose segments follow each other in order.

    Streams are dealt by their key and read in order, batch by batch; what is kept between segments
    is a few bytes, so a stream may be of any length.
    """
    blob, keys = matcher_blob(rules), [*stream, *order]
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("rule_id", T.IntegerType()), T.StructField("end", T.LongType())])

    def run(batches):
        m = _matcher(blob)
        now, tail = None, b""
        for b in batches:
            rows, rule, end = [], [], []
            columns = [b.column(k).to_pylist() for k in range(len(stream))]
            for k, (data, *key) in enumerate(zip(b.column(b.num_columns - 1).to_pylist(), *columns, strict=True)):
                if key != now:
                    now, tail = key, b""
                data = data or b""
                for r, e in m.scan(data, tail):
                    rows.append(k), rule.append(r), end.append(e)
                tail = m.tail(data, tail)
            got = b.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(rule, pa.int32()), pa.array(end, pa.int64())], [*keys, "rule_id", "end"])

    dealt = df.select(*keys, F.col(payload).cast("binary").alias("__payload")).repartition(*stream).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def match_native(df: DataFrame, rules: list[dict], keys: list[str], payload: str) -> DataFrame:
    """``keys, rule_id`` of rules found in each payload, by one search for each rule; for a few rules.

    Only ASCII letters are folded, once for each payload.
    """
    folded = df.select(*keys, F.col(payload).alias("__payload"), F.translate(payload, _UPPER, _LOWER).alias("__folded"))
    fold = str.maketrans(_UPPER, _LOWER)
    found = [F.when((F.col("__folded").contains(r["content"].decode().translate(fold)) if r["nocase"] else F.col("__payload").contains(r["content"].decode())), F.lit(r["rule_id"])) for r in rules]
    return folded.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("rule_id"))


def signature_alerts(matches: DataFrame, rules: DataFrame, cooldown_sec: int = 60) -> DataFrame:
    """Alerts of matches, one for a rule and a direction between two addresses in each cooldown.

    ``matches``: ``ts_usec, pkt_no, rule_id, src, sport, dst, dport, host, app`` (host empty if it
    is the remote address). Ports do not count for the cooldown, which runs on packet times: hits are
    sorted by rule, direction and time and walked through, none is collected.
    """
    from ..functions.formats import endpoint

    # rules come from a file that the driver has read, so they are few; hits are not, and share few rules
    named = matches.join(F.broadcast(rules.select("rule_id", "name", "severity", F.col("message").alias("title"))), "rule_id")
    keys = ["name", "src", "dst"]
    first = named.groupBy(*keys, "ts_usec").agg(F.min_by(F.struct("pkt_no", "severity", "title", "sport", "dport", "host", "app"), F.struct("pkt_no", "rule_id")).alias("m"))
    taken = greedy_rows(first, keys, "ts_usec", cooldown_sec * 1_000_000).select(*keys, "ts_usec", "m.*")
    src, dst = endpoint(F.col("src"), F.col("sport")), endpoint(F.col("dst"), F.col("dport"))
    host = F.when(F.coalesce("host", F.lit("")) != "", F.concat(F.lit(" ("), "host", F.lit(")"))).otherwise("")
    app = F.when(F.coalesce("app", F.lit("")) != "", F.concat(F.lit(", "), "app")).otherwise("")
    return taken.select(
        "ts_usec", F.lit("signature").alias("kind"), "severity", "title",
        F.concat(src, F.lit(" → "), dst, host, app, F.lit(", signature "), "name").alias("message"), src.alias("src"), dst.alias("dst"),
    )


def rules_table(spark, rules: list[dict]) -> DataFrame:
    from ..schemas import SIGNATURES

    return spark.createDataFrame([(r["rule_id"], r["severity"], r["name"], bytearray(r["content"]), r["nocase"], r["message"]) for r in rules], SIGNATURES)
